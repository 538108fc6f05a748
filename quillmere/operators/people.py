"""Who does what: whether a question asks for everyone or for one thing's people, and the roster that answers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for people in general, as patterns of whole words.
VOCABULARY = (
    "who|whom|whose|devs?|developers?|engineers?|team|teams?|teammates?|members?|staff|colleagues?|people|persons?|everyone|roster|assignees?|owners?|company|companies|org|organisation|organization|working|works|work"
)
#: Words that name no subject.
GENERIC = (
    "the|and|for|are|was|were|did|does|has|have|had|what|when|where|why|how|which|about|from|with|this|that|these|those|there|here|into|onto|over|under|made|make|makes|making|said|say|says|tell|show|give|list|find"
    "|search|look|looking|page|pages|document|documents|doc|docs|source|sources|our|your|their|its|his|her|can|will|would|should|could|been|being|any|all|some|more|most|much|many|now|then|than|but|not|out|off|per"
    "|via|only|just|also|does|doing|done"
)
ITEM_CHARS, ITEMS_SHOWN = 48, 3


def subject_terms(question: Column) -> Column:
    """The words of a question, in order, that are neither about people in general nor scaffolding; two letters say nothing."""
    words = F.split(F.lower(F.coalesce(question, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike(f"^({VOCABULARY})$") & ~w.rlike(f"^({GENERIC})$"))


def asks_for_everyone(question: Column) -> Column:
    """Of a question about people: no subject is left without its words for people, so that the whole roster answers it."""
    return F.size(subject_terms(question)) == 0


def item_list(items: Column) -> Column:
    """The first items, each cut to what can be scanned, and how many more there are."""
    some = F.transform(F.slice(items, 1, ITEMS_SHOWN), lambda i: F.when(F.length(i) > ITEM_CHARS, F.concat(F.rtrim(F.left(i, F.lit(ITEM_CHARS - 1))), F.lit("…"))).otherwise(i))
    rest = F.size(items) - ITEMS_SHOWN
    return F.when(F.size(items) == 0, "—").otherwise(F.concat(F.array_join(some, "; "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise("")))


def people(work: DataFrame, *keys: str) -> DataFrame:
    """keys, key, name, owns and items (in order, each once) of rows keys, name, title and owns: a person is one whatever the case of the name.

    Titles of a person are collected with the person's row only: they are as many as it can be named for.
    """
    own = work.where(F.trim("name") != "").groupBy(*keys, F.lower(F.trim("name")).alias("key"), "title").agg(F.min(F.trim("name")).alias("name"), F.max("owns").alias("owns"))
    return own.groupBy(*keys, "key").agg(F.min("name").alias("name"), F.max("owns").alias("owns"), F.array_sort(F.collect_set("title")).alias("items"))


def roster(found: DataFrame, *keys: str) -> DataFrame:
    """keys and roster, in Markdown, of people(): names, then a table of what each owns. Who owns something makes the table; the others are named after it, as authors only.

    Where no one owns anything all make the table. Most items come first, then names in order. Groups without people have no row.
    """
    row = F.struct((-F.size("items")).alias("n"), "name", F.size("items").alias("count"), item_list(F.col("items")).alias("shown"), "owns")
    held = found.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("p"))
    owners = F.filter("p", lambda x: x["owns"])
    held = held.withColumn("head", F.when(F.size(owners) > 0, owners).otherwise(F.col("p"))).withColumn("rest", F.when(F.size(owners) > 0, F.filter("p", lambda x: ~x["owns"])).otherwise(F.slice("p", 1, 0)))
    names = F.array_join(F.transform("head", lambda x: F.concat(F.lit("**"), x["name"], F.lit("**"))), ", ")
    lines = F.array_join(F.transform("head", lambda x: F.concat(F.lit("| "), x["name"], F.lit(" | "), x["count"].cast("string"), F.lit(" | "), x["shown"], F.lit(" |"))), "\n")
    also = F.when(
        F.size("rest") > 0,
        F.concat(F.lit("\n\nAlso appearing as document authors (may include workspaces or bots, not only people): "), F.array_join(F.transform("rest", lambda x: x["name"]), ", "), F.lit(".")),
    ).otherwise("")
    return held.select(*keys, F.concat(names, F.lit("\n\n| Person | Items | Assigned work |\n| --- | --- | --- |\n"), lines, also).alias("roster"))
