"""URL filtering by path templates: variable segments become wildcards, similar branches merge, impure templates are rejected.

Everything after reading the pages runs on one row for each host and path shape, with counts of what is
labelled as blocked, as allowed, and not at all. The tree is built one level at a time. Under a host's template prefix, a level
whose literal segments are too many to be names becomes a wildcard. Of the others, each branch is compared with its
siblings (what follows it, and how its pages are labelled) by a chi-square statistic; those that don't differ merge.

Few pages are labelled, so labels are carried across hosts first: where the labelled pages of a path shape are, on all hosts together
and smoothed by SMOOTHING pages of the overall share, PURITY blocked (or allowed), the unlabelled pages of that shape count as such in their own
hosts' trees. That asks for evidence that the path decides and not the host: the shape has several literal segments, or it is labelled on
a host that has both labels; and the hosts that it is labelled on are at least half of those that have it, so that a generic shape carries nothing.
A template's purity is the blocked share of its labelled pages, smoothed in the same way; a template without any abstains, and its pages are allowed.

One host can hold most of the pages. Its rows then make one side of a join uneven, never both: the other has one row for each template
prefix, or at most KINDS of them, so that Spark can split the partition; sums are taken before rows are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm import support

#: A level is variable if it has so many distinct literals, and so many of them for each page.
DISTINCT, DISTINCT_SHARE = 12, 0.3
#: 99th percentiles of chi-square for 1 to 14 degrees of freedom (fixed values).
CRITICAL = (6.63, 9.21, 11.34, 13.28, 15.09, 16.81, 18.48, 20.09, 21.67, 23.21, 24.72, 26.22, 27.69, 29.14)
SMOOTHING, PURITY = 4.0, 0.9


@dataclass(frozen=True)
class Rule:
    """Blocks or allows what lies under a path, on a host and its subdomains."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(support.ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of name and verdict of the longest rule that fits; null if none does. For lists of rules that fit an expression."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        this = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, this) if found is None else found.when(fits, this)
    return F.lit(None).cast("struct<name:string,verdict:string>") if found is None else found


def _shape(segment: Column) -> Column:
    """A segment with what is surely variable generalised: numbers, and hexadecimal or very long names; an extension stays."""
    name, extension = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    general = (
        F.when(name.rlike("^[0-9]+$"), "{n}").when(name.rlike("^[0-9a-fA-F-]{12,}$"), "{x}")
        .when(name.rlike("[0-9]"), F.regexp_replace(name, "[0-9]+", "{n}")).when(F.length(name) > 40, "{long}").otherwise(name)
    )
    return F.concat(general, F.lower(extension))


def _kind(shape: Column) -> Column:
    """What follows a branch, in few kinds."""
    return F.when(shape.isNull(), "end").when(shape.startswith("{n}"), "number").when(shape.startswith("{"), "token").when(shape.contains("."), "file").otherwise("word")


def templates(shapes: DataFrame) -> DataFrame:
    """Adds template to rows of host, shape (array of segments), blocked, allowed, other and n (their sum).

    A shape that is alone under its template prefix has nothing to be compared with: its other segments follow as they
    are. So there are as many levels as two shapes of a host have in common, whatever the length of paths.
    """
    open_ = support.materialise(shapes.withColumn("template", F.lit("")), "tree")
    key, level, done = ["host", "template"], 0, []
    while True:
        alone = open_.groupBy(*key).agg(F.count("*").alias("shapes"))
        marked = open_.join(alone, key).withColumn("shapes", F.when(F.size("shape") <= level, 1).otherwise(F.col("shapes")))
        marked = support.materialise(marked, "level")
        rest = F.transform(F.slice("shape", level + 1, F.greatest(F.size("shape"), F.lit(1))), lambda s: F.concat(F.lit("/"), s))
        done.append(marked.where("shapes = 1").drop("shapes").withColumn("template", F.concat("template", F.array_join(rest, ""))))
        tree = marked.where("shapes > 1").drop("shapes")
        if tree.isEmpty():
            break
        at = tree.withColumn("segment", F.try_element_at("shape", F.lit(level + 1)))
        here = at.where("segment IS NOT NULL")
        after = _kind(F.try_element_at("shape", F.lit(level + 2)))
        counts = (
            here.groupBy(*key, "segment", after.alias("after")).agg(*(F.sum(c).alias(c) for c in ("blocked", "allowed", "other")))
            .select(*key, "segment", F.explode(F.array(*(F.struct(F.concat_ws(":", "after", F.lit(c)).alias("kind"), F.col(c).alias("c")) for c in ("blocked", "allowed", "other")))).alias("k"))
            .select(*key, "segment", "k.kind", "k.c").where("c > 0")
        )
        counts = support.materialise(counts, "counts")
        branch = counts.groupBy(*key, "segment").agg(F.sum("c").alias("branch_n"))
        parent = branch.groupBy(*key).agg(F.sum("branch_n").alias("parent_n"), F.count("*").alias("branches"))
        kinds = counts.groupBy(*key, "kind").agg(F.sum("c").alias("kind_n"))
        # Chi-square of a branch against its siblings, over the kinds that their parent has.
        cells = branch.join(parent, key).join(kinds, key).join(counts, [*key, "segment", "kind"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
        c, b, k, n = (F.col(x).cast("double") for x in ("c", "branch_n", "kind_n", "parent_n"))
        part = F.pow(c * n - b * k, F.lit(2)) / (b * k * (n - b) * (n - k) / n)
        tested = cells.groupBy(*key, "segment", "parent_n", "branches").agg(
            F.sum(F.when((F.col("parent_n") > F.col("branch_n")) & (F.col("parent_n") > F.col("kind_n")), part * (1 - F.col("kind_n") / F.col("parent_n"))).otherwise(0.0)).alias("chi"),
            F.count("*").alias("kinds"),
        )
        critical = F.element_at(F.array(*map(F.lit, CRITICAL)), F.greatest(F.lit(1), F.least(F.col("kinds") - 1, F.lit(len(CRITICAL)))).cast("int"))
        variable = (F.col("branches") >= DISTINCT) & (F.col("branches") >= DISTINCT_SHARE * F.col("parent_n"))
        similar = (F.col("branches") > 1) & (F.col("chi") < critical)
        named = tested.select(*key, "segment", F.when(variable | similar, "{*}").otherwise(F.col("segment")).alias("name"))
        named = at.join(named, [*key, "segment"], "left").withColumn("template", F.concat("template", F.coalesce(F.concat(F.lit("/"), "name"), F.lit(""))))
        open_ = support.materialise(named.drop("segment", "name"), "tree")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*shapes.columns, "template")


def _purity(base: float) -> Column:
    """Share of blocked pages among the labelled ones of a group, smoothed by SMOOTHING pages of the share base."""
    return (F.sum("blocked") + SMOOTHING * base) / (F.sum(F.col("blocked") + F.col("allowed")) + SMOOTHING)


def carried(shapes: DataFrame, base: float) -> DataFrame:
    """Rows of templates() with unlabelled pages labelled as those of their shape are on all hosts together, if that is pure and says something of the path."""
    keyed = shapes.withColumn("key", F.concat_ws("/", "shape"))
    both = shapes.groupBy("host").agg(((F.sum("blocked") > 0) & (F.sum("allowed") > 0)).alias("both"))
    labelled = (F.col("blocked") + F.col("allowed")) > 0
    literals = F.size(F.filter("shape", lambda s: ~s.startswith("{")))
    told = keyed.where(literals > 0).join(both, "host").groupBy("key").agg(
        F.count("*").alias("hosts"), F.count_if(labelled).alias("labelled"), F.max(labelled & F.col("both")).alias("of_path"), F.max(literals).alias("literals"), _purity(base).alias("vote")
    )
    votes = told.select("key", "hosts", F.when((2 * F.col("labelled") >= F.col("hosts")) & (F.col("of_path") | ((F.col("literals") > 1) & (F.col("labelled") > 1))), F.col("vote")).alias("vote"))
    joined = support.join_counted(keyed, votes, "key", "hosts", shapes.count(), "left")
    out, other = {}, F.col("other")
    for name, pure in (("blocked", F.col("vote") >= PURITY), ("allowed", F.col("vote") <= 1 - PURITY)):
        out[name] = F.col(name) + F.when(pure, other).otherwise(0)
    kept = F.when((F.col("vote") >= PURITY) | (F.col("vote") <= 1 - PURITY), 0).otherwise(other)
    own = labelled.alias("own")
    return joined.select("host", "shape", out["blocked"].alias("blocked"), out["allowed"].alias("allowed"), kept.alias("other"), "n", own)


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and evidence of every row.

    pages: page_id and url; more columns are ignored, repeated rows stay. What a rule blocks or allows is labelled so; labels
    (page_id, blocked: boolean) adds to that where no rule fits. Where no rule decides, a page is blocked if its template's smoothed
    purity reaches PURITY. evidence is rule, template (labelled pages of its own), carried (labels of its shape on other hosts only) or none, which allows.
    A null url, or one without ://, has an empty host and path, and no rule fits it; a null page_id is a page like any other.
    """
    host, path = parsed(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fitting(F.col("host"), F.col("path"), rules)).withColumn("label", F.col("rule.verdict"))
    if labels is not None:
        own = labels.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("blocked").alias("blocked"))
        rows = rows.join(own, "page_id", "left").withColumn("label", F.coalesce("label", F.when(F.col("blocked"), "block").when(~F.col("blocked"), "allow"))).drop("blocked")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    shape = F.transform(segments, _shape)
    rows = support.materialise(rows.withColumn("shape", shape), "urls")
    key = F.concat_ws("/", "host", F.concat_ws("/", "shape")).alias("place")
    shapes = rows.groupBy("host", "shape").agg(
        F.count_if(F.col("label") == "block").alias("blocked"), F.count_if(F.col("label") == "allow").alias("allowed"), F.count_if(F.col("label").isNull()).alias("other"), F.count("*").alias("n")
    )
    shapes = support.materialise(shapes, "shapes")
    base = shapes.agg((F.sum("blocked") / F.greatest(F.sum(F.col("blocked") + F.col("allowed")), F.lit(1))).alias("p")).first().p or 0.0
    tree = templates(support.materialise(carried(shapes, base), "carried"))
    judged = tree.groupBy("host", "template").agg(_purity(base).alias("purity"), F.sum(F.col("blocked") + F.col("allowed")).alias("told"), F.max("own").alias("own"))
    evidence = F.when(F.col("told") == 0, "none").when(F.col("own"), "template").otherwise("carried")
    verdict = F.when((F.col("told") > 0) & (F.col("purity") >= PURITY), "block").otherwise("allow")
    found = tree.drop("own").join(judged, ["host", "template"]).select(key, "n", "template", verdict.alias("own"), evidence.alias("evidence"))
    found = support.materialise(found, "judged")
    joined = support.join_counted(rows.withColumn("place", key), found, "place", "n", rows.count())
    return joined.select(
        "page_id", "host", "path", F.col("rule.name").alias("rule"), F.coalesce(F.col("rule.verdict"), "own").alias("verdict"), "template",
        F.when(F.col("rule").isNotNull(), "rule").otherwise(F.col("evidence")).alias("evidence"),
    )
