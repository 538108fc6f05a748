"""Licence scan of a file tree: sparse TF-IDF cosine to licence templates, then inheritance from the nearest directory.

All of it is joins and aggregations of built-in functions. What is compared with a template is a unit of a file: a line, a
paragraph (with comment marks taken off, so that a notice wrapped over several comment lines is one), or the whole text. Weights come
from the number of files that hold a term, over all files and all terms. A file without a licence of its own takes that of the
nearest directory above it with a licence file.

Which units are compared follows from the weights themselves: a cosine of t needs terms that hold t squared of a template's squared weight, so
a unit without any of the template's rarest terms, as many as hold more than the rest allows, can't reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm import support
from quillmere.llm.license_texts import TEMPLATES

TERM = "[a-z0-9]+"
#: Marks that begin lines of comments, and what parts paragraphs.
MARKS, BLANK = r"(?m)^[ \t]*(?://+|#+|/?\*+/?|--+|;+|%+|<!--)[ \t]*", r"\n[ \t\r]*\n"
HEADER_COSINE, FILE_COSINE = 0.8, 0.8
#: A whole text this near to a template is that text, whatever notices stand in it.
VERBATIM = 0.995


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def scan(files: DataFrame) -> DataFrame:
    """file_id, path, own_license, own_score, license, inherited_from and file_license_score of every row.

    files: file_id, path (directories separated by /) and text; more columns are ignored. own_license is that of the template which one of the
    file's lines or paragraphs is most like, with a cosine of HEADER_COSINE or more; ties go to the smaller name. A file whose whole text is like a
    template by FILE_COSINE is a licence file of its directory. Where its text is the template's, by VERBATIM, that is its licence and its own one; else a notice in it
    goes before what the whole text is most like, as licences share most of their wording. Of a directory's several licence files the one with the best score counts, then
    the smallest name. license is the own one, else that of the nearest directory from the file's own upwards, whose path is in inherited_from; else null.

    Null and empty texts have no licence of their own; a null path is in the top directory, which has the empty path. Rows
    that share a file_id are one file with the better of their scores, in each of the rows; each counts as a file for the weights.
    """
    spark = files.sparkSession
    path = F.coalesce(F.col("path"), F.lit(""))
    base = files.select("file_id", path.alias("path"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("dir"), F.coalesce("text", F.lit("")).alias("text"))
    df = base.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = support.materialise(df, "term-files")
    total = files.count()
    templates = _weighed(_template_terms(spark), df, total, "template", "license", "least")
    norms = templates.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    templates = templates.join(norms, "template").select("template", "license", "least", "term", "df", (F.col("w") / F.col("norm")).alias("w"))
    templates = support.materialise(templates, "templates")

    for_header, for_file = _telling(templates, F.lit(HEADER_COSINE)), _telling(templates, F.col("least"))  # some terms of the templates
    marked = base.where(F.arrays_overlap(_terms(F.col("text")), F.array(*map(F.lit, sorted({*for_header, *for_file})))))
    marked = support.materialise(marked.select("file_id", "dir", "text"), "marked", "snappy")
    unit = F.array_union(F.split("text", "\n"), F.split(F.regexp_replace("text", MARKS, ""), BLANK))
    units = marked.select("file_id", "dir", F.explode(unit).alias("unit")).distinct()
    has = lambda terms: F.arrays_overlap(_terms(F.col("unit")), F.array(*map(F.lit, terms)))
    headers = _cosines(units.where(has(for_header)), templates, df, total)
    own = headers.where(F.col("score") >= HEADER_COSINE).groupBy("file_id").agg(_best("license", "score").alias("b"))
    own = support.materialise(own.select("file_id", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score")), "notices")
    whole = marked.select("file_id", "dir", F.col("text").alias("unit")).distinct().where(has(for_file))
    likest = _cosines(whole, templates, df, total).where("score >= least").groupBy("file_id", "dir").agg(_best("license", "score").alias("b"))
    verbatim = F.col("b.score") >= VERBATIM
    file_like = likest.join(own, "file_id", "left").select(
        "file_id", "dir", F.col("b.score").alias("score"), F.when(verbatim, F.col("b.license")).otherwise(F.coalesce("own_license", "b.license")).alias("license"), verbatim.alias("verbatim")
    )
    file_like = support.materialise(file_like, "licence-files")
    by_dir = support.materialise(file_like.groupBy("dir").agg(_best("license", "score").alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("dir_license")), "directories")
    texts = file_like.where("verbatim").groupBy("file_id").agg(_best("license", "score").alias("t"))
    own = own.join(texts, "file_id", "full").select("file_id", F.coalesce("t.license", "own_license").alias("own_license"), F.coalesce("t.score", "own_score").alias("own_score"))

    # Each directory joins the directories above it on their paths; the deepest with a licence file is the nearest.
    places = support.materialise(base.groupBy("dir").agg(F.count("*").alias("n")), "places")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    near = (
        places.select("dir", F.posexplode(above).alias("depth", "above")).join(by_dir, "above")
        .groupBy("dir").agg(F.max_by(F.struct("above", "dir_license"), "depth").alias("a"))
    )
    near = places.join(near, "dir", "left").select("dir", "n", F.col("a.above").alias("above"), F.col("a.dir_license").alias("dir_license"))
    score = file_like.groupBy("file_id").agg(F.max("score").alias("file_license_score"))
    joined = support.join_counted(base.select("file_id", "path", "dir"), near, "dir", "n", total)
    joined = joined.join(support.materialise(own, "own"), "file_id", "left").join(support.materialise(score, "scores"), "file_id", "left")
    inherits = F.col("own_license").isNull()
    return joined.select(
        "file_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(inherits, F.col("above")).alias("inherited_from"), "file_license_score",
    )


def _template_terms(spark: SparkSession) -> DataFrame:
    """template, license, least (the cosine that a whole file needs), term and tf."""
    rows = [(i, name, text, FILE_COSINE if whole else HEADER_COSINE) for i, (name, text, whole) in enumerate(TEMPLATES)]
    table = spark.createDataFrame(rows, "template int, license string, text string, least double")
    return table.select("template", "license", "least", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "least", "term").agg(F.count("*").alias("tf"))


def _weighed(tf: DataFrame, df: DataFrame, total: int, *key: str) -> DataFrame:
    """key, term, df and w, the TF-IDF weight of rows of key, term and tf; terms that no file has weigh most."""
    idf = F.ln(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
    return tf.join(df, "term", "left").select(*key, "term", F.coalesce("df", F.lit(0)).alias("df"), (F.col("tf") * idf).alias("w"))


def _telling(templates: DataFrame, cosine: Column) -> list[str]:
    """Of each template the rarest terms, as many as hold over 1 - cosine squared of its squared weight: one of them is in all that reaches the cosine."""
    order = Window.partitionBy("template").orderBy("df", "term")
    before = F.sum(F.col("w") * F.col("w")).over(order) - F.col("w") * F.col("w")
    rows = templates.withColumn("before", before).where(F.col("before") <= 1 - (cosine - 1e-6) ** 2).select("term").distinct().collect()
    return sorted(r.term for r in rows)


def _best(name: str, score: str) -> Column:
    """Of the highest score the smallest name."""
    return F.min_by(F.struct(name, score), F.struct(-F.col(score), F.col(name)))


def _cosines(units: DataFrame, templates: DataFrame, df: DataFrame, total: int) -> DataFrame:
    """file_id, dir, license, least and score (rounded to 6 places) of the units that share a term with a template."""
    numbered = units.withColumn("id", F.xxhash64("file_id", "unit"))
    key = ["file_id", "dir", "id"]
    tf = numbered.select(*key, F.explode(_terms(F.col("unit"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    weighed = support.materialise(_weighed(tf, df, total, *key).drop("df"), "unit-terms", "snappy")
    norm = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = (
        weighed.join(F.broadcast(templates.select("term", "template", "license", "least", F.col("w").alias("s"))), "term")  # some terms for each template
        .groupBy(*key, "template", "license", "least").agg(F.sum(F.col("w") * F.col("s")).alias("dot"))
    )
    return dot.join(norm, key).select("file_id", "dir", "license", "least", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
