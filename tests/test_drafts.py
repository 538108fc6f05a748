"""Drafts, rules, labels, weekly texts, cursors and claims on rows where the rules can be seen."""

import math

from pyspark.sql import functions as F

from quillmere.functions import labels
from quillmere.operators import drafts, ingestion, series


def test_drafts_are_checked_before_the_gate(spark):
    rows = [
        ("note", "t", "b", 0.7, "ai", None, "active"), ("note", "t", "b", 0.69, "ai", None, "queued_for_review"), ("note", "t", "b", 0.1, "human", None, "active"),
        ("todo", "t", "b", 0.7, "ai", "type", None), (None, "t", "b", 0.7, "ai", "type", None), ("note", " ", "b", 0.7, "ai", "title", None), ("note", "t", None, 0.7, "ai", "body", None),
        ("note", "t", "b", 1.1, "ai", "confidence", None), ("note", "t", "b", math.nan, "ai", "confidence", None), ("note", "t", "b", None, "ai", "confidence", None), ("note", "t", "b", 0.7, "bot", "author", None),
    ]
    found = spark.createDataFrame(rows, "type string, title string, body string, confidence double, author string, error string, status string")
    error = drafts.draft_error(*(F.col(c) for c in ("type", "title", "body", "confidence", "author")))
    for r in found.withColumn("e", error).withColumn("s", drafts.gate(F.col("confidence"), F.col("author"))).collect():
        assert r.e == r.error and (r.error or r.s == r.status)


def test_rules_name_their_events(spark):
    prose = ["From now on, summarise standups every morning until June", "be kind", "", None]
    found = [r.r for r in spark.createDataFrame([(p,) for p in prose], "p string").select(drafts.standing_rule(F.col("p")).alias("r")).collect()]
    assert found[0].triggers == ["meeting_attended", "daily_digest_due"] and found[0].persistence == "until_date"
    assert all(r.triggers == ["document_processed"] and r.persistence == "permanent" for r in found[1:])
    assert [r.name for r in found[1:]] == ["be kind", "Standing rule", "Standing rule"]


def test_labels(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    assert show(labels.quantity(F.lit("minute"), F.lit("meeting minute"), F.lit(1.2))) == "1 meeting minute"
    assert show(labels.quantity(F.lit("minute"), F.lit("meeting minute"), F.lit(1412.0))) == "1,412 meeting minutes"
    assert show(labels.quantity(F.lit("kchar"), F.lit("1k characters"), F.lit(0.25))) == "0.25 1k characters"
    assert [show(labels.sigma(F.lit(x))) for x in (0.004, 1.5, -0.25)] == ["0.00σ", "+1.50σ", "-0.25σ"]
    assert [show(labels.price(F.lit(29.0), F.lit(y))) for y in (True, False)] == [21.0, 29.0]


def test_drift_looks_back_only(spark):
    rows = [(1, 1, 0.0, [1.0, 0.0]), (1, 1, 1.0, [3.0, 0.0]), (1, 2, 0.5, [0.0, 2.0]), (1, 3, 0.5, [1.75, 0.25])]
    found = {r.week: r for r in series.weekly_text(spark.createDataFrame(rows, "tenant_id long, week long, sentiment double, embedding array<double>")).collect()}
    assert found[1].topic_drift == 0.0 and (found[1].sentiment_mean, found[1].sentiment_std) == (0.5, 0.5)
    assert abs(found[2].topic_drift - 1) < 1e-9 and abs(found[3].topic_drift) < 1e-8  # the baseline of week 3 is (1.75, 0.25)
    assert series.weekly_text(spark.createDataFrame([], "tenant_id long, week long, sentiment double, embedding array<double>")).count() == 0


def test_commits_above_the_cursor(spark):
    commits = spark.createDataFrame([(r, f"s{i}", i) for r in (1, 2, 3) for i in range(9)], "repo int, sha string, at int")
    cursors = spark.createDataFrame([(1, "s6"), (2, "gone")], "repo int, sha string")
    found = ingestion.commits_since(commits, cursors, 5).collect()
    got = {r: [x.sha for x in sorted(found, key=lambda x: x.place) if x.repo == r] for r in (1, 2, 3)}
    assert got == {1: ["s8", "s7"], 2: ["s8", "s7", "s6", "s5", "s4"], 3: ["s8", "s7", "s6", "s5", "s4"]}


def test_claims_take_over_stale_runs(spark):
    rows = [(1, "a", "RUNNING", "2024-01-01 11:55:00"), (2, "a", "PENDING", "2024-01-01 11:58:00"), (3, "b", "RUNNING", "2024-01-01 11:49:59"), (4, "b", "PENDING", "2024-01-01 11:59:00"), (5, "c", "DONE", "2023-01-01 00:00:00")]
    work = spark.createDataFrame(rows, "id int, owner string, status string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    found = ingestion.claimable(work, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).collect()
    assert {r.owner: r.id for r in found} == {"a": 2, "b": 3}
