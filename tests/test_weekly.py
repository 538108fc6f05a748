import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmere.operators import forecast, series, weekly

SCHEMA = "tenant_id string, ts timestamp_ntz, actor string, kind string, review_delay_s double"


def events(spark, *rows):
    return spark.createDataFrame([("t", dt.datetime.fromisoformat(ts), actor, kind, delay) for ts, actor, kind, delay in rows], SCHEMA)


def test_counts_of_a_week(spark):
    rows = weekly.weekly_features(events(spark, *[(f"2026-01-0{d}T10:00:00", "a", k, None) for d, k in ((5, "commit"), (6, "commit"), (7, "pr_opened"), (8, "pr_merged"))])).collect()
    assert [(r.n_commits, r.n_prs_opened, r.n_prs_merged, r.merge_rate) for r in rows] == [(2, 1, 1, 1.0)]


def test_ratios_and_safe_division(spark):
    r = weekly.weekly_features(events(spark, *[(ts, "a", "pr_merged", None) for ts in ("2026-01-05T08:00:00", "2026-01-06T12:00:00", "2026-01-10T12:00:00", "2026-01-07T20:00:00")])).first()
    assert (r.after_hours_ratio, r.weekend_ratio, r.merge_rate) == (0.5, 0.25, 0.0)


def test_grid_and_run_length(spark):
    rows = weekly.weekly_features(events(spark, ("2026-01-05T10:00:00", "a", "commit", None), ("2026-02-16T10:00:00", "a", "commit", None))).orderBy("bucket").collect()
    assert len(rows) == 7 and rows[-1].observed == 1 and [r.weeks_since_last_event for r in rows] == [0, 1, 2, 3, 4, 5, 0]


def test_since_decision_and_median(spark):
    frame = events(spark, ("2026-01-05T10:00:00", "a", "decision", 100.0), ("2026-01-12T10:00:00", "a", "commit", 100.0), ("2026-01-19T10:00:00", "b", "commit", 300.0), ("2026-01-19T11:00:00", "a", "commit", 100.0))
    found = weekly.since_nonzero(weekly.weekly_features(frame), "n_decisions", "since").orderBy("bucket").collect()
    assert [r.since for r in found] == [0, 1, 2] and found[2].median_review_delay == 200.0 and found[2].active_actors == 2


def test_no_events(spark):
    assert weekly.weekly_features(events(spark)).collect() == []


def test_heatmap_shift_and_bands(spark):
    frame = events(spark, *[("2024-01-07T23:30:00", "a", "x", None)], *[("2024-01-06T12:00:00", "a", "x", None)] * 2, ("2024-01-08T18:00:00", "a", "x", None))
    assert {(r.band, r.day_col): r.n for r in series.after_hours(frame, -300).collect()} == {(0, 6): 3}


def test_normaliser_learns_from_training_rows_only(spark):
    frame = spark.createDataFrame([("t", dt.date(2026, 1, 1) + dt.timedelta(i), 10.0 if i < 10 else 1000.0) for i in range(20)], "tenant_id string, bucket date, n double")
    r = forecast.fit_normaliser(frame, {"n": True}, F.lit("2026-01-10").cast("date")).first()
    assert r["mean"] == pytest.approx(2.3978952727983707) and r["std"] == pytest.approx(0.0)


def test_coverage(spark):
    f = spark.createDataFrame([("t", dt.date(2026, 1, i + 1), 0.0, 1.0) for i in range(10)], "tenant_id string, bucket date, p10 double, p90 double")
    a = spark.createDataFrame([("t", dt.date(2026, 1, i + 1), 1.0 if i < 8 else 5.0) for i in range(10)] + [("t", dt.date(2027, 1, 1), 9.0)], "tenant_id string, bucket date, y double")
    assert forecast.coverage(f, a).first().coverage == pytest.approx(0.8)
    assert forecast.coverage(f, a, 2).first().coverage == 0.0


@pytest.mark.parametrize(("n_train", "n_recent", "bins"), [(4, 8, 0), (100, 20, 4), (1000, 1000, 10)])
def test_bins_adapt(spark, n_train, n_recent, bins):
    rows = [("k", False, float(i)) for i in range(n_train)] + [("k", True, float(i)) for i in range(n_recent)]
    r = forecast.psi(spark.createDataFrame(rows, "key string, recent boolean, x double")).first()
    assert r.bins == bins and (r.psi is None) == (bins < 2)


def test_status_lattice(spark):
    pairs = spark.createDataFrame([("alarm", "insufficient_data", "alarm"), ("ok", "insufficient_data", "ok"), ("drifting", "ok", "drifting")], "a string, b string, w string")
    assert pairs.where(forecast.worst_status(F.col("a"), F.col("b")) != F.col("w")).count() == 0
