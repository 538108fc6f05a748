import datetime as dt
import os
import random
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmere.operators import keys, versions
from quillmere.sources import appendonly, policies


def test_of_two_writers_of_a_version_one_wins_and_the_other_takes_the_next(spark, tmp_path):
    path = str(tmp_path / "ledger")
    frames = [spark.createDataFrame([(f"k{w}-{i}", float(i)) for i in range(3)], "key string, credits double") for w in range(4)]
    numbers, errors = [], []

    def write(frame):
        try:
            numbers.append(appendonly.Ledger(spark, path).append(frame))
        except Exception as raised:  # noqa: BLE001
            errors.append(raised)

    threads = [threading.Thread(target=write, args=(f,)) for f in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ledger = appendonly.Ledger(spark, path)
    assert not errors and sorted(numbers) == [0, 1, 2, 3] and ledger.verify() == 4 and ledger.read().count() == 12 and ledger.read(upto=1).count() == 6
    first = ledger.versions()[0]
    assert ledger._published({**first, "version": 0}) is False  # a version is published once


def test_updates_and_other_columns_are_refused(spark, tmp_path):
    ledger = appendonly.Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(appendonly.Refused):
        ledger.read()
    ledger.append(spark.createDataFrame([("a", None)], "key string, credits double"))
    for refused in (ledger.update, ledger.delete, lambda: ledger.append(spark.createDataFrame([("a",)], "key string"))):
        with pytest.raises(appendonly.Refused):
            refused()
    assert ledger.append(spark.createDataFrame([], "credits double, key string")) == 1 and ledger.verify() == 2


def files(path, version):
    folder = f"{path}/{version['folder']}"
    return [f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".parquet")]


def test_changed_rows_are_named_and_lost_ones_found(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = appendonly.Ledger(spark, path)
    for w in range(2):
        ledger.append(spark.createDataFrame([(f"k{w}", 1.0), (f"l{w}", 2.0)], "key string, credits double").coalesce(1))
    (name,) = files(path, ledger.versions()[1])
    table = pq.read_table(name)
    pq.write_table(table.set_column(1, "credits", pa.array([99.0, 2.0])), name)
    os.remove(os.path.join(os.path.dirname(name), "." + os.path.basename(name) + ".crc"))
    assert [(r.version, r.row) for r in ledger.changed().collect()] == [(1, '{"key":"k1","credits":99.0}')]
    with pytest.raises(appendonly.Tampered, match="version 1, row"):
        ledger.verify()
    pq.write_table(table.slice(1), name)
    with pytest.raises(appendonly.Tampered, match="rows of version 1"):
        ledger.verify()
    pq.write_table(table, name)
    assert ledger.verify() == 2
    os.remove(f"{path}/versions/0000000000.json")
    with pytest.raises(appendonly.Tampered, match="follow"):
        ledger.verify()


def test_views_show_the_sessions_tenant_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "tenant_id string, x int")
    rows.write.parquet(str(tmp_path / "t"))
    policies.guard(spark, spark.read.parquet(str(tmp_path / "t")), "guarded_rows")
    seen = lambda: sorted(r.x for r in spark.sql("SELECT x FROM guarded_rows").collect())
    assert seen() == []
    policies.enter(spark, "a")
    assert seen() == [1, 2] and spark.sql("SELECT count(*) FROM guarded_rows WHERE tenant_id = 'b'").first()[0] == 0
    assert "EqualTo(tenant_id,a)" in spark.sql("SELECT x FROM guarded_rows")._jdf.queryExecution().toString()
    policies.own_rows(spark, rows.where("tenant_id = 'a'")).write.parquet(str(tmp_path / "own"))
    for foreign in ("b", None):
        with pytest.raises(Exception, match="another tenant"):
            policies.own_rows(spark, rows.where(F.col("tenant_id").eqNullSafe(F.lit(foreign)) | (F.col("tenant_id") == "a"))).write.parquet(str(tmp_path / f"foreign-{foreign}"))
    policies.enter(spark, "b")
    assert seen() == [3]
    policies.enter(spark, None)
    assert seen() == []
    with pytest.raises(PermissionError):
        policies.own_rows(spark, rows)
    for bad in ("a' OR '1'='1", "", "x" * 200):
        with pytest.raises(ValueError, match="not a tenant"):
            policies.enter(spark, bad)


def test_a_shredded_tenants_rows_stay_closed_and_others_open(spark):
    old, new = os.urandom(32), os.urandom(32)
    rows = spark.createDataFrame([(t, f"secret {t} {i}") for t in (1, 2, 3) for i in range(2)], "tenant_id int, note string")
    own = keys.issued(rows.select("tenant_id"), old)
    assert own.count() == 3 and own.select("wrapped").distinct().count() == 3
    closed = rows.sparkSession.createDataFrame(keys.seal(rows, "note", own, old).collect(), "tenant_id int, note binary")
    opened = lambda k, master: sorted((r.tenant_id, r.note) for r in keys.unseal(closed, "note", k, master).collect() if r.note)
    everything = sorted(tuple(r) for r in rows.collect())
    assert opened(own, old) == everything and opened(own, new) == []
    turned = keys.rotated(own, old, new)
    assert opened(turned, new) == everything and opened(turned, old) == [] and {r.master_version for r in turned.collect()} == {1}
    with pytest.raises(Exception, match="master key"):
        keys.rotated(own, new, old)
    more = keys.issued(spark.createDataFrame([(3,), (4,), (None,)], "tenant_id int"), new, turned)
    assert more.count() == 4 and opened(more, new) == everything
    left = keys.shredded(more, spark.createDataFrame([(2,)], "tenant_id int"))
    assert opened(left, new) == [r for r in everything if r[0] != 2]
    again = keys.issued(spark.createDataFrame([(2,)], "tenant_id int"), new, left)  # a new key opens nothing of the old one
    assert opened(again, new) == [r for r in everything if r[0] != 2]
    with pytest.raises(Exception, match="no key"):
        keys.seal(rows, "note", left, new).collect()


def test_as_of_equals_plain_loops(spark):
    rng = random.Random(3)
    day = lambda d: None if d is None else dt.date(2026, 1, 1) + dt.timedelta(days=d)
    left = [(rng.choice(["a", "b", None]), day(rng.choice([None, *range(20)])), i) for i in range(80)]
    right = [(rng.choice(["a", "b", "c", None]), day(rng.choice([None, *range(20)])), rng.randrange(5)) for _ in range(30)]
    frames = spark.createDataFrame(left, "k string, at date, i int"), spark.createDataFrame(right, "k string, since date, v int")
    want = []
    for k, at, i in left:
        fits = [(s, v) for kk, s, v in right if k is not None and kk == k and at and s and s <= at]
        want.append((k, at, i, *(max(fits) if fits else (None, None))))
    found = versions.as_of(*frames, ["k"], "at", "since")
    assert found.columns == ["k", "at", "i", "since", "v"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert versions.as_of(frames[0], frames[1].limit(0), ["k"], "at", "since").where("v IS NULL").count() == 80
    with pytest.raises(ValueError, match="both sides"):
        versions.as_of(frames[0], frames[1].withColumnRenamed("v", "i"), ["k"], "at", "since")


def test_versions_are_made_by_changes_only(spark):
    rows = spark.createDataFrame([("a", d, m, 1.0) for d, m in ((1, 1.0), (2, 1.0), (3, 2.0), (4, None), (5, None), (6, 1.0))], "k string, at int, mean double, std double")
    found = versions.changed(rows, ["k"], "at", ["mean", "std"]).orderBy("version").collect()
    assert [(r.valid_from, r.valid_to, r.version, r["mean"]) for r in found] == [(1, 3, 1, 1.0), (3, 4, 2, 2.0), (4, 6, 3, None), (6, None, 4, 1.0)]
    assert found[0].fingerprint == found[3].fingerprint != found[1].fingerprint


def test_gate(spark):
    def losses(model, change, n=20, tenant=lambda i: i % 2):
        return [(model, tenant(i), i, 1.0 + i / 100, None if change(i) is None else 1.0 + i / 100 + change(i)) for i in range(n)]

    rows = losses("better", lambda i: -0.2) + losses("same", lambda i: 0.0) + losses("noisy", lambda i: -5.0 if i == 3 else 0.2) + losses("few", lambda i: -0.5 if i < 7 else None) + losses("none", lambda i: None)
    rows += losses("hard", lambda i: 0.2 if i % 10 == 0 else -0.5, tenant=lambda i: i % 10)
    found = {r.model: r for r in versions.gate(spark.createDataFrame(rows, "model string, tenant_id int, week int, champion double, challenger double")).collect()}
    assert {m: r.reason for m, r in found.items()} == {"better": "better", "same": "no sure gain", "noisy": "no sure gain", "few": "too few pairs", "none": "too few pairs", "hard": "worse for a tenant"}
    assert found["hard"].worst_tenant == 0 and [m for m, r in found.items() if r.promote] == ["better"] and found["few"].pairs == 7
