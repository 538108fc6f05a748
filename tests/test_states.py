import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillmere.operators import chat, text
from quillmere.streaming import chat as chat_stream
from quillmere.streaming import ingest, neighbours


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def batches(tmp_path, name, parts):
    folder = tmp_path / name
    folder.mkdir()
    for i, part in enumerate(parts):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in part))
    return str(folder)


def texts():
    random.seed(4)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(12):
        base = [random.choice(words) for _ in range(80)]
        out.append(" ".join(base))
        for _ in range(random.randrange(4)):
            other = list(base)
            other[random.randrange(80)] = "x"
            out.append(" ".join(other))
    return out + [out[0], out[0], "short", "short", ""]


def test_stream_of_buckets_equals_the_batch_in_any_order(spark, tmp_path):
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    want = {tuple(r) for r in text.near_duplicates(docs).select("doc_id", "canonical").collect()}
    assert len({c for _, c in want}) < len(want)
    for k in range(2):
        random.Random(k).shuffle(rows)
        folder = batches(tmp_path, f"docs{k}", [rows[i::3] for i in range(3)])
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(folder)
        found = ingest.to_memory(neighbours.links(neighbours.indexed(stream)), f"links{k}", timed=True)
        assert {tuple(r) for r in neighbours.classes(docs, found).collect()} == want


def test_bucket_state_from_a_batch(spark, tmp_path):
    every = list(enumerate(texts()))
    docs = spark.createDataFrame(every, "doc_id long, text string")
    want = {tuple(r) for r in text.near_duplicates(docs).select("doc_id", "canonical").collect()}
    old = docs.where("doc_id % 2 = 0")
    folder = batches(tmp_path, "new", [[{"doc_id": i, "text": t} for i, t in every if i % 2]])
    stream = spark.readStream.schema("doc_id long, text string").json(folder)
    found = ingest.to_memory(neighbours.links(neighbours.indexed(stream), neighbours.indexed(old)), "later", timed=True)
    before = text.near_duplicates(old).select(F.col("doc_id").alias("u"), F.col("canonical").alias("v"))
    assert {tuple(r) for r in neighbours.classes(docs, found.unionByName(before)).collect()} == want


FIELDS = "connection_id string, channel_id string, channel_name string, ts string, thread_ts string, user string, text string, subtype string, bot_id string, seq long, at timestamp"


def change(ts, seq, words, thread=None, **more):
    at = (dt.datetime(2026, 1, 1) + dt.timedelta(minutes=seq)).isoformat()
    return {"connection_id": "c", "channel_id": "ch", "channel_name": f"n{seq}", "ts": ts, "thread_ts": thread, "user": "u1", "text": words, "subtype": None, "bot_id": None, "seq": seq, "at": at} | more


CHANGES = [
    change("1.000100", 1, "question"), change("2.000100", 2, "answer", "1.000100"), change("1.000100", 3, "question, edited"), change("3.5", 4, "alone"), change("2.000100", 9, "late edit", "1.000100", user="u2"),
    change("4.0", 5, "joined", subtype="channel_join"), change("5.0", 5, "beep", bot_id="B1"), change("6.0", 6, " x "), change("10.0", 7, "ten", "1.000100"),
]


def test_stream_of_chat_changes_equals_the_batch_fold(spark, tmp_path):
    whole = chat.changes(spark.read.schema(FIELDS).json(batches(tmp_path, "all", [CHANGES])))
    columns = [*chat.KEY, "thread", *chat.CREATED, *chat.RENEWED, "seq"]
    want = {tuple(r) for r in chat.folded(whole).select(*columns).collect()}
    assert {(r[2], r[3], r[6]) for r in want} == {("1.000100", "1.000100", "question, edited"), ("2.000100", "1.000100", "late edit"), ("3.5", "3.5", "alone"), ("10.0", "1.000100", "ten")}
    for k in range(2):
        rows = list(CHANGES)
        random.Random(k).shuffle(rows)
        folder = batches(tmp_path, f"part{k}", [rows[i::3] for i in range(3)])
        stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).json(folder)
        changes = chat.changes(stream.drop("at")) if k else chat.changes(stream)
        changes = changes.withColumn("at", F.timestamp_seconds(F.col("seq") * 60))
        found = chat_stream.latest(ingest.to_memory(chat_stream.folded(changes), f"chat{k}", timed=True))
        assert {tuple(r) for r in found.select(*columns).collect()} == want


def test_quiet_threads_come_out_whole(spark, tmp_path):
    far = change("99.0", 900, "much later")
    folder = batches(tmp_path, "quiet", [CHANGES, [far], [change("100.0", 901, "still later")]])
    stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).json(folder)
    changes = chat.changes(stream).withColumn("at", F.timestamp_seconds(F.col("seq") * 60))
    found = ingest.to_memory(chat_stream.folded(changes, quiet="600", late="1 minute"), "quiet").where("kind = 'thread'").collect()
    batch = {r.thread: (r.n, r.document) for r in chat.threads(chat.folded(chat.changes(spark.createDataFrame([tuple({**c, "at": None}.values()) for c in CHANGES], FIELDS)))).collect()}
    assert {r.thread: (r.changes, r.text) for r in found if r.thread in batch} == batch
    assert batch["1.000100"] == (3, "u1: question, edited\nu2: late edit\nu1: ten")


def test_changed_messages_are_pending_again(spark):
    changed = chat.changes(spark.createDataFrame([tuple({**c, "at": None}.values()) for c in CHANGES], FIELDS))
    stored = chat.folded(changed.where("seq < 3")).select(*chat.KEY, *chat.CREATED, *chat.RENEWED, F.lit("PROCESSED").alias("status"))
    kept = spark.createDataFrame([("c", "ch", "0.1", None, "u9", "old", "U", "n")], ", ".join(f"{c} string" for c in (*chat.KEY, *chat.CREATED, *chat.RENEWED))).withColumn("status", F.lit("PROCESSED"))
    found = {r.message_ts: r for r in chat.merged(changed.where("seq >= 3"), stored.unionByName(kept)).collect()}
    assert {k: r.status for k, r in found.items()} == {"0.1": "PROCESSED", "1.000100": "PENDING", "2.000100": "PENDING", "3.5": "PENDING", "10.0": "PENDING"}
    assert (found["2.000100"].author_id, found["2.000100"].text) == ("u1", "late edit")
    users = spark.createDataFrame([("c", "me")], "connection_id string, user_id string")
    sent = {r.external_id: r for r in chat.payloads(chat.folded(changed), users).collect()}
    assert sent["ch:2.000100"].metadata.is_reply and not sent["ch:1.000100"].metadata.is_reply and sent["ch:3.5"].subject == "#n4" and sent["ch:3.5"].namespace == "me:slack"
