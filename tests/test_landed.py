import base64
import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmere.operators import mail, uploads, wiki
from quillmere.sources import staging, vectors


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def part(mime, body=None, parts=None):
    return {"mimeType": mime} | ({"body": {"data": b64(body) if isinstance(body, str) else body}} if body is not None else {}) | ({"parts": parts} if parts else {})


def walk(tree, mime):
    own = base64.urlsafe_b64decode(tree["body"]["data"] + "==").decode() if tree["mimeType"] == mime and "body" in tree else ""
    return own + "".join(walk(p, mime) for p in tree.get("parts", []))


TREE = part("multipart/mixed", None, [
    part("text/plain", "é one "), part("multipart/alternative", None, [part("text/html", "<i>"), part("multipart/related", None, [part("text/plain", "??>>two "), part("text/html", "<b>")])]), part("text/plain", "three"),
])


def landed(spark, messages):
    return mail.rows(spark.createDataFrame([("c", i, m if isinstance(m, str) or m is None else json.dumps(m)) for i, m in enumerate(messages)], "connection_id string, seq long, message string"))


def message(i, tree, **more):
    return {"id": i, "threadId": "t", "labelIds": ["INBOX"], "snippet": "s", "payload": tree | {"headers": [{"name": "SUBJECT", "value": "Hi"}, {"name": "from", "value": "a@b.c"}, {"name": "Date", "value": "5 Jan 2026 09:00 +0000"}]}} | more


def test_bodies_are_joined_in_the_order_of_a_walk(spark):
    deep = part("text/plain", "x")
    for _ in range(6):
        deep = part("multipart/mixed", None, [deep, part("text/plain", "y")])
    found = {r.message_id: r for r in landed(spark, [message("m1", TREE), message("m2", part("text/html", "only")), message("m3", deep), {"id": "m4"}, "no json", None, {"snippet": "no id"}, message("m5", part("text/plain", {"data": "*"}))]).collect()}
    assert set(found) == {"m1", "m2", "m3", "m4", "m5"}
    assert (found["m1"].body_text, found["m1"].body_html) == (walk(TREE, "text/plain"), walk(TREE, "text/html")) == ("é one ??>>two three", "<i><b>")
    assert (found["m2"].body_text, found["m2"].body_html, found["m2"].subject, found["m2"].sender) == (None, "only", "Hi", "a@b.c")
    assert found["m3"].body_text == "xyyyyyy" and found["m4"].body_text is found["m4"].subject is None and found["m5"].body_text is None


def test_messages_are_parsed_once(spark, monkeypatch):
    plans, write = [], staging.written
    monkeypatch.setattr(staging, "written", lambda frame, name: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or write(frame, name))
    rows = landed(spark, [message("m1", TREE)])
    assert [r.body_html for r in rows.collect()] == ["<i><b>"]
    plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.lower().count("parse_json") + p.count("parseJson") for p in plans) == 1


def test_later_landings_change_labels_and_snippet_only(spark):
    first, later = message("m1", TREE), message("m1", part("text/plain", "changed"), labelIds=["READ"], snippet="new")
    rows = landed(spark, [first, later])
    one = mail.merged(rows).collect()
    assert len(one) == 1 and (one[0].labels, one[0].snippet, one[0].status, one[0].body_text) == (["READ"], "new", "PENDING", "é one ??>>two three")
    stored = mail.merged(rows).withColumn("status", F.lit("PROCESSED"))
    again = mail.merged(landed(spark, [message("m1", TREE, labelIds=[], snippet=None), message("m2", part("text/plain", ""))]), stored).collect()
    assert {(r.message_id, r.status, tuple(r.labels), r.snippet) for r in again} == {("m1", "PROCESSED", (), None), ("m2", "PENDING", ("INBOX",), "s")}
    users = spark.createDataFrame([("c", "u")], "connection_id string, user_id string")
    queued = mail.payloads(rows, mail.merged(rows), users).collect()  # one for each message, changed or not
    assert [(r.external_id, r.author, r.content, r.namespace, r.timestamp) for r in queued] == [("m1", "a@b.c", "é one ??>>two three", "u:gmail", "2026-01-05T09:00:00Z")]
    assert mail.merged(rows.limit(0)).count() == 0


def test_failed_points_are_those_that_the_store_refused_and_a_second_run_mends_them(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [(f"c{i}", [float(i), 1.0], None) for i in range(250)] + [("c7", [7.0, 1.0], None), ("null", None, ""), ("nan", [float("nan")], ""), ("short", [1.0], ""), ("zero", [0.0, 0.0], "p")]
    points = spark.createDataFrame(rows, "chunk_id string, vector array<double>, payload string")
    planted = {f"c{i}" for i in range(0, 250, 9)}
    first = vectors.sent(points, lambda: vectors.TableSink(path, 1, lambda c: "busy" if c in planted else None), dimensions=2)
    errors = {r.chunk_id: r.error for r in first.collect()}
    assert len(errors) == 254 and {c for c, e in errors.items() if e == "busy"} == planted and {c for c, e in errors.items() if e == "not a vector"} == {"null", "nan", "short"}
    assert vectors.contents(spark, path).count() == 251 - len(planted)
    vectors.sent(points, lambda: vectors.TableSink(path, 1, lambda c: "busy" if c in planted else None), dimensions=2)  # the same run again
    assert vectors.contents(spark, path).count() == 251 - len(planted)
    second = vectors.sent(points.join(first.where("error = 'busy'").select("chunk_id"), "chunk_id"), lambda: vectors.TableSink(path, 2), dimensions=2)
    assert second.where("error IS NOT NULL").count() == 0 and second.count() == len(planted)
    found = {r.chunk_id: r for r in vectors.contents(spark, path).collect()}
    assert len(found) == 251 and all(abs(sum(x * x for x in r.vector) - 1) < 1e-12 for c, r in found.items() if c != "zero") and found["zero"].vector == [0.0, 0.0]


class Broken:
    def upsert(self, points: pd.DataFrame) -> dict[str, str]:
        if "c3" in set(points["chunk_id"]):
            raise ConnectionError("lost")
        return {}


def test_a_call_that_raises_fails_its_points_alone(spark):
    points = spark.createDataFrame([(f"c{i}", [1.0], None) for i in range(10)], "chunk_id string, vector array<double>, payload string").repartition(1)
    found = {r.chunk_id: r.error for r in vectors.sent(points, Broken, size=5).collect()}
    assert len(found) == 10 and sum(e is not None for e in found.values()) == 5 and found["c3"] == "ConnectionError: lost"


def pages(spark, *rows):
    return spark.createDataFrame([("c", p, dt.datetime(2026, 1, day), p.upper(), None, body, None, "a", None, "clash") for p, day, body in rows],
                                 "connection_id string, page_id string, edited_at timestamp, title string, properties string, body string, comments string, author string, url string, status string")


def shown(store):
    return {(r.page_id, r.edited_at.day, r.document, r.status) for r in store.pages().collect()}, [r.cursor.day for r in store.cursors().collect()]


def test_a_killed_wiki_batch_run_again_gives_equal_tables_and_cursor(spark, tmp_path):
    first = pages(spark, ("a", 1, "the first text of a"), ("b", 2, "the first text of b"), ("b", 1, "an older listing"), ("c", 3, "short"))
    second = pages(spark, ("a", 1, "the first text of a"), ("b", 4, "the second text of b"), ("d", 5, None))
    whole, killed = wiki.Store(spark, str(tmp_path / "whole")), wiki.Store(spark, str(tmp_path / "killed"))
    assert whole.cursors().count() == whole.pages().count() == 0

    def die():
        raise KeyboardInterrupt

    for batch, listed in enumerate((first, second)):
        whole.sync(batch, listed)
        with pytest.raises(KeyboardInterrupt):
            killed.sync(batch, listed, before_commit=die)
        assert killed.last() == batch - 1
        assert killed.sync(batch, listed) and not killed.sync(batch, listed)
    assert shown(whole) == shown(killed) == ({("a", 1, "# A\n\nthe first text of a", "PENDING"), ("b", 4, "# B\n\nthe second text of b", "PENDING")}, [4])
    assert [r.page_id for r in killed.to_queue(1).collect()] == ["b"]
    again = pages(spark, ("b", 4, "unchanged"), ("a", 2, "older than the cursor"))
    assert whole.sync(2, again) and whole.to_queue(2).count() == 0 and shown(whole) == shown(killed)
    with pytest.raises(ValueError, match="is next"):
        whole.sync(9, again)
    assert [r.skipped for r in wiki.changed_pages(pages(spark, ("b", 4, "x")), whole.pages(), whole.cursors().limit(0)).collect()] == ["unchanged"]


def test_uploads_of_a_folder(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    for name, content in {"plain.txt": "hello  there".encode(), "café +1.md": "naïve – “q”".encode("cp1252"), "blank.txt": b" \n ", "scan.pdf": b"%PDF", "run.exe": b"MZ", "none.csv": b"", "copy.txt": "hello  there".encode()}.items():
        (folder / name).write_bytes(content)
    rows = {r.name: r for r in uploads.uploaded(uploads.landed(spark, str(folder), "u1")).collect()}
    assert {n: (r.status, r.error) for n, r in rows.items()} == {
        "plain.txt": ("QUEUED", None), "copy.txt": ("QUEUED", None), "café +1.md": ("QUEUED", None), "blank.txt": ("FAILED", uploads.NO_TEXT), "scan.pdf": ("FAILED", uploads.UNREADABLE), "run.exe": ("REFUSED", "unsupported"),
    }
    assert rows["plain.txt"].text == "hello there" and rows["café +1.md"].text == "naïve – “q”"
    assert rows["run.exe"].storage_key is None and rows["plain.txt"].storage_key.split("/")[1] == rows["copy.txt"].storage_key.split("/")[1] and rows["scan.pdf"].storage_key.startswith("u1/")
    empty = uploads.uploaded(spark.createDataFrame([("u1", "none.csv", bytearray()), ("u1", "none.txt", None), ("u1", None, bytearray(b"x"))], "user_id string, name string, content binary")).collect()
    assert [(r.status, r.error) for r in empty] == [("REFUSED", "empty"), ("REFUSED", "empty"), ("REFUSED", "unsupported")]
    sent = uploads.payloads(uploads.uploaded(uploads.landed(spark, str(folder), "u1"))).collect()
    assert len(sent) == 3 and {r.namespace for r in sent} == {"u1:upload"}
