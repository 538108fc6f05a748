"""The quality classifier, the alignment of tokenizers and the audit of filters."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillmere.llm import alignment, filter_audit, quality, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, label int, part string, failed int, bucket int, row long, pair long, n int"
ODD = [
    "", " ", None, "A", "a b", "  two  spaces ", "line\nbreak and\ttab", "it's we'll 12.3 x", "<|endoftext|> is <s> plain </s>", "日本語 テキスト", "▁ mark", "x  y 　z", "é é",
    "aaaa" * 50, "\x00 nul", "🙂🙂 🙂", "word " * 3000, "a\r\nb  c", "tab\t b", "​ x", "ſt ﬁ", "!!! ??? ...", "' 's 't", "a 's b", "1 2 3 44 555", "The The the", "x" * 5000, "ÀÉ ß Ω ы",
]


def rows_of(texts, lang="en"):
    return [(i, t, lang, 0.5, 1, "p", 3, 7, 1, 2, 3) for i, t in enumerate(texts)]


# --- alignment --------------------------------------------------------------------------------------------------


def brute_alignment(rows):
    a_tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    at, vocabulary = alignment.byte_of_character(), {i: t for t, i in a_tok.get_vocab().items()}
    found, docs = [], Counter()
    for doc_id, text in rows:
        own = (" " + (text or "")).encode()
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        a_bytes = [bytes(at[c] for c in vocabulary[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_tok.id_to_piece, b)]
        if not text or b"".join(a_bytes) != own or b"".join(b_bytes) != own:
            found.append((doc_id, None))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        cuts = np.array(sorted({*a_end.tolist()} & {*b_end.tolist()}))
        groups = [([], []) for _ in cuts]
        for side, ids, ends in ((0, a, a_end), (1, b, b_end)):
            for i, g in zip(ids, np.searchsorted(cuts, ends)):
                groups[g][side].append(i)
        pairs = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        docs.update(pairs.keys())
        found.append((doc_id, (len(a), len(b), groups, pairs)))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, one in found:
        if one is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = one
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        best = sum(n for p, n in pairs.items() if docs[p] == most[p[0]])
        out.append((doc_id, n_a, n_b, len(groups), sum(pairs.values()), best, sum(n * docs[p] for p, n in pairs.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def plain(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_alignment_equals_brute_force_on_odd_texts(spark):
    rows = rows_of(ODD) + [(None, "no id", *rows_of([""])[0][2:]), (3, "A", *rows_of([""])[0][2:])]
    frame = spark.createDataFrame(rows, DOCS)
    expected = brute_alignment([r[:2] for r in rows])
    assert plain(alignment.links(frame)) == expected
    # many buckets, and counts joined by a shuffle
    assert plain(alignment.links(frame, bucket_bytes=3000, broadcast_pairs=0)) == expected
    assert alignment.links(frame.limit(0)).count() == 0


def test_alignment_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(queries.op12_token_alignment(spark, SF)) == brute_alignment(rows)


def test_alignment_aligns_each_stretch_of_the_table_once(spark, monkeypatch):
    texts = [" ".join(["the same words", *(["two  spaces"] * (i % 3)), f"number{i % 4}"]) for i in range(40)]
    seen, align = [], alignment.align
    monkeypatch.setattr(alignment, "align", lambda units, *rest: seen.extend(r.text for r in units.select("text").collect()) or align(units, *rest))
    rows = [(i, t, *rows_of([""])[0][2:]) for i, t in enumerate(texts)]
    assert plain(alignment.links(spark.createDataFrame(rows, DOCS), bucket_bytes=100)) == brute_alignment([r[:2] for r in rows])
    assert sorted(seen) == sorted({"the", "same", "words", "two  spaces", *(f"number{i}" for i in range(4))})


def test_alignment_puts_documents_together_in_slices(monkeypatch):
    def mark(i, is_a, cut):
        return 4 * i + 2 * is_a + cut

    marks = [[mark(2, 0, 0), mark(1, 1, 1), mark(3, 0, 1)], [mark(4, 1, 1), mark(5, 0, 1), mark(1, 1, 0), mark(1, 1, 1), mark(3, 0, 1)]]
    stretches = pa.table({"text": ["x", "y"], "marks": pa.array(marks, pa.list_(pa.int32()))})
    docs = pa.table({"bucket": pa.array([7] * 5, pa.int32()), "doc_id": [1, None, 2, 3, 4], "words": [["x", "y", "x"], [""], ["y"], ["x", "unknown"], ["x"]]})

    def digest(groups):
        return hashlib.sha256(groups.encode()).hexdigest()

    x, y, a = "1|2,3", "4|5;1,1|3", 1 << 17
    expected = [
        (1, 5, 6, 4, digest(f"{x};{y};{x}"), {a + 2: 2, a + 3: 4, 4 * a + 5: 1}), (None, 0, 0, 0, "", {}), (2, 3, 2, 2, digest(y), {a + 3: 2, 4 * a + 5: 1}),
        (3, 0, 0, 0, "", {}), (4, 1, 2, 1, digest(x), {a + 2: 1, a + 3: 1}),
    ]
    for words in (1, 3, 1000):
        monkeypatch.setattr(alignment, "SLICE_WORDS", words)
        found = alignment._put_together(docs, stretches).to_pylist()
        assert len({r["row"] for r in found}) == 5
        assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"], {p["pair"]: p["n"] for p in r["links"]}) for r in found] == expected


# --- quality ----------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op11_subword_quality(spark, sf)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    low = [rows[r.doc_id].predicted for r in labels if r.quality == 0]
    good = [rows[r.doc_id].predicted for r in labels if r.quality == 1]
    assert low and good and sum(low) <= 0.2 * len(low) and sum(good) >= 0.97 * len(good)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(rows_of(ODD) + rows_of(["A"]) + [(None, "x", *rows_of([""])[0][2:])], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))] + [(3, None), (5, 7), (None, 1)], "doc_id long, quality int")
    found = quality.judge(docs, labels).collect()
    assert len(found) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id == 2} <= {r.score for r in found if r.doc_id == 0}  # null as empty
    none = quality.judge(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_quality_shares_equal_whole_documents():
    texts = [t or "" for t in ODD] + ["é" * 100 + " a a a"]
    random = np.random.default_rng(0)
    table = random.normal(size=(quality.BUCKETS, 2))
    shares = quality.Shares(table)
    direct = np.array([[*(quality.counts_of(t) @ table), quality.counts_of(t).sum()] for t in texts])
    assert np.allclose(shares.totals(texts), direct)
    quality_limit, quality.REMEMBERED = quality.REMEMBERED, 3
    try:
        assert np.allclose(np.concatenate([shares.totals([t]) for t in texts]), direct)
    finally:
        quality.REMEMBERED = quality_limit


# --- filters ----------------------------------------------------------------------------------------------------


def test_audit_equals_applying_filters_one_by_one(spark):
    long_text = " ".join(f"w{i}" for i in range(120))
    texts = [long_text, long_text, "A B $", None, "", "a " * 150, long_text.upper(), "x y z", long_text + " $", "$" * 3000, long_text]
    rows = [(i, t, [None, "en", "de"][i % 3], 0.1, 0, "p", 3, 7, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "x y z", "en", *rows_of([""])[0][3:]), (2, "A B $", "fr", *rows_of([""])[0][3:])]
    labels = [(0, 1, 0), (1, 1, 1), (10, 1, None), (10, None, 1), (4, 0, 1), (None, 1, 1)]
    found = filter_audit.interactions(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])

    def fails(doc_id, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {k for k, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                                              bool(re.search(r"[#$%&*|]", text)), doc_id is not None and first.get(text, doc_id) < doc_id)) if bad}

    docs = [(r[2] or "", fails(r[0], r[1]), any(x[0] == r[0] is not None and x[1] == 1 for x in labels), any(x[0] == r[0] is not None and x[2] == 1 for x in labels)) for r in rows]
    expected, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, name in enumerate(order):
                out = [d for d in left if name in d[1]]
                redundant = sum(name in d[1] for d in gone)
                left = [d for d in left if name not in d[1]]
                gone += out
                unique = sum(d[0] == part and d[1] == {name} for d in docs)
                expected.append([part, order, step + 1, len(left), len(out), redundant, unique, sum(d[2] for d in out), sum(d[3] for d in out), name])
                shapley[part, name] += len(out)
    expected = sorted((*e[:-1], shapley[e[0], e[-1]]) for e in expected)
    assert sorted(map(tuple, found.collect())) == expected
    empty = filter_audit.interactions(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0 and empty.columns == found.columns


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_exact_dedup", "op13_filter_interactions"])
def test_queries_equal_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = queries.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = connection.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str) == expected


# --- whole licence texts ----------------------------------------------------------------------------------------


def whole_texts():
    from importlib import resources

    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in (resources.files("quillmere.llm") / "license_data").iterdir()}


@pytest.mark.parametrize("size", [100, 2000])
def test_files_inherit_the_right_licence_from_complete_texts(spark, size):
    """Each standard text as X/LICENSE beside a file without a notice, among few and among many other files; some with a copyright line before, as people put them."""
    from quillmere.llm import licenses

    files = []
    for name, text in sorted(whole_texts().items()):
        files += [(f"{name}/LICENSE", text), (f"{name}/src/x.c", "int main() { return 0; }"), (f"{name}-owned/LICENSE", "Copyright (c) 2024 Somebody\n\n" + text), (f"{name}-owned/x.c", "int y;")]
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. */\nint x;"
    files += [("GPL-3.0/other.c", mpl), ("plain/readme", "nothing of the kind"), (None, None), ("plain/empty", "")]
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(size).collect()]
    files += [(f"docs/{i}", t) for i, t in enumerate(docs)]
    frame = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(files)], "file_id long, path string, text string, license string")
    found = {r.path: r for r in licenses.scan(frame).collect()}
    wrong = [(n, found[f"{n}/src/x.c"].license, found[f"{n}/LICENSE"].own_license, found[f"{n}-owned/x.c"].license) for n in whole_texts()
             if not found[f"{n}/src/x.c"].license == found[f"{n}/LICENSE"].own_license == found[f"{n}-owned/x.c"].license == n]
    assert wrong == []
    assert found["GPL-3.0/src/x.c"].inherited_from == "GPL-3.0" and found["GPL-3.0/other.c"].license == "MPL-2.0" and found["plain/readme"].license is found["plain/empty"].license is None
