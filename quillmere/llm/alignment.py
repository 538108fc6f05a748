"""Which tokens of two tokenizers stand for the same bytes of a text.

Tokens of A and of B end at byte offsets; where both end, the text is cut, and the tokens between two cuts are a
group. The alignment is relational: tokens are exploded with their places, their lengths summed by windows, and ends met by equality.
A space between two printing characters is a cut under both tokenizers, whatever stands around it, so that each distinct stretch
between such spaces is aligned once for the whole table. Aligned stretches then go to the buckets of documents that hold them, where
Arrow batches put documents together from them.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.llm import support

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")

#: Bytes of text of one bucket, about; a task holds one bucket's texts and aligned stretches (few times that).
BUCKET_BYTES = 12 << 20
#: Small tables are dealt to all cores, but not to buckets below this.
LEAST_BYTES = 1 << 20
#: Stretches that are put together at once, or one document's.
SLICE_WORDS = 50_000
#: Pairs whose counts are broadcast (16 bytes each); beyond that they are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: A space that both tokenizers cut at: the patterns of A attach it to what follows, and no piece of B has a space after another character.
BOUNDARY = r" (?<=[\x21-\x7E\p{L}\p{N}] )(?=[\x21-\x7E\p{L}\p{N}])"
#: Some of these characters; stretches that begin and end with them can be encoded in one call.
_PRINTING = r"[!-~\u00c0-\u024f]"
_SPACE = "▁"
#: Bits of an id in a pair of ids, which is a * 2^17 + b.
_ID_BITS = 17
_FOUND = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<pair: long, n: long>>"
_LINKS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
_FOUND_ARROW = pa.schema([*((x, pa.int64()) for x in ("row", "doc_id", "n_a", "n_b", "n_groups")), ("groups_sha256", pa.string()), ("links", _LINKS)])


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printing Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(others)}}


class Encoder:
    """Ids of stretches, each with a space before it, as both tokenizers see them, and their lengths in bytes."""

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_file)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        at = byte_of_character()
        vocabulary = self._a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(at[c] for c in token) if all(c in at for c in token) else b""
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("pieces with inner spaces: stretches can't be aligned by themselves")
        self._sides = [(encode, parts, np.array([len(x) for x in parts], np.int64)) for encode, parts in ((self._a_ids, a_bytes), (self._b_ids, [self._piece(p) for p in pieces]))]
        if any(len(sizes) > 1 << 17 or sizes.max() >= 1 << 13 for _, _, sizes in self._sides):
            raise ValueError("a vocabulary beyond 2^17 tokens, or tokens of 8,192 bytes, don't fit the numbers that tokens are dealt as")
        self._inner = re.compile(_PRINTING + r"$")
        self._first = re.compile(_PRINTING)

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(_SPACE, " ").encode()

    def _a_ids(self, text: str) -> list[int]:
        return self._a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids

    def _b_ids(self, text: str) -> list[int]:
        return self._b.encode(text, num_threads=1)

    def _whole(self, text: str, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """For A and B the ids of a text with a space before it, their lengths, and how many ids end at or before each of ends; None where a tokenizer changes the text."""
        own, out = b" " + text.encode("utf-8", "surrogatepass"), []
        for encode, parts, sizes in self._sides:
            ids = np.array(encode(text), np.int32)
            size = sizes[ids]
            if not len(ids) or size.min() == 0 or b"".join([parts[i] for i in ids.tolist()]) != own:
                return None
            at = np.cumsum(size)
            upto = np.searchsorted(at, ends, "right")
            if not np.array_equal(at[upto - 1], ends):  # a token spans two stretches: can't be, as both tokenizers cut there
                return None
            out.append((ids, size, upto))
        return out

    def __call__(self, stretches: list[str]) -> tuple[np.ndarray, ...]:
        """Place of the stretch, is_a, id and length of all tokens, in the order of stretches, A's before B's; none where joined bytes differ from space and stretch.

        Stretches that begin and end with printing characters are encoded together, parted by spaces, and by themselves where that fails.
        """
        together = [i for i, s in enumerate(stretches) if self._first.match(s) and self._inner.search(s)]
        blocks = [together] if together else []
        single = sorted({*range(len(stretches))} - {*together})
        rows: list[tuple[np.ndarray, ...]] = []
        while blocks or single:
            block = blocks.pop() if blocks else [single.pop()]
            found = self._whole(" ".join([stretches[i] for i in block]), np.cumsum([1 + len(stretches[i].encode("utf-8", "surrogatepass")) for i in block]))
            if found is None:
                single += block if len(block) > 1 else []
                continue
            for is_a, (ids, size, upto) in zip((True, False), found):
                rows.append((np.repeat(np.array(block), np.diff(upto, prepend=0)), np.full(len(ids), is_a), ids, size.astype(np.int32)))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int32), np.empty(0, np.int32)
        place, is_a, ids, size = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(2 * place + ~is_a, kind="stable")
        return place[order], is_a[order], ids[order], size[order]


_of_worker: dict[tuple[str, str], Encoder] = {}


def _tokens(a_file: str, b_file: str):
    """A column of texts as tokens, A's before B's; none where a tokenizer changes the text. A token is one number: size * 2^18 + id * 2 + (1 for A)."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _of_worker.get((a_file, b_file)) or _of_worker.setdefault((a_file, b_file), Encoder(a_file, b_file))
        for some in batches:
            place, is_a, ids, size = encoder(some.to_pylist())
            counts = np.bincount(place, minlength=len(some))
            offsets = pa.array([0, *np.cumsum(counts).tolist()], pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array((size << 18) + (ids << 1) + is_a.astype(np.int32)))

    return encoded.asNondeterministic()  # so that it isn't moved to where stretches still repeat


def align(units: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, partitions: int = 1) -> DataFrame:
    """Aligns each unit's tokens: text, of, and marks, one number for each token by its end: id * 4 + (2 for A) + (1 where both sides end). Units without tokens have no row.

    units: part (a number), text, which isn't empty and whose space before is left out, and of, which comes back as it is. Tokens are dealt by part.
    """
    # Spark doesn't know that tokens lie as their texts do, and so they are dealt, while a unit is one row.
    tokens = units.select("part", "text", "of", _tokens(a_file, b_file)("text").alias("t")).repartition(partitions, "part")
    # A number that sorts faster than a text; it need only tell units of one part apart.
    tokens = tokens.select(F.monotonically_increasing_id().alias("unit"), "*")
    unit, first = ["unit", "part"], F.col("pos") == 0
    rows = tokens.select(*unit, "text", "of", (F.octet_length("text") + 1).alias("length"), F.posexplode("t").alias("pos", "t"))
    # The first token alone carries the unit's text, so that narrow rows are sorted.
    rows = rows.select(*unit, F.when(first, F.col("text")).alias("text"), F.when(first, F.col("of")).alias("of"), "length", "pos", "t")
    # A's tokens come first and are as long together as the text with its space, and so are B's after them: one running sum gives the ends of both.
    along = Window.partitionBy(*unit).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_a = F.col("t") % 2 == 1
    run = F.sum(F.shiftright("t", 18)).over(along).cast("int")
    ends = rows.select(*unit, "text", "of", (F.col("t") % (1 << 18)).alias("t"), (run - F.when(is_a, 0).otherwise(F.col("length"))).alias("end"))
    # A side has each end once: both sides end where the row before or after, by ends, has an equal end.
    by_end = Window.partitionBy(*unit).orderBy("end")
    met = F.coalesce(F.lag("end").over(by_end) == F.col("end"), F.lit(False)) | F.coalesce(F.lead("end").over(by_end) == F.col("end"), F.lit(False))
    marked = ends.select(*unit, "text", "of", (F.shiftleft("t", 1) + met.cast("int")).alias("mark"))
    return marked.groupBy(*unit).agg(F.max("text").alias("text"), F.first("of", ignorenulls=True).alias("of"), F.collect_list("mark").alias("marks")).select("text", "of", "marks")


def spread(spark: SparkSession, n: int, most: int = 4_096) -> list[int] | None:
    """n numbers that Spark's hash deals to n different partitions; None for many partitions, where even loads matter less than the list."""
    if n > most:
        return None
    labels: dict[int, int] = {}
    for r in spark.range(40 * n).select(F.col("id").cast("int").alias("label")).select("label", F.expr(f"pmod(hash(label), {n})").alias("at")).collect():  # at most 40 * most
        labels.setdefault(r["at"], r["label"])
    return [labels[k] for k in range(n)] if len(labels) == n else None


class Aligned:
    """Aligned stretches of a bucket: numbers of tokens and groups, groups as text (each ended by ;) and linked pairs of each."""

    def __init__(self, marks: pa.ListArray):
        parts = [self._some(marks.slice(i, SLICE_WORDS)) for i in range(0, len(marks), SLICE_WORDS)] or [self._some(marks)]
        self.n_a, self.n_b, self.n_groups, n_pairs, self.pairs = (np.concatenate([p[i] for p in parts]) for i in range(5))
        self.texts = pa.concat_arrays([p[5] for p in parts])
        self.pair_at = np.concatenate([[0], np.cumsum(n_pairs)])

    @staticmethod
    def _some(lists: pa.ListArray) -> tuple[np.ndarray | pa.Array, ...]:
        marks, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        word = np.repeat(np.arange(len(size)), size)
        sides = [(word[on], marks[on] >> 2, marks[on] & 1) for on in (marks & 2 == 2, marks & 2 == 0)]
        (a_word, a_ids, a_cut), (b_word, b_ids, b_cut) = sides
        n_a, n_b = (np.bincount(side[0], minlength=len(size)) for side in sides)
        # Both sides end with a cut: groups are numbered through all stretches, alike on both sides.
        a_group, b_group = (np.cumsum(cut) - cut for _, _, cut in sides)
        n_groups = np.bincount(a_word, weights=a_cut, minlength=len(size)).astype(np.int64)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        ids = pc.cast(pa.array(np.concatenate([a_ids, b_ids])[order]), pa.string())
        tokens = pc.binary_join_element_wise(ids, pa.array([",", "|", ";"]).take(pa.array(np.concatenate([a_cut, 2 * b_cut])[order])), "")
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), tokens), "")
        # Every a of a group with every b of it.
        of_group = np.bincount(b_group, minlength=int(a_cut.sum()))
        times = of_group[a_group]
        before = np.cumsum(times) - times
        at = np.repeat((np.cumsum(of_group) - of_group)[a_group] - before, times) + np.arange(times.sum())
        pairs = (np.repeat(a_ids.astype(np.int64), times) << _ID_BITS) | b_ids[at]
        n_pairs = np.bincount(a_word, weights=times, minlength=len(size)).astype(np.int64)
        return n_a.astype(np.int32), n_b.astype(np.int32), n_groups.astype(np.int32), n_pairs, pairs, pc.cast(texts, pa.large_string())

    def links(self, doc: np.ndarray, word: np.ndarray, n_docs: int) -> pa.ListArray:
        """For each document its different pairs with their numbers of occurrences; word is a stretch of doc."""
        n = self.pair_at[word + 1] - self.pair_at[word]
        at = np.repeat(self.pair_at[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.sort((np.repeat(doc, n) << 2 * _ID_BITS) | self.pairs[at])
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        times, key = np.diff(begins, append=len(key)), key[begins]
        found = pa.StructArray.from_arrays([pa.array(key & ((1 << 2 * _ID_BITS) - 1)), pa.array(times, pa.int64())], ["pair", "n"])
        per_doc = np.bincount(key >> 2 * _ID_BITS, minlength=n_docs)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), found)


def _put_together(docs: pa.Table, stretches: pa.Table) -> pa.Table:
    """Documents of a bucket (doc_id, words) from the aligned stretches of that bucket."""
    _of_worker.clear()  # tokenizers aren't used here
    out, row, bucket = [_FOUND_ARROW.empty_table()], 0, docs["bucket"][0].as_py() if len(docs) else 0
    doc_ids, lists = docs["doc_id"].combine_chunks(), docs["words"].chunks
    known = stretches["text"].combine_chunks()
    found = pc.index_in(pa.chunked_array([x.flatten() for x in lists], pa.string()), value_set=known)
    place = pc.fill_null(found, -1).to_numpy()
    at = np.concatenate([[0], *(x.value_lengths().to_numpy(zero_copy_only=False) for x in lists)]).cumsum()
    n_docs = len(docs)
    aligned = Aligned(stretches["marks"].combine_chunks())
    while row < n_docs:
        upto = min(max(row + 1, int(np.searchsorted(at, at[row] + SLICE_WORDS, "right")) - 1), n_docs)
        n, word = upto - row, place[at[row] : at[upto]]
        doc = np.repeat(np.arange(n), np.diff(at[row : upto + 1]))
        none = np.zeros(n, bool)
        none[doc[word < 0]] = True
        doc, word = doc[~none[doc]], word[~none[doc]]
        per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int64)
        counts = [np.concatenate([[0], np.cumsum(x[word], dtype=np.int64)])[per_doc] for x in (aligned.n_a, aligned.n_b, aligned.n_groups)]
        groups = aligned.texts.take(pa.array(word))  # of a document one after the other
        ends, held = np.frombuffer(groups.buffers()[1], np.int64)[per_doc], memoryview(groups.buffers()[2] or b"")
        digests = [hashlib.sha256(held[i : j - 1]).hexdigest() if j > i else "" for i, j in itertools.pairwise(ends.tolist())]
        columns = [pa.array((bucket << 32) + np.arange(row, upto)), doc_ids.slice(row, n), *(pa.array(np.diff(x)) for x in counts), pa.array(digests, pa.string()), aligned.links(doc, word, n)]
        out.append(pa.Table.from_arrays(columns, schema=_FOUND_ARROW))
        row = upto
    return pa.concat_tables(out)


def document_groups(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For every row of docs: row (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256 and links (pair, n), as a written table.

    Null and empty texts, and texts that a tokenizer changes, have zeros, '' and no links. Rows are told apart by their numbers,
    so that repeated rows and null doc_ids are documents of their own.
    """
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_BYTES)))
    labels = spread(spark, buckets)

    def dealt_by(*of: str | Column) -> Column:
        number = F.pmod(F.xxhash64(*of), F.lit(buckets)).cast("int")
        return F.element_at(F.array(*map(F.lit, labels)), number + 1) if labels else number

    dealt = docs.select(dealt_by("doc_id", text).alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    stretches = F.split("text", BOUNDARY)
    wanted = dealt.select("bucket", "text").repartition(buckets, "bucket").select("bucket", F.explode(stretches).alias("text")).where("text != ''").distinct()
    # Each stretch of the whole table is aligned once, and goes to the buckets that hold it.
    units = wanted.select(dealt_by("text").alias("part"), "text", "bucket").repartition(buckets, "part").groupBy("part", "text").agg(F.collect_list("bucket").alias("of"))
    # Lists are made from the order that windows leave; what was shuffled for the stretches goes before documents are.
    settings = {"spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        aligned = support.materialise(align(units, a_file, b_file, buckets), "stretches", "zstd")
        there = aligned.select(F.explode("of").alias("bucket"), "text", "marks").repartition(buckets, "bucket")
        parts = dealt.repartition(buckets, "bucket").select("bucket", "doc_id", stretches.alias("words"))
        found = support.materialise(parts.groupBy("bucket").cogroup(there.groupBy("bucket")).applyInArrow(_put_together, _FOUND), "aligned", "zstd")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    support.discard(aligned)
    return found


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, docs (rows of found that hold it linked) and best (no pair of its A id is in more), as a written table."""
    each = found.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = support.materialise(each, "pairs")
    a_id = F.shiftright("pair", _ID_BITS).alias("a")
    most = counts.groupBy(a_id).agg(F.max("docs").alias("most"))  # a row for each id of A's vocabulary at most
    return support.materialise(counts.select("*", a_id).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counted")


def links(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, bucket_bytes: int = BUCKET_BYTES, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text; further columns are left out).

    n_links are all pairs of occurrences in a common group, n_best those of them whose pair of ids is in as many documents as any of its A
    id, count_sum the sum of these numbers of documents. Of an empty table nothing comes back.
    """
    found = document_groups(docs, a_file, b_file, bucket_bytes)
    counts = pair_counts(found)
    each = found.select("row", F.inline("links"))
    if counts.count() <= broadcast_pairs:
        weighed = each.join(F.broadcast(counts), "pair")
    else:  # each document's equal pairs are one row; pairs in many documents are broadcast
        weighed = support.join_counted(each.groupBy("row", "pair").agg(F.sum("n").alias("n")), counts, "pair", "docs", found.count())
    sums = weighed.groupBy("row").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")
    )
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_links", "n_best", "count_sum")]
    return found.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *zero, "groups_sha256")
