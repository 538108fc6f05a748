"""Knowledge blocks: fuzzy subjects, reconciliation with what is known, telemetry, and attribution of work to people."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.sources import staging

#: Words that don't tell subjects apart.
STOP_WORDS = "the a an and or of to in on for with is are was were be by at from that this it as".split()


def subject_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def same_subject(a: Column, b: Column) -> Column:
    """Overlap by the smaller set; by the union if that has fewer than two words."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least < 2, jaccard(a, b)).otherwise(F.size(F.array_intersect(a, b)) / least)


#: Bytes of title words in a block of titles, of one type; types of over LEAST_BLOCKS MB have as many blocks at least, for as many tasks.
BLOCK_BYTES, LEAST_BLOCKS = 32 << 20, 4
#: Pairs that a task holds at once, and bits that stand for a title's words.
HITS, BITS = 1 << 20, 512


class _Titles:
    """Titles of one side of a tile: the codes of each one's words, its size and bits, and where each word is found."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, n_words: int):
        self.codes, self.sizes = codes, sizes
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(codes, kind="stable")
        self.found, self.counts = self.row[order], np.bincount(codes, minlength=n_words)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.bits = np.zeros((len(sizes), BITS // 64), np.uint64)
        np.bitwise_or.at(self.bits, (self.row, codes % BITS // 64), np.uint64(1) << (codes % 64).astype(np.uint64))

    def prefix(self, other: _Titles, subject: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and words: so many of each title's words, the other side's rarest, that no title can share ``subject`` of them without one of these."""
        order = np.lexsort((other.counts[self.codes], self.row))
        place = np.arange(len(order)) - np.repeat(self.start[:-1], self.sizes)
        least = np.ceil(subject * self.sizes - 1e-6).astype(np.int64)
        taken = place < np.repeat(self.sizes - least + 1, self.sizes)
        return self.row[order[taken]], self.codes[order[taken]]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of n from start, one range after another."""
    return np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def _first_like(new: _Titles, old: _Titles, subject: float) -> np.ndarray:
    """For each new title the first old one with the same subject, as same_subject() has it; len(old.sizes) where there is none.

    Pairs meet in the smaller title's rarest words, HITS at a time. Where a title's bits miss in the other's, so many of its words do at least;
    what these leave is compared by all words, first those that come first.
    """
    best = np.full(len(new.sizes), len(old.sizes))

    def compared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        own = new.sizes[i]
        # The words of each pair's new title as numbers with the pair, looked up among those of its old one.
        pair = np.arange(len(i), dtype=np.int64)
        width = np.int64(len(new.counts))
        left = np.repeat(pair, own) * width + new.codes[_ranges(new.start[i], own)]
        right = np.repeat(pair, old.sizes[j]) * width + old.codes[_ranges(old.start[j], old.sizes[j])]
        at = np.minimum(np.searchsorted(right, left), len(right) - 1)
        common = np.bincount(np.repeat(pair, own)[right[at] == left], minlength=len(i))
        least = np.minimum(own, old.sizes[j])
        return np.where(least < 2, common / (own + old.sizes[j] - common), common / least) >= subject

    def take(i: np.ndarray, j: np.ndarray) -> None:
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        once = np.ones(len(i), bool)
        once[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        i, j = i[once], j[once]
        some = 1
        while len(i):  # the first of each new title, then twice as many, until one is like it
            begins = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            now = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i)))) < some
            of_i, of_j = i[now], j[now]
            words = np.cumsum(new.sizes[of_i] + old.sizes[of_j])
            cuts = np.searchsorted(words, np.arange(4 * HITS, words[-1], 4 * HITS))
            for x, y in zip(np.split(of_i, cuts), np.split(of_j, cuts)):
                if len(x):
                    like = compared(x, y)
                    np.minimum.at(best, x[like], y[like])
            i, j = i[~now], j[~now]
            open_ = j < best[i]
            i, j, some = i[open_], j[open_], 2 * some

    # Old titles that are smaller first, in their order, so that new ones that have found theirs are left out.
    for probe, other, from_new in ((old, new, False), (new, old, True)):
        rows, words = probe.prefix(other, subject)
        hits = np.cumsum(other.counts[words])
        cuts = np.searchsorted(hits, np.arange(HITS, hits[-1] if len(hits) else 0, HITS))
        for r, w in zip(np.split(rows, cuts), np.split(words, cuts)):
            n = other.counts[w]
            p, o = np.repeat(r, n), other.found[_ranges(other.first[w], n)]
            i, j = (p, o) if from_new else (o, p)
            fits = (j < best[i]) & ((probe.sizes[p] <= other.sizes[o]) if from_new else (probe.sizes[p] < other.sizes[o]))
            p, o, i, j = p[fits], o[fits], i[fits], j[fits]
            missing = np.zeros(len(p), np.int64)
            for k in range(BITS // 64):
                missing += np.bitwise_count(probe.bits[p, k] & ~other.bits[o, k])
            enough = probe.sizes[p] - missing >= subject * probe.sizes[p] - 1e-6
            take(i[enough], j[enough])
    return best


def _tile_matches(new: pa.Table, old: pa.Table, subject: float, columns: list[str]) -> pa.Table:
    """title_key of new titles and k of the first known one like it in a tile; titles are words parted by spaces."""
    old = old.take(pc.sort_indices(old, [("recency", "ascending"), ("known_id", "ascending")], null_placement="at_start"))
    lists = [pc.split_pattern(t["words"].combine_chunks(), " ") for t in (new, old)]
    codes = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    n, numbers = len(codes.dictionary), codes.indices.to_numpy().astype(np.int64)
    # Sorted by title and code, as titles are looked up among one another.
    sides, at = [], 0
    for x in lists:
        sizes = pc.list_value_length(x).to_numpy().astype(np.int64)
        own = numbers[at : at + sizes.sum()]
        at += len(own)
        sides.append(_Titles(own[np.lexsort((own, np.repeat(np.arange(len(sizes)), sizes)))], sizes, n))
    best = _first_like(*sides, subject)
    has = best < len(old)
    found = old.take(best[has])
    return pa.table({"title_key": new["title_key"].filter(has), **{c: found[c] for c in columns}})


def reconcile(candidates: DataFrame, known: DataFrame, subject: float = 0.6, same: float = 0.85) -> DataFrame:
    """id, action, known_id: skip, update or create, by the first known block of the type with that subject.

    Both have id, type, title and body, known also recency (smaller is first). Titles of the same words are one. The titles of a type are dealt
    out in blocks of BLOCK_BYTES, and each block of new ones meets each of known ones in one task, which gives the first match of each new title alone: pairs
    are many, as titles share words, but none is written. A candidate without title words can match nothing. Bodies are compared with the chosen block's alone.
    """
    def titled(frame: DataFrame) -> DataFrame:
        words = frame.withColumn("words", F.array_join(F.array_sort(subject_tokens(F.col("title"))), " ")).drop("title", "body")
        words = staging.written(words, "titles").where("words <> '' AND type IS NOT NULL")  # written, so that words are taken once
        return words.withColumn("title_key", F.unhex(F.sha2(F.concat_ws("\n", "type", "words"), 256)))

    c = titled(candidates).select("id", "type", "title_key", "words")
    new = c.groupBy("title_key").agg(F.first("type").alias("type"), F.first("words").alias("words"))
    # Of the known blocks with a title the first by recency stands for all.
    old = titled(known).groupBy("title_key").agg(F.first("type").alias("type"), F.first("words").alias("words"), F.min(F.struct("recency", F.col("id").alias("known_id"))).alias("k"))
    new, old = staging.written(new, "new-titles"), staging.written(old, "known-titles")
    bytes_ = F.sum(F.octet_length("words"))
    blocks = lambda side, name: side.groupBy("type").agg(F.greatest(F.ceil(bytes_ / BLOCK_BYTES), F.least(F.ceil(bytes_ / (1 << 20)), F.lit(LEAST_BLOCKS))).cast("int").alias(name))
    of_type = staging.written(blocks(new, "xs").join(blocks(old, "ys"), "type"), "blocks")

    def dealt(side: DataFrame, own: str, other: str, *rest: str) -> DataFrame:
        """Each title in its block, once for each block of the other side."""
        block, every = F.pmod(F.xxhash64("title_key"), F.col(own + "s")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1)).alias(other)
        return side.join(of_type, "type").select("type", block, every, "words", *rest)

    tile = ["type", "x", "y"]
    left, right = dealt(new, "x", "y", "title_key"), dealt(old, "y", "x", "k.recency", "k.known_id")
    kinds = dict(right.dtypes)
    matches = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        lambda a, b: _tile_matches(a, b, subject, ["recency", "known_id"]), f"title_key binary, recency {kinds['recency']}, known_id {kinds['known_id']}"
    )
    chosen = staging.written(matches.groupBy("title_key").agg(F.min(F.struct("recency", "known_id")).alias("k")).select("title_key", "k.known_id"), "chosen")
    first = staging.written(c.select("id", "title_key").join(chosen, "title_key").select("id", "known_id"), "first")
    # Whole texts move, which are smaller than their words: a candidate's twice, a known one's once.
    own = first.join(candidates.select("id", "body"), "id").join(known.select(F.col("id").alias("known_id"), F.col("body").alias("known_body")), "known_id")
    said = own.select("id", "known_id", subject_tokens(F.col("body")).alias("b"), subject_tokens(F.col("known_body")).alias("kb"))
    found = said.select("id", "known_id", F.when(jaccard(F.col("b"), F.col("kb")) >= same, "skip").otherwise("update").alias("action"))
    return candidates.select("id").join(found, "id", "left").select("id", F.coalesce("action", F.lit("create")).alias("action"), "known_id")


def merged_lists(of: Column, same: float = 0.6, most: int = 12) -> Column:
    """Of an array of candidates (structs with id, type, title, confidence) the most confident of each subject and type, at most ``most``: taken one after another.

    Of equal subjects of a type only the first can be taken; candidates without subject words are like nothing.
    """
    last = lambda r: r["confidence"].isNull() | F.isnan(r["confidence"].cast("double"))
    ordered = F.array_sort(F.transform(of, lambda r: F.struct(last(r).alias("last"), (-r["confidence"]).alias("by"), r["id"].alias("id"), r.alias("r"))))

    @F.pandas_udf("array<boolean>")
    def kept(kinds: pd.Series, words: pd.Series) -> pd.Series:
        def take(kinds: list[str], words: list[str]) -> list[bool]:
            out, taken, seen, n = [False] * len(kinds), {}, set(), 0
            for i, (kind, joined) in enumerate(zip(kinds, words)):
                own = frozenset(joined.split())
                if own and (kind, own) in seen:
                    continue
                seen.add((kind, own))
                for k in taken.get(kind, ()):
                    least = min(len(own), len(k))
                    if (len(own & k) / least if least >= 2 else float(bool(own) and own == k)) >= same:
                        break
                else:
                    out[i] = True
                    n += 1
                    taken.setdefault(kind, []).append(own)
                    if n == most:
                        break
            return out

        return pd.Series([None if k is None else take(k, w) for k, w in zip(kinds, words)], dtype=object)

    said = lambda x: F.coalesce(F.array_join(subject_tokens(x["r"]["title"]), " "), F.lit(""))
    found = kept(F.transform(ordered, lambda x: x["r"]["type"]), F.transform(ordered, said))
    # A lambda that indexed the whole array would sort it again for each candidate.
    return F.filter(F.zip_with(ordered, found, lambda x, taken: F.when(taken, x["r"])), lambda r: r.isNotNull())


def merged_candidates(candidates: DataFrame, same: float = 0.6, most: int = 12) -> DataFrame:
    """merged_lists() of each document's candidates: doc_id, id, type, title, confidence and what else they have."""
    staging.small_batches(candidates.sparkSession)
    rest = [c for c in candidates.columns if c != "doc_id"]
    lists = candidates.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("of"))
    return lists.select("doc_id", F.explode_outer(merged_lists(F.col("of"), same, most)).alias("r")).where("r IS NOT NULL").select("doc_id", "r.*").select(*candidates.columns)


def counts_by_type(frame: DataFrame, kind: str, at: str, now: Column) -> DataFrame:
    """All of a snapshot's counts in one pass: total, last quarter of an hour, last seven days, and the newest time, by type."""
    age = now.cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")
    return frame.groupBy(kind).agg(
        F.count("*").alias("total"), F.count_if((age >= 0) & (age < 900)).alias("last_15m"), F.count_if((age >= 0) & (age < 604800)).alias("last_7d"), F.max(at).alias("newest")
    )


def connector_state(error: Column, connections: Column, syncing: Column, minutes: Column) -> Column:
    return F.when(error, "error").when(connections == 0, "idle").when(syncing | (minutes < 15), "active").when(minutes < 60, "live").otherwise("idle")


def recent(frame: DataFrame, key: str, at: str, tie: str, n: int = 3) -> DataFrame:
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))).where(F.col("rank") <= n)


def attribution(work: DataFrame) -> DataFrame:
    """name, items, sources, owns of rows name, title, source, owns: a person whatever the case of the name, most evidence first."""
    return work.groupBy(F.lower("name").alias("key")).agg(
        F.min("name").alias("name"), F.count_distinct("title").alias("items"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("owns").alias("owns")
    )
