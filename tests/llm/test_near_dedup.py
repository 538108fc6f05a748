import random
import re
from itertools import combinations

import pytest

from quillmere.llm import near_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[doc] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def run(spark, rows, k=3, percent=85, schema="doc_id long, text string"):
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, schema), k, percent).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


def test_group_of_near_copies_equals_brute_force(spark):
    """A group whose members are alike to different degrees, so that crowded nodes are compared exactly."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = [(i, edited(base, rng.choice([0, 1, 1, 2, 3, 4, 6, 9]), rng)) for i in range(0, 260)]
    rows += [(1000 + i, " ".join(f"x{rng.randrange(3000)}" for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 3, 85)


@pytest.mark.parametrize("levels", [0, 2])
def test_large_nodes_equal_brute_force(spark, monkeypatch, levels):
    """Nodes over LARGE are branched further, and compared in tiles of several blocks and parts where branching ends."""
    monkeypatch.setattr(near_dedup, "LARGE", 12)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "MORE_LEVELS", levels)
    rng = random.Random(8)
    rows = []
    for family in range(3):
        base = [f"w{family}-{rng.randrange(4000)}" for _ in range(120)]
        rows += [(1000 * family + i, edited(base, rng.choice([0, 1, 3, 4, 6, 9, 14]), rng)) for i in range(60)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 3, 85)


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  TWO\n"), (8, "two one"),
        (9, "é É"), (10, "É É"), (11, "a b c d"), (12, "A B C D"), (12, "A B C D"), (13, "w " * 30_000),
    ]
    found = run(spark, rows)
    assert found == brute(rows, 3, 85)
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[5] == (1, 4) and found[10][1] == 10


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == {}
    frame = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, n long, node string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()} == {1: 1, 2: 1}


@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.95])
def test_trees_reach_the_target(threshold):
    trees = near_dedup.trees_for(threshold)
    apart = 0.0
    for _ in range(near_dedup.DEPTH + near_dedup.MORE_LEVELS):
        apart = (1 - threshold * (1 - apart)) ** near_dedup.BRANCHES
    assert apart**trees <= near_dedup.MISS


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(500, 499)]
    found = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 140)} == {100} and found[500] == 499


def test_no_class_goes_to_a_tile_twice(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = [(i, edited(base, rng.choice([0, 1, 3, 6, 9, 14, 20]), rng)) for i in range(80)]
    monkeypatch.setattr(near_dedup, "LARGE", 12)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    seen, frame = [], type(spark.range(1))
    whole = frame.mapInPandas

    def watched(self, *args, **more):
        if "side" in self.columns:
            seen.append((self.count(), self.select("node", "block", "part", "rep").distinct().count()))
        return whole(self, *args, **more)

    monkeypatch.setattr(frame, "mapInPandas", watched)
    assert run(spark, rows) == brute(rows, 3, 85)
    assert seen and all(n == once for n, once in seen)
