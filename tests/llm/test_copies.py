"""Exact, near and passage duplicates against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.components import _sized, _stars, components
from corvane.llm.exact_dedup import ExtendibleIndex, classes, drop_exact_copies, exact_dedup, index_keys, read_index
from corvane.llm.jaccard_join import _Region, drop_near_copies, near_groups, region_edges
from corvane.llm.suffix_dedup import repeated_passages

KIND = "doc_id long, text string"


def words(rng, n, kinds=4000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def corpus(seed):
    rng = random.Random(seed)
    rows, passage = [], " ".join(words(rng, 60))
    for i in range(60):
        base = words(rng, rng.randrange(1, 150))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(copy) // 25) + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
        if i % 9 == 0:
            rows.append((len(rows), " ".join(words(rng, 20)) + " " + passage + " " + " ".join(words(rng, 5))))
    return rows


def brute_classes(rows):
    def kept(t):
        return min((i for i, x in rows if x == t and i is not None), default=None)

    return sorted(((i, i if t is None else kept(t), 1 if t is None else sum(x == t for _, x in rows)) for i, t in rows), key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (0, "a"), (5, None), (6, None), (7, ""), (8, ""), (None, "b"), (3, "a"), (9, "long " * 200_000), (4, "long " * 200_000), (None, "c"), (None, "c"), (None, None)]


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_against_brute_force(spark, bits):
    df = spark.createDataFrame(ROWS + [(100 + i, f"t{i % 40}") for i in range(90)], KIND)
    key = None if bits == 64 else F.xxhash64("text").bitwiseAND(F.lit(1))  # nearly all texts share a key
    got = sorted(map(tuple, exact_dedup(df, key=key, capacity=4).collect()), key=str)
    assert got == brute_classes([tuple(r) for r in df.collect()])


def test_exact_hot_text_in_many_tasks(spark):
    df = spark.range(0, 3000, 1, 12).selectExpr("2999 - id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id % 1000) end as text", "1 as key")
    got = exact_dedup(df).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes([(r.doc_id, r.text) for r in df.collect()])
    left = drop_exact_copies(df).collect()
    assert len(left) == len({r.text for r in df.collect()}) and {r.doc_id for r in left} == {r.keep_id for r in got}


def test_owners_ask_the_index(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i % 7}", i) for i in range(30)], "text string, id long").select(F.xxhash64("text").alias("key"), "text", "id")
    repeated = index_keys(rows, f"file://{tmp_path}/i", 2)
    assert classes(rows, repeated, f"file://{tmp_path}/i").count() == 7
    for f in (tmp_path / "i").glob("owner-*"):
        f.unlink()
    with pytest.raises(Exception, match="lacks a key"):
        classes(rows, repeated, f"file://{tmp_path}/i").collect()


def test_exact_drop_keeps_columns(spark):
    kind = "text string, doc_id long, key_of_text string, Owner_Of_Key int, `a.b` array<int>"
    rows = [("a", 2, "k", 1, [1]), ("a", 1, None, None, None), (None, None, "z", 3, []), (None, None, "z", 3, [])]
    df = spark.createDataFrame(rows, kind)
    out = drop_exact_copies(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1, None, None, None), *rows[2:]], key=str)


@pytest.mark.parametrize("capacity", [1, 3, 64])
def test_extendible_index(capacity):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    keys[100:140] = keys[0]
    index = ExtendibleIndex(capacity)
    for a in range(0, 500, 77):
        index.add(keys[a : a + 77], np.full(len(keys[a : a + 77]), 2))
    index = ExtendibleIndex.of(index.table())
    at = index.find(keys)
    assert max(map(len, index.keys)) <= max(2, capacity) and len(np.unique(at)) == 460 and (index.find(keys + np.uint64(1)) < 0).all()
    for k, e in zip(keys.tolist(), at.tolist(), strict=True):
        bucket, place = e >> 32, e & 0xFFFFFFFF
        assert index.keys[bucket][place] == k and index.counts[bucket][place] == 2 * (keys == k).sum()


def test_index_file_counts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 40}") for i in range(90)], KIND)
    exact_dedup(df, index_dir=f"file://{tmp_path}/i", capacity=2).collect()
    found = [n for f in (tmp_path / "i").glob("owner-*") for n in np.concatenate(read_index(f"file://{tmp_path}/i", int(f.name[6:14])).counts).tolist()]
    assert sorted(found) == [2] * 30 + [3] * 10


def grams(text, n=3):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_groups(rows, t):
    sets = {}
    for i, x in rows:
        if i is not None and x is not None:
            sets.setdefault(i, set()).update(grams(x))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    hit = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= t * len(x | y) - 1e-9:
            hit |= {a, b}
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    group = {i: root(i) for i in hit}
    return {(i, g, sum(x == g for x in group.values())) for i, g in group.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_against_all_pairs(spark, seed):
    rows = corpus(seed)
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "two words"), (905, "two  words"), (None, rows[0][1]), (906, "tail"), (906, rows[0][1]), (907, rows[0][1])]
    got = {tuple(r) for r in near_groups(spark.createDataFrame(rows, KIND)).collect()}
    assert got == brute_groups(rows, 0.6)


def test_near_hot_group_and_region():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) < 0.9], rng.integers(0, 1 << 40, 6).astype(np.uint64)])) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 1 << 40, 50).astype(np.uint64)) for _ in range(60)]
    parent = list(range(210))

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in itertools.combinations(range(210), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if both >= 0.6 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            parent[max(root(parent, a), root(parent, b))] = min(root(parent, a), root(parent, b))
    mine = list(range(210))
    for a, b in region_edges(list(range(210)), sets, 0.6):
        x, y = root(mine, a), root(mine, b)
        mine[max(x, y)] = min(x, y)
    assert [root(mine, i) for i in range(210)] == [root(parent, i) for i in range(210)]


def test_region_falls_into_cells():
    rng = np.random.default_rng(19)
    sets = []
    for _ in range(40):  # families that share a few n-grams with all others
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        for _ in range(25):
            sets.append(np.unique(np.concatenate([base[rng.random(60) < 0.9], np.arange(3, dtype=np.uint64), rng.integers(0, 1 << 40, 3).astype(np.uint64)])))
    region = _Region(list(range(1000)), sets, 0.6)
    region.join(np.arange(1000))
    groups = {}
    for i in range(1000):
        groups.setdefault(region.root(i), set()).add(i // 25)
    assert len(groups) == 40 and all(len(g) == 1 for g in groups.values())
    assert region.cells >= 40 and region.measured < 1000 * 999 / 2 / 5


def test_near_equal_sets_in_a_hot_group(spark):
    rng = random.Random(20)
    text = " ".join(words(rng, 40, 10**9))
    rows = [(i, text if i % 3 else " ".join(words(rng, 40, 10**9))) for i in range(900)] + [(1000, text + " end"), (1001, text.upper())]
    got = {tuple(r) for r in near_groups(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {(i, 1, 602) for i in [*(i for i in range(900) if i % 3), 1000, 1001]}


def test_near_id_of_frequent_and_rare_rows(spark):
    rng = random.Random(14)
    common = " ".join(words(rng, 300, 10**9))
    rows = [(100 + i, common + " " + " ".join(words(rng, 700, 10**9))) for i in range(40)]
    for i in range(4):
        rare = " ".join(words(rng, 300, 10**9))
        rows += [(2 * i, x) for x in ((common, rare) if i % 2 else (rare, common))] + [(2 * i + 1, common + " " + rare)]
    got = {tuple(r) for r in near_groups(spark.createDataFrame(rows, KIND).coalesce(1)).collect()}
    assert got == {(i, i - i % 2, 2) for i in range(8)} == brute_groups(rows, 0.6)


def test_near_giant_texts(spark):
    text = " ".join(map(str, range(1_200_000)))  # over 65,535 n-grams in each of 16 buckets
    got = near_groups(spark.createDataFrame([(1, text), (2, text + " end"), (3, "a b c d")], KIND)).collect()
    assert {tuple(r) for r in got} == {(1, 1, 2), (2, 1, 2)}


def test_near_drop(spark):
    text = " ".join(f"w{i}" for i in range(30))
    kind = "text string, doc_id long, pivot int, Grams string"
    df = spark.createDataFrame([(text, 5, 1, "x"), (text + " end", 3, 2, "y"), (None, 9, 3, None), ("", None, 4, None), (text, None, 5, None)], kind)
    out = drop_near_copies(df)
    assert sorted(r.pivot for r in out.collect()) == [2, 3, 4, 5]
    assert set(out.columns) == set(df.columns)


def test_components_ways_agree(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(9)], "a long, b long")
    clean = edges.where("a <> b").distinct()
    assert {tuple(r) for r in components(edges).collect()} == {tuple(r) for r in _sized(_stars(clean)).collect()}


def brute_spans(rows, least):
    seen = {}
    for i, x in rows:
        if i is None or x is None:
            continue
        w = x.split()
        for p in range(len(w) - least + 1):
            seen.setdefault(tuple(w[p : p + least]), []).append((i, p))
    hits = {}
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                hits.setdefault(i, {})[p] = (i, p) != min(at)
    out = set()
    for i, places in hits.items():
        run = []
        for p in sorted(places):
            if run and p > run[-1] + least:
                out.add((i, run[0], run[-1] + least, len(run), sum(places[x] for x in run)))
                run = []
            run.append(p)
        out.add((i, run[0], run[-1] + least, len(run), sum(places[x] for x in run)))
    return out


@pytest.mark.parametrize(("least", "q"), [(50, 12), (7, 3)])
def test_passages_against_brute_force(spark, least, q):
    rows = corpus(7) + [(900, None), (901, ""), (902, "a b c"), (903, "spin " * 120), (None, "spin " * 200)]
    got = repeated_passages(spark.createDataFrame(rows, KIND), least, q)
    assert {(r.doc_id, r.start_word, r.end_word, r.windows, r.removable) for r in got.collect()} == brute_spans(rows, least)


def test_empty_tables(spark):
    df = spark.createDataFrame([], KIND)
    for f in (exact_dedup, drop_exact_copies, near_groups, drop_near_copies, repeated_passages):
        assert f(df).collect() == []
    nulls = spark.createDataFrame([(None, None), (1, None), (2, "")], KIND)
    for f in (near_groups, repeated_passages):
        assert f(nulls).collect() == []


def _windows(text, row, least):
    found = {}
    for i in range(len(text) - least + 1):
        if row[i] == row[i + least - 1]:
            found.setdefault(tuple(text[i : i + least]), []).append(i)
    return sorted(tuple(v) for v in found.values() if len(v) > 1)


def test_bucket_refinement_against_brute_force():
    import numpy as np

    from corvane.llm.suffix_dedup import minimizers, refine

    rng = np.random.default_rng(5)
    for _ in range(400):
        n, q = int(rng.integers(1, 120)), int(rng.integers(1, 5))
        least = q + int(rng.integers(0, 12))
        text = rng.integers(0, int(rng.integers(1, 4)), n).astype(np.uint64)
        row = np.sort(rng.integers(0, int(rng.integers(1, 8)), n))
        groups = {}
        classes = refine(text, row, least, q, batch=int(rng.integers(1, 40)))
        for i in np.flatnonzero(classes):
            groups.setdefault(classes[i], []).append(int(i))
        assert sorted(map(tuple, groups.values())) == _windows(text, row, least)
        if n >= q:  # halved texts have the same anchors
            whole = minimizers(text << np.uint64(50), row, least, q)
            parts = minimizers(text << np.uint64(50), row, least, q, limit=2 * least + 1)
            assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_bucket_refinement_reuses_pointers():
    """One long run of equal words: each round doubles the depth, and a text
    of a million words takes a few rounds rather than one for each q words."""
    import numpy as np

    from corvane.llm import suffix_dedup as s

    rounds = []
    split = s._split
    s._split = lambda *args: rounds.append(1) or split(*args)
    try:
        classes = s.refine(np.zeros(1_000_000, np.uint64), np.zeros(1_000_000, np.int64), 400, 12)
    finally:
        s._split = split
    assert (classes > 0).sum() == 1_000_000 - 399 and len(set(classes.tolist())) == 2
    assert len(rounds) <= 7
