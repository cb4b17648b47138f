"""Exact Jaccard join of documents over word n-grams, to groups of near copies.

1 - Jaccard is a metric, and regions around pivots are joined by it. In text
nearly all documents are at distance about 1 from any document that might be
a pivot, so regions drawn around documents of the whole table would each get
every document as a boundary document. The upper level therefore takes single
n-grams as pivots, the lower levels documents:

1. Witness filter. A partner at similarity t shares at least t of a document's
   n-grams, so at least that many occur in some other document. One packed
   shuffle of n-gram hashes counts them; n-grams that a slice of documents has
   twice are counted there and go once, however frequent they are. Documents
   with fewer are finished. Of documents with equal sets one goes on.
2. Regions of n-gram pivots. The others' n-grams are put in one order, rarest
   first. Similar documents share ``SHARED`` of the first
   |x| - ceil(t |x|) + ``SHARED`` (the boundary window for radius 1 - t).
   Small regions give pairs, counted over all regions; a large region gives
   its member with the least hash as document pivot.
3. Regions of document pivots. All members of a region meet in one task, which
   joins them recursively: each belongs to the Voronoi cell of its nearest pivot
   if that is within ``REACH``, else to the rest, which gets new pivots. A cell
   that reaches out to R from its pivot is joined with its window, all others
   within R + r of the pivot: by the triangle inequality no partner of a member
   is farther. Cells that no longer shrink are compared pair by pair. Documents
   already connected needn't be compared again.
4. Connected pairs become groups named after their least id.

No step drops a partner: the result equals that of comparing all pairs.

Defined results: words are the lower-cased text split at white space; a text of
1 to n-1 words has one n-gram, all its words; null and empty texts have none
and no partner. Rows with one id are one document with the n-grams of all of
them; rows with a null id are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import BROADCAST_BYTES, by_ids, col, cut, partitions
from corvane.llm._vector import column, mix, ngrams, pack, slices, strings, trim, unpack, word_hashes, words
from corvane.llm.components import components

N = 3
THRESHOLD = 0.6
SHARED = 3
LARGE = 8
LEAF = 24
#: How far a cell reaches from its pivot at most: windows then end below 1, where unrelated texts are.
REACH = 0.95
HOT = 32
#: The most n-grams whose frequency the order uses; it affects speed alone.
ORDERED = 1 << 20
GRAM_BITS = 48


def text_sets(texts: pa.Array, n: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes (48 bits) of documents [a, b): number of the
    document within the slice, and hash, in the order of both."""
    data, first, last, doc = words(texts, a, b)
    h = word_hashes(data, first, last)
    g = ngrams(h, n) >> np.uint64(64 - GRAM_BITS)
    d = doc[: len(g)]
    whole = doc[n - 1 :] == d if len(g) else np.zeros(0, bool)
    g, d = g[whole], d[whole]
    size = np.bincount(doc, minlength=b - a)
    for k in range(1, n):  # short texts: all their words
        at = np.flatnonzero(size[doc] == k)[::k] if len(doc) else np.zeros(0, np.int64)
        if len(at):
            short = np.zeros(len(at), np.uint64)
            for j in range(k):
                short = short * np.uint64(0xD1342543DE82EF95) + h[at + j]
            g = np.concatenate([g, mix(short + np.uint64(k)) >> np.uint64(64 - GRAM_BITS)])
            d = np.concatenate([d, doc[at]])
    key = np.sort((d.astype(np.uint64) << np.uint64(GRAM_BITS)) | g)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(GRAM_BITS)).astype(np.int64), key & np.uint64((1 << GRAM_BITS) - 1)


def _lower(docs: DataFrame, text: str, ident: str) -> DataFrame:
    return docs.where(col(docs, ident).isNotNull()).select(col(docs, ident).cast("long").alias("doc_id"), F.lower(col(docs, text)).alias("text"))


def _bits(n: int) -> int:
    return max(4, min(16, math.ceil(math.log2(max(1, n)))))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, pa.Array, int, int]]:
    """Slices with a number that says the partition and their place in it."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = strings(batch, "text")
        for a, b in slices(texts):
            yield (part << 32) | k, batch, texts, a, b
            k += 1


_PACKED = "bucket int, piece long, counts binary, grams binary, many binary, times binary"


def witnesses(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Ids of the documents with enough n-grams that occur elsewhere, and the
    n-grams that more than ``HOT`` documents have."""
    bits = _bits(partitions(docs.sparkSession) * 2)
    width = (GRAM_BITS - bits + 7) // 8

    def spread(batches):
        for piece, batch, texts, a, b in _batches(batches):
            d, g = text_sets(texts, n, a, b)
            ids = column(batch, "doc_id").to_numpy(zero_copy_only=False)[a:b]
            size = np.bincount(d, minlength=b - a)
            order = np.argsort(g, kind="stable")
            d, g = d[order], g[order]
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            held = np.diff(np.append(begin, len(g)))
            twice = np.repeat(held > 1, held)
            here = np.bincount(d[twice], minlength=b - a)  # known to occur elsewhere
            many, times = g[begin[held > 1]], held[held > 1]
            d, g = d[~twice], g[~twice]
            top = np.uint64(GRAM_BITS - bits)
            edges = np.arange((1 << bits) + 1, dtype=np.uint64) << top
            cuts, more = np.searchsorted(g, edges), np.searchsorted(many, edges)
            rows = [(-1 - piece % (1 << bits), piece, ids.astype("<i8").tobytes(), np.stack([size, here]).astype("<u4").tobytes(), b"", b"")]
            for k in range(1 << bits):
                lo, hi, x, y = cuts[k], cuts[k + 1], more[k], more[k + 1]
                if lo < hi or x < y:
                    own = np.argsort(d[lo:hi], kind="stable")
                    rows.append((k, piece, np.bincount(d[lo:hi], minlength=b - a).astype("<u4").tobytes(), pack(g[lo:hi][own], width), pack(many[x:y], width), times[x:y].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["bucket", "piece", "counts", "grams", "many", "times"])
        trim()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:  # tables of ids and sizes go on as they are
            return pd.DataFrame({"piece": pdf["piece"], "kind": 0, "x": pdf["counts"], "y": pdf["grams"]})
        grams = [unpack(x, width) for x in pdf["grams"]]
        many = [unpack(x, width) for x in pdf["many"]]
        g = np.concatenate([*grams, *many])
        single = sum(map(len, grams))
        times = np.concatenate([np.ones(single, np.int64), *[np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["times"]]])
        order = np.argsort(g)
        s = g[order]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.add.reduceat(times[order], begin)
        shared = np.empty(len(g), bool)
        shared[order] = np.repeat(size > 1, np.diff(np.append(begin, len(s))))
        out, at = [], 0
        for piece, counts, own in zip(pdf["piece"], pdf["counts"], grams, strict=True):
            per = np.frombuffer(counts, "<u4").astype(np.int64)
            sums = np.bincount(np.repeat(np.arange(len(per)), per), weights=shared[at : at + len(own)], minlength=len(per))
            at += len(own)
            out.append((piece, 1, sums.astype("<u4").tobytes(), b""))
        hot = size > HOT
        low = np.uint64((1 << (GRAM_BITS - bits)) - 1)
        full = (s[begin[hot]] & low) | (np.uint64(bucket) << np.uint64(GRAM_BITS - bits))
        out.append((-1, 2, full.astype("<u8").tobytes(), size[hot].astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["piece", "kind", "x", "y"])

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["kind"] == 0].iloc[0]
        ids = np.frombuffer(head["x"], "<i8")
        size, have = np.frombuffer(head["y"], "<u4").astype(np.int64).reshape(2, -1)
        for x in pdf.loc[pdf["kind"] == 1, "x"]:
            have += np.frombuffer(x, "<u4")
        return pd.DataFrame({"doc_id": ids[(size > 0) & (have >= np.ceil(threshold * size - 1e-9))]})

    counted = cut(docs.mapInArrow(spread, _PACKED).groupBy("bucket").applyInPandas(count, "piece long, kind int, x binary, y binary"))
    active = counted.where("kind < 2").groupBy("piece").applyInPandas(decide, "doc_id long").distinct()

    def listed(batches):
        for batch in batches:
            for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist(), strict=True):
                yield pa.record_batch({"gram": pa.array(np.frombuffer(x, "<u8").astype(np.int64)), "docs": pa.array(np.frombuffer(y, "<i8"))})

    hot = counted.where("kind = 2").select("x", "y").mapInArrow(listed, "gram long, docs long")
    return cut(active), hot


def _often(hot: DataFrame) -> Broadcast:
    """The frequent n-grams, sorted, and how many documents have each."""
    top = hot.orderBy(F.desc("docs"), "gram").limit(ORDERED).toArrow()  # 16 MB at most, by ORDERED
    name = np.asarray(top["gram"], np.int64).astype(np.uint64)
    by = np.argsort(name)
    return hot.sparkSession.sparkContext.broadcast((name[by], np.asarray(top["docs"], np.int64)[by]))


def _ranks(g: np.ndarray, names: np.ndarray, often: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(g), np.int64)
    at = np.minimum(np.searchsorted(names, g), len(names) - 1)
    return np.where(names[at] == g, often[at], 0)


def ordered_sets(docs: DataFrame, n: int, shared: Broadcast) -> DataFrame:
    """doc_id, size and n-grams (6 bytes each) in the common order: hash order,
    after it the frequent ones from rare to frequent."""

    def run(batches):
        for _, batch, texts, a, b in _batches(batches):
            d, g = text_sets(texts, n, a, b)
            order = np.lexsort((g, _ranks(g, *shared.value), d))
            g, size = g[order], np.bincount(d, minlength=b - a)
            ends = np.cumsum(size)
            ids = column(batch, "doc_id").to_numpy(zero_copy_only=False)[a:b]
            keep = np.flatnonzero(size)
            yield pa.record_batch({"doc_id": pa.array(ids[keep]), "size": pa.array(size[keep].astype(np.int32)), "grams": pa.array([pack(g[ends[i] - size[i] : ends[i]], 6) for i in keep], pa.binary())})
        trim()

    return docs.mapInArrow(run, "doc_id long, size int, grams binary")


def _merged(sets: DataFrame, shared: Broadcast) -> DataFrame:
    """One row an id: rows that share one are united, in the common order again."""
    many = sets.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if many.isEmpty():
        return sets

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.unique(np.concatenate([unpack(x, 6) for x in pdf["grams"]]))
        g = g[np.lexsort((g, _ranks(g, *shared.value)))]
        return pd.DataFrame({"doc_id": pdf["doc_id"][:1], "size": [len(g)], "grams": [pack(g, 6)]})

    return by_ids(sets, many, "left_anti").unionByName(by_ids(sets, many, "left_semi").groupBy("doc_id").applyInPandas(unite, "doc_id long, size int, grams binary"))


def _need(size: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(SHARED, np.ceil(t * size - 1e-9)).astype(np.int64)


def candidates(sets: DataFrame, t: float) -> DataFrame:
    """(pivot, member): the members of each region of a document pivot."""
    bits = _bits(partitions(sets.sparkSession))
    width = (GRAM_BITS - bits + 7) // 8

    def spread(batches):
        for batch in batches:
            ids, size = column(batch, "doc_id").to_numpy(zero_copy_only=False), column(batch, "size").to_numpy().astype(np.int64)
            raw = column(batch, "grams")
            long = np.minimum(size, size - np.ceil(t * size - 1e-9).astype(np.int64) + _need(size, t))
            if not len(ids):
                continue
            g = np.concatenate([unpack(raw[i].as_py()[: 6 * k], 6) for i, k in enumerate(long)])
            d = np.repeat(np.arange(len(ids)), long)
            to = (g >> np.uint64(GRAM_BITS - bits)).astype(np.uint16)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange((1 << bits) + 1))
            rows = []
            for k in range(1 << bits):
                if cuts[k] < cuts[k + 1]:
                    at = order[cuts[k] : cuts[k + 1]]
                    own, per = np.unique(d[at], return_counts=True)
                    rows.append((k, ids[own].astype("<i8").tobytes() + size[own].astype("<i4").tobytes(), per.astype("<u4").tobytes(), pack(g[at], width)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "docs", "counts", "grams"])
        trim()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, size, g = [], [], []
        for docs, counts, grams in zip(pdf["docs"], pdf["counts"], pdf["grams"], strict=True):
            per = np.frombuffer(counts, "<u4").astype(np.int64)
            ids.append(np.repeat(np.frombuffer(docs[: 8 * len(per)], "<i8"), per))
            size.append(np.repeat(np.frombuffer(docs[8 * len(per) :], "<i4"), per))
            g.append(unpack(grams, width))
        ids, size, g = np.concatenate(ids), np.concatenate(size).astype(np.int64), np.concatenate(g)
        order = np.lexsort((mix(ids.astype(np.uint64)), g))
        ids, size, g = ids[order], size[order], g[order]
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        count = np.diff(np.append(begin, len(g)))
        out = []
        for m in range(2, LARGE + 1):
            rows = begin[count == m][:, None] + np.arange(m)
            for i in range(m):
                for j in range(i + 1, m):
                    p, q = rows[:, i], rows[:, j]
                    fit = np.minimum(size[p], size[q]) >= t * np.maximum(size[p], size[q]) - 1e-9
                    p, q = p[fit], q[fit]
                    x, y = np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])
                    out.append((x, y, _need(np.minimum(size[p], size[q]), t)))
        large = count > LARGE
        star = np.repeat(begin[large], count[large])
        inner = np.arange(len(star)) - np.repeat(np.cumsum(count[large]) - count[large], count[large])
        out.append((ids[star], ids[star + inner], np.zeros(len(star), np.int64)))
        p, m, need = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"pivot": p, "member": m, "need": need}).groupby(["pivot", "member", "need"], sort=False).size().rename("n").reset_index()

    met = sets.mapInArrow(spread, "bucket int, docs binary, counts binary, grams binary").groupBy("bucket").applyInPandas(meet, "pivot long, member long, need long, n long")
    sums = met.groupBy("pivot", "member").agg(F.sum(F.when(F.col("need") > 0, F.col("n")).otherwise(0)).alias("n"), F.max("need").alias("need"), F.min("need").alias("least"))
    return sums.where("least = 0 or n >= need").select("pivot", "member")


class _Region:
    """Exact join of the members of one region to connected pairs."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], t: float):
        self.ids, self.sets, self.t, self.r = ids, sets, t, 1 - t
        self.size = np.array([len(s) for s in sets])
        self.parent = list(range(len(ids)))
        self.edges: list[tuple[int, int]] = []
        self.cells = self.measured = 0
        self.flat, self.ends = np.concatenate(sets), np.cumsum(self.size)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def connect(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[b] = a
            self.edges.append((self.ids[x], self.ids[y]))

    def distances(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Jaccard distance of each member to the pivot."""
        self.measured += len(members)
        size = self.size[members]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.ends[members] - size, size)
        hit = np.searchsorted(self.sets[pivot], self.flat[at])
        hit = self.sets[pivot][np.minimum(hit, self.size[pivot] - 1)] == self.flat[at]
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
        return 1 - both / (size + self.size[pivot] - both)

    def near(self, d: np.ndarray) -> np.ndarray:
        return d <= self.r + 1e-12

    def leaf(self, members: np.ndarray) -> None:
        for k in range(len(members) - 1):
            x, rest = int(members[k]), members[k + 1 :]
            own = self.root(x)
            rest = rest[[self.root(int(y)) != own for y in rest]]
            rest = rest[np.minimum(self.size[rest], self.size[x]) >= self.t * np.maximum(self.size[rest], self.size[x]) - 1e-9]
            if len(rest):
                for y in rest[self.near(self.distances(x, rest))]:
                    self.connect(x, int(y))

    def join(self, members: np.ndarray) -> None:
        todo = [members]
        while todo:
            members = todo.pop()
            if len({self.root(int(x)) for x in members}) < 2:
                continue
            if len(members) <= LEAF:
                self.leaf(members)
                continue
            pivots = members[np.linspace(0, len(members) - 1, max(2, int(len(members) ** 0.5) // 2)).astype(np.int64)]
            d = np.stack([self.distances(int(p), members) for p in pivots])
            for p, row in zip(pivots, d, strict=True):
                for y in members[self.near(row)]:
                    self.connect(int(p), int(y))
            if len({self.root(int(x)) for x in members}) < 2:
                continue
            own, cell = d.min(axis=0), d.argmin(axis=0)
            assigned = own <= REACH - self.r
            todo.append(members[~assigned])  # smaller by the pivots at least
            for c in range(len(pivots)):
                core = assigned & (cell == c)
                if not core.any():
                    continue
                inside = members[d[c] <= own[core].max() + self.r + 1e-12]
                self.cells += 1
                if len(inside) < 0.9 * len(members):
                    todo.append(inside)
                else:  # it no longer shrinks
                    self.leaf(inside)


def region_edges(ids: list[int], sets: list[np.ndarray], t: float) -> list[tuple[int, int]]:
    region = _Region(ids, [np.sort(s) for s in sets], t)
    region.join(np.arange(len(ids)))
    return region.edges


def _equal_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One of the documents with a set, and edges from it to the others. Sets
    are told apart by 128 bits; the hashes are counted before they are shuffled."""
    marked = sets.select("doc_id", F.xxhash64("size", "grams").alias("p"), F.xxhash64("grams", F.lit(1)).alias("q"))
    lead = cut(marked.groupBy("p", "q").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"))
    small = lead.count() * 32 <= BROADCAST_BYTES
    others = cut(marked.join(F.broadcast(lead) if small else lead, ["p", "q"]).where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")))
    return by_ids(sets, others.select(F.col("b").alias("doc_id")), "left_anti"), others


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, group_id (least id) and group_size of each document that has a
    near copy, directly or through others."""
    low = _lower(docs, text, ident)
    active, hot = witnesses(low, n, threshold)
    shared = _often(hot)
    sets = cut(_merged(ordered_sets(by_ids(low, active, "left_semi"), n, shared), shared))
    sets, equal = _equal_sets(sets)
    regions = candidates(sets, threshold)
    regions = cut(regions.union(regions.select("pivot", F.col("pivot"))).distinct())

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = region_edges(pdf["doc_id"].tolist(), [unpack(x, 6) for x in pdf["grams"]], threshold)
        return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    members = regions.join(sets.select(F.col("doc_id").alias("member"), "grams"), "member").select("pivot", F.col("member").alias("doc_id"), "grams")
    edges = members.groupBy("pivot").applyInPandas(solve, "a long, b long")
    return components(cut(edges.union(equal)))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, all columns, without those whose group has a lesser id."""
    gone = near_groups(docs, threshold, n, text, ident).where("doc_id <> group_id").select(F.col("doc_id").alias(ident))
    return by_ids(docs, gone, "left_anti", ident)
