"""Repeated passages by a sparse suffix array with bucket-pointer refinement.

A window of ``least`` words is repeated if it occurs at two places at least,
in one document or in several. The suffixes that begin at windows are sorted
far enough to tell:

1. Of each window the q-gram with the least hash is its anchor, leftmost of
   equal ones. Equal windows have equal anchors at equal offsets. Anchors go to
   initial buckets by q-gram; a bucket with one place is finished.
2. The windows of the other anchors meet in their bucket's task with the words
   they cover. There bucket pointers are refined, bucket after bucket: the
   suffixes of a bucket are sorted by the pointers at the offset of its depth,
   and the parts are refined again at theirs. A part is as deep as its bucket
   and the bucket pointed at together, so what was refined before is reused.
   Singletons are finished and not sorted again.
3. Windows that still share a bucket are repeated. Of these the one with the
   least (id, place) is the first; the others are removable.

Runs of windows are merged to spans of words. Every place of every document
takes part; equal words are told by 32 bits of hash in each of ``least``
places besides the 48 bits of the q-gram.

Defined results: words are split at white space, case counts; null texts and
texts under ``least`` words have no window; rows with a null id are left out;
rows that share an id are each searched, and their spans united under it, so
that a row and its exact repetition are both first. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import BROADCAST_BYTES, col, cut, partitions
from corvane.llm._vector import column, ngrams, pack, trim, unpack, word_hashes, words
from corvane.llm.jaccard_join import GRAM_BITS, _batches, _bits

LEAST = 50
Q = 12
_PLACE = 28


def minimizers(h: np.ndarray, doc: np.ndarray, least: int, q: int, limit: int = 1 << _PLACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the place of each one's anchor, and all q-gram hashes.
    Texts beyond ``limit`` words, whose places don't fit in a key, are halved."""
    grams = ngrams(h, q)
    if len(h) > max(limit, 2 * least):
        m = len(h) // 2
        left = minimizers(h[: m + least - 1], doc[: m + least - 1], least, q, limit)
        right = minimizers(h[m:], doc[m:], least, q, limit)
        return np.append(left[0], right[0] + m), np.append(left[1], right[1] + m), grams
    n = len(h) - least + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, grams
    low = np.uint64((1 << _PLACE) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, span = least - q + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    starts = np.flatnonzero(doc[:n] == doc[least - 1 :])
    return starts, (key[starts] & low).astype(np.int64), grams


def refine(text: np.ndarray, row: np.ndarray, least: int, q: int, batch: int = 1 << 18) -> np.ndarray:
    """Class of each place of ``text`` at depth ``least``, 0 where it is alone
    or its row ends before. ``row`` numbers the places' rows.

    Buckets are refined in order, ``batch`` places at once, each batch down to
    the end before the next begins and so on pointers that it has updated.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < least:
        return out
    grams = ngrams(text.astype(np.uint64), q)
    inside = np.flatnonzero(row[: len(grams)] == row[q - 1 :])
    order = inside[np.argsort(grams[inside], kind="stable")]
    starts, size = _edges([grams[order]])
    first = np.zeros(n, np.int32)  # q-gram bucket of each place, 0 if its row ends before
    first[order] = np.repeat(starts + 1, size)
    del grams, inside
    # A pointer is 1 + where its bucket begins in the order of whole q-word
    # blocks, so the parts of a bucket stay in its range.
    pointer, goal = first.copy(), least // q * q
    depth = np.full(n, q, np.int32)
    shared = np.flatnonzero(size > 1)
    ends = np.cumsum(size[shared])
    lot = np.searchsorted(np.unique(ends // batch), ends // batch) if len(ends) else ends
    for buckets in np.split(shared, np.flatnonzero(np.diff(lot)) + 1):
        at = _members(order, starts[buckets], size[buckets])
        while goal > q and len(at):
            at = _split(at, row, pointer, depth, goal)
    # Pointers may tell suffixes apart behind the window: equal windows are
    # neighbours in their order, and their q-grams tell where one class ends.
    at = _members(order, starts[shared], size[shared])
    at = at[at <= n - least]
    at = at[row[at] == row[at + least - 1]]
    at = at[np.argsort(pointer[at], kind="stable")]
    starts, size = _edges([first[at + k] for k in range(0, goal, q)])
    group = np.repeat(np.arange(len(size)), size)
    tail = first[at + least - q]
    sort = np.lexsort((tail, group))
    at, group, tail = at[sort], group[sort], tail[sort]
    _, size = _edges([group, tail])
    out[at] = np.repeat(np.where(size > 1, np.arange(1, len(size) + 1), 0), size)
    return out


def _edges(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


def _members(order: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of buckets given by begin and length in ``order``."""
    if not len(size):
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(size) - size), size)
    return order[shift + np.arange(len(shift))]


def _split(at: np.ndarray, row: np.ndarray, pointer: np.ndarray, depth: np.ndarray, goal: int) -> np.ndarray:
    """Splits the buckets of ``at`` by the pointers at their depth, updates the
    pointers and depths, and returns the places that aren't finished."""
    d = depth[at]
    far = at + d
    ok = far < len(row)
    far = np.where(ok, far, 0)
    ok &= row[far] == row[at]
    key = np.where(ok, pointer[far], 0)
    d = np.where(key > 0, d + depth[far], goal)  # a row that ends can't go deeper
    old = pointer[at]
    sort = np.lexsort((key, old))
    at, key, old, d = at[sort], key[sort], old[sort], d[sort]
    whole, length = _edges([old])
    starts, size = _edges([old, key])
    begin = np.repeat(whole, length)[starts]
    pointer[at] = np.repeat(old[starts] + (starts - begin).astype(np.int32), size)
    depth[at] = d
    return at[np.repeat(size > 1, size) & (d < goal)]


def repeated_windows(ids: np.ndarray, place: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places in buckets: id, place, and whether another comes first."""
    at = np.flatnonzero(bucket)
    order = at[np.lexsort((place[at], ids[at], bucket[at]))]
    b, i, p = bucket[order], ids[order], place[order]
    lead = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    size = np.diff(np.append(lead, len(b)))
    later = (i != np.repeat(i[lead], size)) | (p != np.repeat(p[lead], size))
    return i, p, later


def runs(ids: np.ndarray, place: np.ndarray, later: np.ndarray) -> pd.DataFrame:
    """Consecutive places as rows: doc_id, first, end, windows, removable."""
    order = np.lexsort((place, ids))
    ids, place, later = ids[order], place[order], later[order].astype(np.int64)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (place[1:] == place[:-1])
    ids, place, later = ids[~same], place[~same], later[~same]
    begin = np.ones(len(ids), bool)
    begin[1:] = (ids[1:] != ids[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(begin)
    if not len(at):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc_id", "first", "end", "removable")})
    return pd.DataFrame({"doc_id": ids[at], "first": place[at], "end": place[np.append(at[1:], len(ids)) - 1] + 1, "removable": np.add.reduceat(later, at)})


def _ids(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    return column(batch, "doc_id").to_numpy(zero_copy_only=False)[a:b]


def shared_anchors(docs: DataFrame, least: int, q: int) -> DataFrame:
    """doc_id and the places (4 bytes each) of its anchors that occur twice."""
    bits = _bits(partitions(docs.sparkSession))
    width = (GRAM_BITS - bits + 7) // 8

    def spread(batches):
        for piece, batch, texts, a, b in _batches(batches):
            data, first, last, doc = words(texts, a, b)
            _, anchor, grams = minimizers(word_hashes(data, first, last), doc, least, q)
            mark = np.zeros(len(first), bool)
            mark[anchor] = True
            at = np.flatnonzero(mark)
            if not len(at):
                continue
            g, d = grams[at] >> np.uint64(64 - GRAM_BITS), doc[at]
            p = at - np.searchsorted(doc, d)
            to = (g >> np.uint64(GRAM_BITS - bits)).astype(np.uint16)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange((1 << bits) + 1))
            own = _ids(batch, a, b)
            rows = []
            for k in range(1 << bits):
                if cuts[k] < cuts[k + 1]:
                    s = order[cuts[k] : cuts[k + 1]]
                    some, per = np.unique(d[s], return_counts=True)
                    rows.append((k, own[some].astype("<i8").tobytes(), per.astype("<u4").tobytes(), pack(g[s], width), p[s].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "docs", "counts", "grams", "places"])
        trim()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        per = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]).astype(np.int64)
        ids = np.repeat(np.concatenate([np.frombuffer(x, "<i8") for x in pdf["docs"]]), per)
        g = np.concatenate([unpack(x, width) for x in pdf["grams"]])
        p = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["places"]])
        order = np.argsort(g)
        s = g[order]
        twin = np.zeros(len(s), bool)
        twin[1:] = s[1:] == s[:-1]
        twin[:-1] |= twin[1:]
        at = order[twin]
        at = at[np.lexsort((p[at], ids[at]))]
        ids, p = ids[at], p[at]
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(begin[1:], len(ids))[: len(begin)]
        return pd.DataFrame({"doc_id": ids[begin], "places": [p[x:y].tobytes() for x, y in zip(begin, ends, strict=True)]})

    met = docs.mapInArrow(spread, "bucket int, docs binary, counts binary, grams binary, places binary").groupBy("bucket").applyInPandas(meet, "doc_id long, places binary")
    return cut(met.groupBy("doc_id").agg(F.collect_list("places").alias("places")))


def repeated_passages(docs: DataFrame, least: int = LEAST, q: int = Q, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), windows and removable (windows
    that aren't the first of their kind) of each maximal span of repeated words."""
    if not 0 < q < least:
        raise ValueError("q must be positive and below the least length")
    plain = docs.where(col(docs, ident).isNotNull()).select(col(docs, ident).cast("long").alias("doc_id"), col(docs, text).alias("text"))
    anchors = shared_anchors(plain, least, q)
    bits = _bits(16 * partitions(docs.sparkSession))  # a bucket's suffixes are sorted in memory
    size = anchors.agg(F.sum(F.expr("aggregate(places, 40L, (a, x) -> a + length(x) + 16)"))).first()[0] or 0
    wanted = plain.join(F.broadcast(anchors) if size <= BROADCAST_BYTES else anchors, "doc_id")

    def contexts(batches):
        for _, batch, texts, a, b in _batches(batches):
            data, first, last, doc = words(texts, a, b)
            h = word_hashes(data, first, last)
            starts, anchor, grams = minimizers(h, doc, least, q)
            begins, lists = np.searchsorted(doc, np.arange(b - a)), column(batch, "places")
            mark = np.zeros(len(first) + 1, bool)
            for i in range(a, b):
                for x in lists[i].as_py():
                    p = begins[i - a] + np.frombuffer(x, "<u4").astype(np.int64)
                    mark[p[p < len(first)]] = True
            use = mark[anchor]
            starts, anchor = starts[use], anchor[use]
            if not len(starts):
                continue
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            lo, count = starts[new], np.diff(np.append(new, len(starts)))
            to = (grams[anchor[new]] >> np.uint64(64 - bits)).astype(np.uint16)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange((1 << bits) + 1))
            own, short = _ids(batch, a, b), (h >> np.uint64(32)).astype("<u4")
            rows = []
            for k in range(1 << bits):
                if cuts[k] < cuts[k + 1]:
                    s = order[cuts[k] : cuts[k + 1]]
                    length = count[s] + least - 1
                    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(lo[s], length)
                    rows.append((k, own[doc[lo[s]]].astype("<i8").tobytes(), (lo[s] - begins[doc[lo[s]]]).astype("<u4").tobytes(), length.astype("<u4").tobytes(), short[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "docs", "places", "lengths", "words"])
        trim()

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["docs"]])
        place = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["places"]]).astype(np.int64)
        length = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["lengths"]]).astype(np.int64)
        text = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["words"]])
        row = np.repeat(np.arange(len(ids)), length)
        inner = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
        bucket = refine(text, row, least, q)
        at = np.flatnonzero(bucket)
        trim()
        return runs(*repeated_windows(ids[row[at]], place[row[at]] + inner[at], bucket[at]))

    found = wanted.mapInArrow(contexts, "bucket int, docs binary, places binary, lengths binary, words binary").groupBy("bucket").applyInPandas(sort, "doc_id long, first long, end long, removable long").distinct()
    by = Window.partitionBy("doc_id").orderBy("first", "end")
    reach = F.max(F.col("end") + (least - 1)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.withColumn("reach", reach).withColumn("opens", F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach")), 1).otherwise(0))
    spans = spans.withColumn("span", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "span").agg(F.min("first").alias("start_word"), (F.max("end") + (least - 1)).alias("end_word"), F.sum(F.col("end") - F.col("first")).alias("windows"), F.sum("removable").alias("removable")).drop("span")
