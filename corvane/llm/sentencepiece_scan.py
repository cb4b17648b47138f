"""SentencePiece encoding and decoding, giant documents by a max-plus scan.

The pieces of a public SentencePiece file are segmented as a unigram model:
the ids are the path of greatest total score. The bundled public file is of
the BPE kind, whose scores are merge ranks and no log-probabilities, and
vocabularies aren't trained here; a piece's score is therefore taken from its
rank by Zipf's law, -ln(rank + 2), rounded to sixteenths so that sums are
exact. A file of the unigram kind keeps its own scores (``zipf=False``).

Ordinary documents are encoded by the library from the rewritten model. A
document over ``GIANT`` characters is cut into chunks at any character:

1. each chunk yields a transfer matrix: the best score from each state at its
   left edge (letters of it already used by a piece that began before) to each
   state at its right edge; 64 chunks are worked out at a time;
2. runs of chunks that lie in one task are multiplied there, the products of a
   document's runs then meet, 128 numbers each beside the ends. The max-plus
   product is associative, so both scans go up and down a tree of products;
3. each chunk is backtraced by itself from the scores of the states at its left
   edge, for every right state that can be reached; a fold over the document's
   chunks picks the paths that meet.

Ties go to the longer last piece, as in the library, so both ways agree.

Defined results: null and empty texts have no ids; a text's own U+2581 decodes
to a space, all else round-trips; letters without a piece become byte pieces.
Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import BROADCAST_BYTES, col, cut, partitions
from corvane.llm._vector import column, strings, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 50_000
CHUNK = 2048
NORMAL, UNKNOWN, BYTE, UNIGRAM = 1, 2, 6, 1
GRID = 16
#: Chunks of a document that go to one task together, where they make a run.
RUN = 64
_CHUNKS = "doc_id long, key long, times long, k int, size int, piece string"
NEVER = -1e18


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        b = buf[at]
        at += 1
        x |= (b & 127) << shift
        if b < 128:
            return x, at
        shift += 7


def _to_varint(x: int) -> bytes:
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def _fields(buf: bytes):
    """(number, wire type, value) of each field of a protobuf message."""
    at = 0
    while at < len(buf):
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 2:
            n, at = _varint(buf, at)
            value, at = buf[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = buf[at : at + n], at + n
        yield tag >> 3, kind, value


def _field(number: int, kind: int, value) -> bytes:
    head = _to_varint(number << 3 | kind)
    return head + (_to_varint(value) if kind == 0 else _to_varint(len(value)) + value if kind == 2 else value)


def unigram_model(raw: bytes, zipf: bool = True) -> bytes:
    """The same pieces as a model of the unigram kind."""
    out, rank = b"", 0
    parts = []
    for number, kind, value in _fields(raw):
        if number == 1:
            piece = {n: (k, v) for n, k, v in _fields(value)}
            if zipf and piece.get(3, (0, NORMAL))[1] == NORMAL:
                piece[2] = (5, struct.pack("<f", -round(GRID * math.log(rank + 2)) / GRID))
                rank += 1
            value = b"".join(_field(n, k, v) for n, (k, v) in sorted(piece.items()))
        elif number == 2:
            value = b"".join(_field(n, k, v) for n, k, v in _fields(value) if n != 3) + _field(3, 0, UNIGRAM)
        parts.append(_field(number, kind, value))
    return out + b"".join(parts)


@dataclass
class Vocabulary:
    """Pieces by hash: of each length a sorted array of hashes, ids and scores."""

    longest: int
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    maybe: np.ndarray
    unknown: float
    byte_ids: np.ndarray


_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64((1 << 22) - 1)


def _spread(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    by: dict[int, dict[int, tuple[int, float]]] = {}
    byte_ids, low = np.full(256, -1, np.int64), 0.0
    number = 0
    for n, _, value in _fields(model):
        if n != 1:
            continue
        piece = {k: v for k, _, v in _fields(value)}
        text, kind = piece[1].decode(), piece.get(3, NORMAL)
        score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        if kind == BYTE:
            byte_ids[int(text[3:5], 16)] = number
        elif kind == NORMAL:
            low = min(low, score)
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for ch in text:
                    h = h * _BASE + np.uint64(ord(ch) + 1)
            by.setdefault(len(text), {})[int(h)] = (number, score)
        number += 1
    maybe, tables = np.zeros(1 << 22, bool), {}
    for size, own in by.items():
        h = np.array(sorted(own), np.uint64)
        tables[size] = (h, np.array([own[int(x)][0] for x in h]), np.array([own[int(x)][1] for x in h]))
        maybe[(_spread(h + np.uint64(size)) & _MASK).astype(np.int64)] = True
    return Vocabulary(max(by), tables, maybe, low - 10, byte_ids)


def arcs(v: Vocabulary, text: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of code points (0 past the end): scores and ids of the piece of
    length l + 1 at each of the first ``starts`` places, [l, place, row]."""
    rows, width = text.shape
    letters = text.astype(np.uint64) + np.uint64(1)
    score = np.full((v.longest, starts, rows), NEVER, np.float32)
    ids = np.full((v.longest, starts, rows), -1, np.int32)
    h = np.zeros((rows, starts), np.uint64)
    real = np.ones((rows, starts), bool)
    for size in range(1, v.longest + 1):
        seg = slice(size - 1, size - 1 + starts)
        h = h * _BASE + letters[:, seg]
        real &= text[:, seg] > 0
        if size in v.tables:
            key, number, value = v.tables[size]
            r, c = np.nonzero(v.maybe[(_spread(h + np.uint64(size)) & _MASK).astype(np.int64)] & real)
            at = np.minimum(np.searchsorted(key, h[r, c]), len(key) - 1)
            ok = key[at] == h[r, c]
            r, c, at = r[ok], c[ok], at[ok]
            score[size - 1, c, r], ids[size - 1, c, r] = value[at], number[at]
        if size == 1:
            r, c = np.nonzero(real & (ids[0].T < 0))
            score[0, c, r], ids[0, c, r] = v.unknown, -2
    return score, ids


def forward(score: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Best score at each place [place, row, state] from the scores ``begin``
    [state at the left edge, row, column]."""
    longest, starts, rows = score.shape
    best = np.full((starts + longest, rows, begin.shape[2]), NEVER)
    best[:longest] = begin
    lengths = np.arange(longest)
    for i in range(1, starts + longest):
        lo, hi = max(0, i - longest), min(i, starts)
        if lo < hi:
            way = best[lo:hi] + score[i - 1 - lo - lengths[: hi - lo], lo + lengths[: hi - lo]][:, :, None]
            np.maximum(best[i], way.max(axis=0), out=best[i])
    return best


def forward_back(score: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From one score a state, ``begin`` [state, row]: best score and the length
    of the last piece at each place [place, row]; 0 where the path begins."""
    longest, starts, rows = score.shape
    best = np.full((starts + longest, rows), NEVER)
    best[:longest] = begin
    back = np.zeros((starts + longest, rows), np.int8)
    lengths, own = np.arange(longest), np.arange(rows)
    for i in range(1, starts + longest):
        lo, hi = max(0, i - longest), min(i, starts)
        if lo >= hi:
            continue
        way = best[lo:hi] + score[i - 1 - lo - lengths[: hi - lo], lo + lengths[: hi - lo]]
        k = way.argmax(axis=0)  # earliest start first: it wins ties
        top = way[k, own]
        better = top > best[i]
        best[i] = np.where(better, top, best[i])
        back[i] = np.where(better, i - lo - k, 0)
    return best, back


def _together(sizes: list[int], most: int = 64):
    """Numbers of chunks of one size, some at a time."""
    by: dict[int, list[int]] = {}
    for k, s in enumerate(sizes):
        by.setdefault(s, []).append(k)
    for width, at in sorted(by.items()):
        for a in range(0, len(at), most):
            yield width, at[a : a + most]


def transfer(v: Vocabulary, texts: list[str], sizes: list[int]) -> np.ndarray:
    """Each chunk's matrix [left state, right state]. A chunk's text goes on
    ``longest`` - 1 letters past its ``size`` where the document does."""
    m = v.longest
    out = np.empty((len(texts), m, m))
    for width, some in _together(sizes):
        score, _ = arcs(v, _points([texts[k] for k in some], width + m), width)
        begin = np.full((m, len(some), m), NEVER)
        for s in range(m):
            begin[s, :, s] = 0.0
        out[some] = forward(score, begin)[width : width + m].transpose(1, 2, 0)
    return out


def _points(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint32)
    for k, t in enumerate(texts):
        x = np.frombuffer(t.encode("utf-32-le"), "<u4")
        out[k, : len(x)] = x
    return out


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product: (a b)[i, j] = max over k of a[i, k] + b[k, j]."""
    out = np.empty(a.shape)
    for i in range(0, len(out), 256):
        out[i : i + 256] = (a[i : i + 256, :, :, None] + b[i : i + 256, None, :, :]).max(axis=-2)
    return np.maximum(out, NEVER)


def tree(matrices: np.ndarray) -> list[np.ndarray]:
    """Products of neighbours, level by level, up to that of all."""
    levels = [matrices]
    while (n := len(levels[-1])) > 1:
        t = levels[-1]
        up = maxplus(t[0 : n - 1 : 2], t[1:n:2])
        levels.append(np.concatenate([up, t[n - 1 :]]) if n % 2 else up)
    return levels


def entering(matrices: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """Scores of the states at each chunk's left edge: an exclusive scan, down
    the tree of products from the scores at the first edge."""
    m = matrices.shape[-1]
    if begin is None:
        begin = np.full(m, NEVER)
        begin[0] = 0.0
    now = begin[None, :]
    for t in reversed(tree(matrices)[:-1]):
        down = np.empty((len(t), m))
        down[0::2] = now
        left = len(t) // 2
        down[1::2] = np.maximum((now[:left, :, None] + t[0 : 2 * left : 2]).max(axis=1), NEVER)
        now = down
    return now


Trace = tuple[list[int], list[int], list[list[int]]]


def backtrace(v: Vocabulary, texts: list[str], sizes: list[int], enter: np.ndarray) -> list[Trace]:
    """For each chunk and right state: the left state its path begins from (-1
    if it can't be reached), how many ids it shares with the first such path,
    and the other ids; in the order of states."""
    out: list[Trace] = [([], [], [])] * len(texts)
    for width, some in _together(sizes):
        points = _points([texts[k] for k in some], width + v.longest)
        score, ids = arcs(v, points, width)
        # A left state is reached by a piece of the chunk before, so its score stands.
        best, back = forward_back(score, np.where(enter[some] > NEVER / 2, enter[some], NEVER).T)
        for row, k in enumerate(some):
            out[k] = _trace(v, points[row], width, ids[:, :, row], (best[width:, row] > NEVER / 2).tolist(), back[:, row].tolist())
    return out


def _trace(v: Vocabulary, points: np.ndarray, size: int, ids: np.ndarray, reached: list[bool], back: list[int]) -> Trace:
    left, shared, tails = [], [], []
    knots: dict[int, int] = {}  # places of the first path: ids before each
    first = -1
    for o in range(v.longest):
        i = size + o
        if not reached[o]:
            left.append(-1), shared.append(0), tails.append([])
            continue
        at = []
        while i not in knots and (n := back[i]):
            i -= n
            at.append((i, n))
        at.reverse()
        flat, count = _ids(v, points, ids, at)
        if first < 0:  # paths that meet it go on as it does
            first, done = i, 0
            knots[i] = 0
            for (j, n), c in zip(at, count, strict=True):
                done += c
                knots[j + n] = done
            left.append(i), shared.append(0), tails.append(flat)
        else:
            met = i in knots
            left.append(first if met else i), shared.append(knots[i] if met else 0), tails.append(flat)
    return left, shared, tails


def _ids(v: Vocabulary, points: np.ndarray, ids: np.ndarray, at: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The ids of a path's pieces, and how many each has."""
    if not at:
        return [], []
    j, n = np.array(at).T
    x = ids[n - 1, j].tolist()
    if min(x) >= 0:
        return x, [1] * len(x)
    parts = [[y] if y >= 0 else [int(v.byte_ids[c]) for c in chr(int(points[i])).encode("utf-8", "surrogatepass")] for y, (i, _) in zip(x, at, strict=True)]
    return [y for p in parts for y in p], [len(p) for p in parts]


def assemble(chunks: list[tuple[list[int], list[int], list[list[int]]]]) -> list[int]:
    """The ids of a document from its chunks' paths, last chunk first."""
    state, parts = 0, []
    for left, shared, tails in reversed(chunks):
        first = next(k for k, x in enumerate(left) if x >= 0)
        parts.append(tails[state])
        if state != first:
            parts.append(tails[first][: shared[state]])
        state = left[state]
    return np.concatenate([np.asarray(p, np.int64) for p in reversed(parts)]).tolist() if parts else []


def escaped(text: str) -> str:
    return "▁" + text.replace(" ", "▁") if text else ""


def cut_text(text: str, longest: int, chunk: int = CHUNK) -> list[tuple[str, int]]:
    """(letters with those that follow, size) of each chunk."""
    n = len(text)
    cuts = [*range(0, max(1, n - longest), chunk), n]
    return [(text[a : b + longest - 1], b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def scan_encode(model: bytes, text: str, chunk: int = CHUNK) -> list[int]:
    """One text by the scan alone, in this process."""
    v, text = vocabulary(model), escaped(text)
    if not text:
        return []
    texts, sizes = zip(*cut_text(text, v.longest, chunk), strict=True)
    return assemble(backtrace(v, texts, sizes, entering(transfer(v, texts, sizes))))


@lru_cache(maxsize=1)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _result(ident: str, ids: pa.Array, encoded: list[list[int]], same: list[bool]) -> pa.RecordBatch:
    size = np.fromiter(map(len, encoded), np.int32, len(encoded))
    flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(size.sum()))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(size.astype(np.int64)), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])


def read_model(path: str = MODEL, zipf: bool = True) -> bytes:
    with open(path, "rb") as f:
        return unigram_model(f.read(), zipf)


def encode(docs: DataFrame, model: bytes, giant: int = GIANT, chunk: int = CHUNK, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text again."""
    kind = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
    rows = docs.select(col(docs, ident).cast("long").alias("doc_id"), col(docs, text).alias("text"))

    def plain(batches):
        sp = _processor(model)
        for batch in batches:
            texts, ids = strings(batch, "text"), column(batch, "doc_id")
            for a in range(0, len(texts), 256):
                some = texts.slice(a, 256).to_pylist()
                encoded = sp.encode(some, num_threads=1)
                same = [d == (t.replace("▁", " ") if "▁" in t else t) for d, t in zip(sp.decode(encoded, num_threads=1), some, strict=True)]
                yield _result("doc_id", ids.slice(a, 256), encoded, same)
        trim()

    long = F.coalesce(F.length("text"), F.lit(0)) > giant
    ordinary = rows.where(~long).mapInArrow(plain, kind)
    huge = rows.where(long).groupBy("doc_id", "text").agg(F.count("*").alias("times")).withColumn("key", F.xxhash64("text"))

    def pieces(batches):
        longest = vocabulary(model).longest
        for batch in batches:
            for i, (d, t, k, n) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "key", "times")), strict=True)):
                parts = cut_text(escaped(t), longest, chunk)
                yield pa.record_batch({"doc_id": pa.array([d] * len(parts), pa.int64()), "key": pa.array([k] * len(parts), pa.int64()), "times": pa.array([n] * len(parts), pa.int64()), "k": pa.array(range(len(parts)), pa.int32()), "size": pa.array([s for _, s in parts], pa.int32()), "piece": pa.array([p for p, _ in parts], pa.string())})

    tasks = partitions(docs.sparkSession)
    cutted = huge.mapInArrow(pieces, _CHUNKS)
    cutted = cutted.repartition(tasks, "doc_id", "key", F.floor(F.col("k") / RUN)).sortWithinPartitions("doc_id", "key", "k")

    def matrices(batches):
        v = vocabulary(model)
        for batch in batches:
            t = transfer(v, column(batch, "piece").to_pylist(), column(batch, "size").to_pylist())
            own = [column(batch, c).to_pylist() for c in ("doc_id", "key", "k")]
            begins = [i for i, x in enumerate(zip(*own, strict=True)) if not i or x != (own[0][i - 1], own[1][i - 1], own[2][i - 1] + 1)]
            run, product = np.zeros(len(t), np.int32), [None] * len(t)
            for a, b in zip(begins, [*begins[1:], len(t)], strict=True):
                run[a:b] = own[2][a]
                product[a] = tree(t[a:b])[-1][0].astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run), pa.array([x.astype("<f8").tobytes() for x in t], pa.binary()), pa.array(product, pa.binary())], [*batch.schema.names, "run", "matrix", "product"])
        trim()

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        m = math.isqrt(len(pdf["product"].iloc[0]) // 8)
        vectors = entering(np.frombuffer(b"".join(pdf["product"]), "<f8").reshape(-1, m, m))
        return pd.DataFrame({"d": pdf["d"].astype("Int64"), "h": pdf["h"], "r": pdf["r"], "enter": [x.astype("<f8").tobytes() for x in vectors]})

    def paths(batches):
        v = vocabulary(model)
        m, last, after = v.longest, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.frombuffer(b"".join(column(batch, "matrix").to_pylist()), "<f8").reshape(-1, m, m)
            first = np.frombuffer(b"".join(column(batch, "enter").to_pylist()), "<f8").reshape(-1, m)
            own = list(zip(*(column(batch, c).to_pylist() for c in ("doc_id", "key", "run")), strict=True))
            begins, enter = [i for i in range(len(own)) if not i or own[i] != own[i - 1]], np.empty((len(own), m))
            for a, b in zip(begins, [*begins[1:], len(own)], strict=True):
                # The run may have begun in the batch before.
                enter[a:b] = entering(t[a:b], after if own[a] == last else first[a])
                last, after = own[a], np.maximum((enter[b - 1][:, None] + t[b - 1]).max(axis=0), NEVER)
            got = backtrace(v, column(batch, "piece").to_pylist(), column(batch, "size").to_pylist(), enter)
            same = {c: column(batch, c) for c in ("doc_id", "key", "times", "k")}
            yield pa.record_batch(same | {"left": pa.array([x[0] for x in got], pa.list_(pa.int32())), "shared": pa.array([x[1] for x in got], pa.list_(pa.int32())), "tails": pa.array([x[2] for x in got], pa.list_(pa.list_(pa.int32())))})
        trim()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        sp = _processor(model)
        pdf = pdf.sort_values("k")
        ids = assemble(list(zip(pdf["left"], pdf["shared"], pdf["tails"], strict=True)))
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64")[:1], "key": pdf["key"][:1], "times": pdf["times"][:1], "n_tokens": [len(ids)], "ids": [ids], "hash": [sp.decode(ids)]})

    # Both branches below read the matrices; a run stays within a batch of its task.
    tabled = cut(cutted.mapInArrow(matrices, f"{_CHUNKS}, run int, matrix binary, product binary"))
    products = tabled.where("product is not null")
    enters = products.select(F.col("doc_id").alias("d"), F.col("key").alias("h"), F.col("run").alias("r"), "product").groupBy("d", "h").applyInPandas(combine, "d long, h long, r int, enter binary")
    small = products.count() * 8 * (vocabulary(model).longest + 3) <= BROADCAST_BYTES
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("h")) & (F.col("run") == F.col("r"))
    entered = tabled.join(F.broadcast(enters) if small else enters, same).select("doc_id", "key", "times", "k", "size", "piece", "run", "matrix", "enter")
    if not small:
        entered = entered.sortWithinPartitions("doc_id", "key", "k")
    traced = entered.mapInArrow(paths, "doc_id long, key long, times long, k int, left array<int>, shared array<int>, tails array<array<int>>")
    joined = traced.repartition(tasks, "doc_id", "key").groupBy("doc_id", "key").applyInPandas(join, "doc_id long, key long, times long, n_tokens long, ids array<int>, hash string")
    # The key is the hash of the text, so decoding is checked without the text.
    plainly = huge.select(F.col("doc_id").alias("d"), F.col("key").alias("h"), F.xxhash64(F.translate("text", "▁", " ")).alias("of_text"))
    done = joined.join(plainly, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("h")))
    done = done.select("doc_id", "n_tokens", "ids", (F.xxhash64("hash") == F.col("of_text")).alias("round_trip"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
    return ordinary.unionByName(done)
