"""Approximate nearest neighbours of every vector by collision counting.

Vectors are projected on ``m`` random lines. Along each line the vectors of a
shard are a sorted array; around a query's own projection a window is opened,
whose half-width is ``WIDTH`` times a radius. A vector in at least ``least``
of the m windows collides often enough and is verified by its true distance.
Virtual rehashing widens the windows of the same arrays by the factor ``GROW``
until ``k`` verified neighbours lie within the radius that the windows stand
for; the k-th neighbour in the query's own shard bounds the radius. The threshold ``least`` is set so that a vector within the radius passes
with probability ``PASS``, whatever the data are, so recall doesn't rest on
the data; they only decide how many others are verified in vain.

Every vector is indexed; the queries are those whose id is divisible by
``every``. Shards are stretches of the array sorted along the first line, of a
fixed number of vectors, in the shared folder with their sorted arrays. A task
has the queries of some shards and reads the others one by one. One is left out
if, by the ranges of its projections, none of its vectors can lie in enough
windows. Random directions in 64 dimensions are all about equally far from each
other; there few shards are left out, and work grows as queries times vectors,
as the README says.

Defined results: distances are Euclidean; a vector isn't its own neighbour,
but rows with an equal vector are at distance 0; ties go to the lesser id; a
null id or vector, or one of another length than most, is left out (a null, NaN
or infinity inside counts as 0); fewer than k others give as many as there are; rows
that share an id are one vector, the least in order of its numbers; an empty
table gives an empty result.
"""

from __future__ import annotations

import io
import math
import uuid
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import col, cut, shared_dir
from corvane.llm._vector import column

M = 64
WIDTH = 1.2
GROW = 2.0
PASS = 0.97
LEVELS = 2
SHARD = 4096
BLOCK = 64
#: The queries are the rows whose id this divides; a task has those of so many shards.
EVERY, HOMES = 20, 4
PAIRS = 1 << 16
NONE = -(1 << 63)


def lines(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m)).astype(np.float32)


def threshold(m: int, width: float = WIDTH, chance: float = PASS) -> int:
    """Windows that a vector at the radius itself shares with probability
    ``chance``: the projected difference over the radius is standard normal."""
    p = 2 * NormalDist().cdf(width) - 1
    total = 0.0
    for least in range(m, 0, -1):
        total += math.comb(m, least) * p**least * (1 - p) ** (m - least)
        if total >= chance:
            return least
    return 0


class Shard:
    """Vectors with their projections, and for each line the sorted array."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.vectors, n = ids, vectors, len(ids)
        self.norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        projected = np.ascontiguousarray((vectors @ axes).T)
        kind = np.int16 if n < 32_000 else np.int32
        self.order = np.argsort(projected, axis=1, kind="stable").astype(kind) if order is None else order
        self.sorted = np.take_along_axis(projected, self.order.astype(np.int64), 1)
        self.rank = np.empty(projected.shape, kind)
        np.put_along_axis(self.rank, self.order.astype(np.int64), np.arange(n, dtype=kind)[None, :], 1)

    def pack(self) -> bytes:
        raw = io.BytesIO()
        np.savez(raw, ids=self.ids, vectors=self.vectors, order=self.order)
        return raw.getvalue()

    @classmethod
    def read(cls, where: fs.FileSystem, name: str, axes: np.ndarray) -> Shard:
        with where.open_input_file(name) as f:
            got = np.load(io.BytesIO(f.read()))
        return cls(got["ids"], got["vectors"], axes, got["order"])

    def counts(self, queries: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Windows shared by each query (its projections) and each vector."""
        m = queries.shape[1]
        n = len(self.ids)
        lo = np.empty(queries.shape, np.int64)
        hi = np.empty(queries.shape, np.int64)
        for j in range(m):
            lo[:, j] = np.searchsorted(self.sorted[j], queries[:, j] - half, "left")
            hi[:, j] = np.searchsorted(self.sorted[j], queries[:, j] + half, "right")
        total = np.zeros((len(queries), n), np.uint8 if m < 256 else np.uint16)
        if (hi - lo).sum() < 0.02 * m * n * len(queries):  # narrow windows: walk them
            for q in range(len(queries)):
                inside = np.concatenate([self.order[j, a:b] for j, (a, b) in enumerate(zip(lo[q], hi[q], strict=True))])
                total[q] = np.bincount(inside, minlength=n)
            return total
        rank = self.rank
        lo, span = lo.astype(rank.dtype), (hi - lo).astype(np.uint16 if rank.dtype == np.int16 else np.uint32)
        lo, span = np.ascontiguousarray(lo.T), np.ascontiguousarray(span.T)
        for j in range(m):  # a place minus the window's begin, unsigned, is below its length
            total += (rank[j][None, :] - lo[j][:, None]).view(span.dtype) < span[j][:, None]
        return total


def search(queries: np.ndarray, own: np.ndarray, homes: list[tuple[np.ndarray, Shard]], shards, axes: np.ndarray, k: int, boxes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances [query, k] (NONE and inf where there are fewer).
    ``shards`` gives a shard by number; ``homes`` has the numbers of the queries
    that lie in a shard, and that shard."""
    n, least = len(queries), threshold(axes.shape[1])
    best = np.full((n, k), np.inf)
    found = np.full((n, k), NONE, np.int64)
    projected, norms = queries @ axes, (queries.astype(np.float64) ** 2).sum(axis=1)
    for inside, home in homes:
        for a in range(0, len(inside), BLOCK):
            q = inside[a : a + BLOCK]
            _verify(q, np.ones((len(q), len(home.ids)), bool), queries, norms, own, home, best, found, k)
    # The k-th neighbour at home bounds the last radius; windows widen up to it.
    bound = np.sqrt(best[:, k - 1]) * (1 + 1e-6)
    open_ = np.arange(n)
    for rehash in range(LEVELS):
        radius = bound * GROW ** (rehash + 1 - LEVELS)
        half = WIDTH * radius
        for s, (low, high) in enumerate(boxes):
            p, h = projected[open_], half[open_][:, None]
            some = open_[((p + h >= low) & (p - h <= high)).sum(axis=1) >= least]
            if not len(some):
                continue
            shard = shards(s)
            for a in range(0, len(some), BLOCK):
                q = some[a : a + BLOCK]
                _verify(q, shard.counts(projected[q], half[q]) >= least, queries, norms, own, shard, best, found, k)
        open_ = open_[~(best[open_, k - 1] <= radius[open_] ** 2)]
        if not len(open_):
            break
    return found, best


def _verify(q, hits, queries, norms, own, shard, best, found, k) -> None:
    if hits.mean() > 0.05:
        square = norms[q][:, None] + shard.norms[None, :] - 2.0 * (queries[q] @ shard.vectors.T)
        square = np.where(hits, square, np.inf)
    else:
        r, c = np.nonzero(hits)
        square = np.full(hits.shape, np.inf)
        square[r, c] = norms[q[r]] + shard.norms[c] - 2.0 * np.einsum("ij,ij->i", queries[q[r]], shard.vectors[c])
    square[own[q][:, None] == shard.ids[None, :]] = np.inf
    # A float32 product of this length errs by so much at most; whatever may be among the k by that, ties included, is measured exactly.
    slack = 4 * (queries.shape[1] + 4) * np.finfo(np.float32).eps * (np.sqrt(norms[q] * shard.norms.max(initial=0.0)) + 1e-30)
    limit = best[q, k - 1] + slack
    if k < square.shape[1]:
        limit = np.minimum(limit, np.partition(square, k - 1, axis=1)[:, k - 1] + 2 * slack)
    r, c = np.nonzero(np.isfinite(square) & (square <= limit[:, None]))
    near = np.empty(len(r))
    for a in range(0, len(r), PAIRS):
        i, j = r[a : a + PAIRS], c[a : a + PAIRS]
        near[a : a + PAIRS] = ((queries[q[i]].astype(np.float64) - shard.vectors[j].astype(np.float64)) ** 2).sum(axis=1)
    order = np.lexsort((shard.ids[c], near, r))
    r, c, near = r[order], c[order], near[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    first = place < k
    exact, ids = np.full((len(q), k), np.inf), np.full((len(q), k), NONE, np.int64)
    exact[r[first], place[first]], ids[r[first], place[first]] = near[first], shard.ids[c[first]]
    value, ids = np.concatenate([best[q], exact], axis=1), np.concatenate([found[q], ids], axis=1)
    # A vector seen at a smaller radius comes again: keep it once.
    order = np.lexsort((value, ids), axis=1)
    ids, value = np.take_along_axis(ids, order, 1), np.take_along_axis(value, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    value[again] = np.inf
    ids[~np.isfinite(value)] = NONE
    order = np.lexsort((ids, value), axis=1)[:, :k]
    best[q], found[q] = np.take_along_axis(value, order, 1), np.take_along_axis(ids, order, 1)


def _clean(vectors: DataFrame, ident: str, vector: str) -> tuple[DataFrame, int]:
    rows = vectors.select(col(vectors, ident).cast("long").alias("id"), col(vectors, vector).alias("v")).where("id is not null and v is not null")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    dim = int(size["n"]) if size else 0
    return rows.where(F.size("v") == dim), dim


def _matrix(values, dim: int) -> np.ndarray:
    x = np.array([[0.0 if y is None else y for y in row] for row in values], np.float32) if len(values) else np.zeros((0, dim), np.float32)
    return np.nan_to_num(x.reshape(len(values), dim), nan=0.0, posinf=0.0, neginf=0.0)


def neighbours(vectors: DataFrame, k: int = 10, m: int = M, seed: int = 7, shard: int = SHARD, every: int = EVERY, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, neighbour_id, rank (from 1) and distance for each vector whose
    id is divisible by ``every``, among all vectors."""
    spark: SparkSession = vectors.sparkSession
    kind = "query_id long, neighbour_id long, rank int, distance double"
    rows, dim = _clean(vectors, ident, vector)
    if not dim:
        return spark.createDataFrame([], kind)
    axes = lines(dim, m, seed)
    first = F.aggregate(F.zip_with("v", F.lit([float(x) for x in axes[:, 0]]), lambda a, b: F.coalesce(a, F.lit(0.0)) * b), F.lit(0.0).cast("double"), lambda a, b: a + b)
    rows = cut(rows.withColumn("p", F.coalesce(F.nanvl(first, F.lit(0.0)), F.lit(0.0))))
    n = rows.count()
    parts = max(1, math.ceil(n / shard))
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"

    def build(batches):
        where, path = fs.FileSystem.from_uri(folder)
        ids, vs = [], []
        for batch in batches:
            v = batch.column(1)
            ids.append(batch.column(0).to_numpy())
            flat = v.flatten()
            if flat.null_count or not pa.types.is_floating(flat.type):
                vs.append(_matrix(v.to_pylist(), dim))
            else:
                vs.append(np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim), nan=0.0, posinf=0.0, neginf=0.0))
        if ids:
            i, x = np.concatenate(ids), np.concatenate(vs)
            p = x @ axes
            where.create_dir(path, recursive=True)
            name = f"{path}/{uuid.uuid4().hex}.npz"
            with where.open_output_stream(name) as out:
                out.write(Shard(i, x, axes).pack())
            yield pa.record_batch({"name": pa.array([name]), "low": pa.array([p.min(axis=0).astype("<f4").tobytes()]), "high": pa.array([p.max(axis=0).astype("<f4").tobytes()]), "asked": pa.array([int((i % every == 0).sum())], pa.int64())})

    # Names and ranges of the shards are read by the tasks, so the driver holds nothing that grows.
    rows.repartitionByRange(parts, "p").select("id", "v").mapInArrow(build, "name string, low binary, high binary, asked long").write.parquet(f"{folder}/meta")
    built = spark.read.parquet(f"{folder}/meta")

    def run(batches):
        where, path = fs.FileSystem.from_uri(folder)
        meta = pq.read_table(f"{path}/meta", filesystem=where).sort_by("name")
        names = meta["name"].to_pylist()
        boxes = [(np.frombuffer(a, "<f4"), np.frombuffer(b, "<f4")) for a, b in zip(meta["low"].to_pylist(), meta["high"].to_pylist(), strict=True)]
        held: dict[int, Shard] = {}

        def get(s: int) -> Shard:
            if s not in held:
                if len(held) >= 4:
                    held.pop(next(iter(held)))
                held[s] = Shard.read(where, names[s], axes)
            return held[s]

        def answers(mine: list[Shard]):
            ids, x, homes, done = [], [], [], 0
            for home in mine:
                at = np.flatnonzero(home.ids % every == 0)
                homes.append((np.arange(done, done + len(at)), home))
                ids.append(home.ids[at])
                x.append(home.vectors[at])
                done += len(at)
            own = np.concatenate(ids)
            found, best = search(np.concatenate(x), own, homes, get, axes, k, boxes)
            r, c = np.nonzero(np.isfinite(best))
            return pa.record_batch({"query_id": pa.array(own[r]), "neighbour_id": pa.array(found[r, c]), "rank": pa.array((c + 1).astype(np.int32)), "distance": pa.array(np.sqrt(best[r, c]))})

        mine: list[Shard] = []
        for batch in batches:
            for name in column(batch, "name").to_pylist():
                mine.append(Shard.read(where, name, axes))
                if len(mine) == HOMES:
                    yield answers(mine)
                    mine = []
        if mine:
            yield answers(mine)

    work = built.where("asked > 0").select("name")
    return work.repartition(max(1, math.ceil(parts / HOMES)), "name").mapInArrow(run, kind)
