"""Connected components of an edge table, named after their least member."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import cut

#: Up to so many edges (16 bytes each) one task unites them in memory.
ONE_TASK = 4_000_000


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """doc_id, group_id and group_size of each id in ``edges`` (a, b).

    Few edges are united in one task; more by alternating large-star and
    small-star steps, each a shuffle on ids, until nothing changes.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_united, "doc_id long, group_id long, group_size long")
    return _sized(_stars(edges))


def _united(batches):
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    ids = np.fromiter(parent, np.int64, len(parent))
    group = np.array([root(x) for x in ids.tolist()], np.int64)
    _, back, size = np.unique(group, return_inverse=True, return_counts=True)
    if len(ids):
        yield pa.record_batch({"doc_id": pa.array(ids), "group_id": pa.array(group), "group_size": pa.array(size[back].astype(np.int64))})


def _stars(edges: DataFrame) -> DataFrame:
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        then = large.join(small, "a")
        then = then.select("a", F.col("m").alias("b")).union(then.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        then = cut(then)
        if then.exceptAll(now).isEmpty() and now.exceptAll(then).isEmpty():
            return then
        now = then


def _sized(stars: DataFrame) -> DataFrame:
    named = stars.select(F.col("a").alias("doc_id"), F.col("b").alias("group_id"))
    named = named.union(named.select("group_id", "group_id")).distinct()
    return named.join(named.groupBy("group_id").agg(F.count("*").alias("group_size")), "group_id").select("doc_id", "group_id", "group_size")
