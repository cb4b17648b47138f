"""Helpers shared by the training-data operators: checkpoints, names, sizes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are broadcast only up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session, as in tests, may have none: a temporary folder is then
    made and set as the checkpoint folder of the context, once. On a cluster a
    missing setting is an error, as a machine's own folder would be lost with it.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have in any letter case."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = "_" + name
    return name


def col(df: DataFrame, name: str):
    """Column by exact name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Semi or anti join of ``docs`` with a narrow table of ids.

    The ids are counted first; they are broadcast only while they take under
    ``BROADCAST_BYTES``, else both sides are shuffled on the id.
    """
    n = ids.count()
    return docs.join(F.broadcast(ids) if n * 24 <= BROADCAST_BYTES else ids, key, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
