"""Background counts and classification of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions import text as X
from corvane.operators.bayes import Precomputed, best, precomputed_scores
from corvane.operators.contrast import feature_type


def stream_features(docs: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return docs.select(ident, F.explode(X.tokenise(F.col(text), **options)).alias("feature"))


def windowed_counts(docs: DataFrame, time: str, window: str, late: str, text: str = "text") -> DataFrame:
    """Counts of features by window of event time; rows later than ``late`` are
    left out, as the watermark has it."""
    rows = docs.withWatermark(time, late).select(time, F.explode(X.tokenise(F.col(text))).alias("feature"))
    return rows.groupBy(F.window(time, window), feature_type(F.col("feature")).alias("type"), "feature").agg(F.count("*").alias("n"))


def keep_counts(docs: DataFrame, folder: str, checkpoint: str, text: str = "text", **trigger) -> StreamingQuery:
    """Each micro-batch's counts as one folder of a growing table; a batch that is
    run again replaces its own, so nothing is counted twice."""

    def add(batch: DataFrame, number: int) -> None:
        feats = batch.select(F.explode(X.tokenise(F.col(text))).alias("feature"))
        feats.groupBy(feature_type(F.col("feature")).alias("type"), "feature").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kept_counts(spark, folder: str) -> DataFrame:
    from corvane.operators.contrast import with_totals

    return with_totals(spark.read.parquet(folder).groupBy("type", "feature").agg(F.sum("n").alias("n")))


def classify_batches(docs: DataFrame, model: Precomputed, folder: str, checkpoint: str, ident: str = "doc_id") -> StreamingQuery:
    """Labels of a stream's documents, a folder a micro-batch."""

    def label(batch: DataFrame, number: int) -> None:
        feats = stream_features(batch, ident)
        best(precomputed_scores(model, feats, batch, ident), ident=ident).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
