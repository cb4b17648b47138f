"""Confusion matrix, precision, recall, F1 and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.store import stored


class EvaluationError(ValueError):
    """A gold label that the classifier doesn't know."""


def confusion(predicted: DataFrame, gold: DataFrame, labels: DataFrame | None = None, ident: str = "doc_id") -> DataFrame:
    """predicted, gold, n for every pair of labels, zeros included."""
    pairs = predicted.select(ident, F.col("label").alias("predicted")).join(gold.select(ident, F.col("label").alias("gold")), ident)
    n = stored(pairs.groupBy("predicted", "gold").agg(F.count("*").alias("n")))  # read twice, predicted once
    if labels is None:
        labels = n.select(F.col("predicted").alias("label")).union(n.select("gold")).distinct()
    elif not n.join(labels, n["gold"] == labels["label"], "left_anti").isEmpty():
        raise EvaluationError("a gold label is unknown")
    every = labels.select(F.col("label").alias("predicted")).crossJoin(labels.select(F.col("label").alias("gold")))
    return every.join(n, ["predicted", "gold"], "left").select("predicted", "gold", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def per_label(matrix: DataFrame) -> DataFrame:
    """precision (1 where nothing was predicted), recall (1 where there is
    none), F1 (0 where both are 0)."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")), F.struct(F.col("gold").alias("label"), F.lit("g").alias("side")))).alias("s"), "n", (F.col("predicted") == F.col("gold")).alias("hit"))
    sums = sides.groupBy("s.label").agg(F.sum(F.when((F.col("s.side") == "p") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(F.col("s.side") == "g", F.col("n")).otherwise(0)).alias("gold"))
    rated = sums.select("label", F.when(F.col("predicted") == 0, 1.0).otherwise(F.try_divide("tp", "predicted")).alias("precision"), F.when(F.col("gold") == 0, 1.0).otherwise(F.try_divide("tp", "gold")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(both == 0, 0.0).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), both)))


def accuracy(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.try_divide(F.sum(F.when(F.col("predicted") == F.col("gold"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))


def hard_labels(soft: DataFrame, ident: str = "doc_id") -> DataFrame:
    """The most probable label; ties, also near-uniform ones, by label."""
    from corvane.operators.bayes import best

    return best(soft, "p", ident)
