"""Feature selection from document counts: contingency tables and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.features import is_packed, rows_of
from corvane.plans.store import stored


def evidence(feats: DataFrame, labels: DataFrame, ident: str = "doc_id", keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """For each label and feature: a, b, c, d = documents of the label with it,
    others with it, of the label without it, others without it; n, n_label."""
    if is_packed(feats):  # a document's features are distinct
        held = rows_of(feats.select(ident, "items").join(labels.select(ident, "label"), ident))
    else:
        held = feats = stored(feats.select(ident, *keys).distinct().join(labels.select(ident, "label"), ident))  # read twice
    docs = labels.join(feats.select(ident).distinct(), ident, "left_semi")
    per = docs.groupBy("label").agg(F.count("*").alias("n_label")).withColumn("n", F.sum("n_label").over(Window.partitionBy()))
    both = stored(held.groupBy("label", *keys).agg(F.count("*").alias("a")))
    n_f = both.groupBy(*keys).agg(F.sum("a").alias("n_feature"))
    every = n_f.crossJoin(F.broadcast(per)).join(both, ["label", *keys], "left").withColumn("a", F.coalesce("a", F.lit(0).cast("long")))
    return every.select("label", *keys, "a", (F.col("n_feature") - F.col("a")).alias("b"), (F.col("n_label") - F.col("a")).alias("c"), (F.col("n") - F.col("n_label") - F.col("n_feature") + F.col("a")).alias("d"), "n", "n_label")


def wfo(lam: float) -> Column:
    """Weighted frequency and odds; lam 0.5 is WLLR, 0 mutual information's
    odds alone, 1 the frequency alone."""
    inside = (F.col("a") + 1) / (F.col("n_label") + 1)
    odds = F.greatest(F.lit(0.0), F.ln(inside / ((F.col("b") + 1) / (F.col("n") - F.col("n_label") + 1))))
    return F.pow(inside, F.lit(float(lam))) * (F.lit(1.0) if lam == 1 else F.pow(odds, F.lit(1.0 - lam)))


def mutual_information(n_labels: Column, literal: bool = False) -> Column:
    """ln of the label's share among a feature's documents over its share among
    all; ``literal`` leaves the feature's documents out of the denominator."""
    below = n_labels + (F.lit(0) if literal else F.col("a") + F.col("b"))
    return F.greatest(F.lit(0.0), F.ln(((F.col("a") + 1) / below) / ((F.col("n_label") + 1) / (F.col("n") + n_labels))))


def top(table: DataFrame, score: Column, limit: int, cutoff: int = 3, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Features in at least ``cutoff`` documents by their best label's score,
    rounded to 6 places; ties by feature."""
    best = table.where(F.col("a") + F.col("b") >= cutoff).groupBy(*keys).agg(F.round(F.max(score), 6).alias("score"))
    return best.orderBy(F.desc("score"), *keys).limit(limit)


def top_per_type(table: DataFrame, score: Column, limit: int, cutoff: int = 3) -> DataFrame:
    best = table.where(F.col("a") + F.col("b") >= cutoff).groupBy("type", "feature").agg(F.round(F.max(score), 6).alias("score"))
    w = Window.partitionBy("type").orderBy(F.desc("score"), "feature")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def frequency_range(feats: DataFrame, lower: int = 3, upper: int = -1) -> DataFrame:
    """Features by their number of occurrences: lower <= tf, and tf < upper
    where upper is above lower."""
    tf = feats.groupBy("feature").agg(F.count("*").alias("tf")).where(F.col("tf") >= lower)
    return tf.where(F.col("tf") < upper) if upper > lower else tf


def apply(feats: DataFrame, chosen: DataFrame, additional: DataFrame | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """Rows whose feature was chosen or is additional. Other types pass; if
    nothing was chosen everything passes."""
    keep = stored(chosen.select("feature"))  # its size is known then: a short one is broadcast
    if keep.isEmpty():
        return feats
    if additional is not None:
        keep = keep.union(additional.select("feature")).distinct()
    if types is None:
        return feats.join(keep, "feature", "left_semi")
    other = ~F.col("type").isin(*types)
    return feats.where(other).unionByName(feats.where(~other).join(keep, "feature", "left_semi"))
