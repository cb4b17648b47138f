"""Active learning: which documents and features to label next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.features import rows_of, slim
from corvane.plans.store import stored


def shuffled(docs: DataFrame, seed: int = 0, ident: str = "doc_id") -> DataFrame:
    return docs.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string"))), ident)


def entropy(p: Column) -> Column:
    return F.when(p > 1e-7, -p * F.ln(p)).otherwise(0.0)


def uncertain(posterior: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Documents by the entropy of their labels, highest first."""
    return posterior.groupBy(ident).agg(F.round(F.sum(entropy(F.col("p"))), 6).alias("entropy")).orderBy(F.desc("entropy"), ident)


def common_features(df: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The k features of most documents, offered to every label."""
    best = df.orderBy(F.desc("df"), "feature").limit(k)
    return best.crossJoin(F.broadcast(labels.select("label").distinct()))


def _h(p: Column) -> Column:
    q = 1 - p
    return F.when((p <= 0) | (q <= 0), 0.0).otherwise(-p * F.ln(p) - q * F.ln(q))


def information_gain() -> Column:
    """Of a row of ``select.evidence``: what knowing the feature tells of the
    label against the rest; a part without documents adds nothing."""
    n, with_f, without = F.col("n"), F.col("a") + F.col("b"), F.col("c") + F.col("d")
    have = F.when(with_f > 0, with_f / n * _h(F.try_divide(F.col("a"), with_f))).otherwise(0.0)
    lack = F.when(without > 0, without / n * _h(F.try_divide(F.col("c"), without))).otherwise(0.0)
    return _h(F.col("n_label") / n) - have - lack


def correlation(feats: DataFrame, soft: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Share of each label's (soft, by occurrences) feature mass that a feature
    has, and the feature's highest such share of any label."""
    rows = rows_of(slim(feats, ident).join(soft.select(ident, "label", "p"), ident))
    joint = stored(rows.groupBy("label", "feature").agg(F.sum(F.col("p") * F.col("n")).alias("joint")))
    total = joint.groupBy("label").agg(F.sum("joint").alias("total"))
    share = joint.join(F.broadcast(total), "label").withColumn("share", F.try_divide("joint", "total"))
    return share.withColumn("most", F.max("share").over(Window.partitionBy("feature"))).select("label", "feature", "share", "most")


def query_features(gains: DataFrame, shares: DataFrame, k: int, labelled: DataFrame | None = None, closeness: float = 0.75) -> DataFrame:
    """Each label's k features of highest gain that aren't labelled already and
    go with this label at least nearly as much as with any other."""
    g = gains if labelled is None else gains.join(labelled, ["label", "feature"], "left_anti")
    w = Window.partitionBy("label").orderBy(F.desc("gain"), "feature")
    best = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(shares, ["label", "feature"]).where(F.col("share") > closeness * F.col("most")).select("label", "feature", "gain", "rank")


def alpha(fraction: Column, low: float = 0.01, high: float = 50.0, before: float = 0.0, saturated: float = 0.1) -> Column:
    """Pseudo-count for a feature by the share of documents that hold it."""
    slope = (high - low) / (max(saturated, before + 1e-4) - before)
    return F.greatest(F.lit(low), F.least(F.lit(high), (fraction - before) * slope + low))


def alpha_by_indicativeness(share: Column, alpha_value: Column, low: float = 0.01) -> Column:
    return (alpha_value - low) * share + low
