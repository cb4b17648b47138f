"""What sets a target or a cluster apart from a background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.features import rows_of, slim, times
from corvane.plans.store import stored

SMOOTH = 0.1


def feature_type(feature: Column) -> Column:
    return F.when(feature.startswith("#"), "HASH_TAG").when(feature.startswith("@"), "ACCOUNT_TAG").otherwise("WORD")


def typed_counts(feats: DataFrame) -> DataFrame:
    """type, feature, n, and the type's total and number of features."""
    feats = rows_of(feats)
    n = feats.groupBy(feature_type(F.col("feature")).alias("type"), "feature").agg(F.sum(times(feats)).alias("n"))
    return with_totals(n)


def with_totals(counts: DataFrame) -> DataFrame:
    sums = counts.groupBy("type").agg(F.sum("n").alias("total"), F.count("*").alias("size"))  # three rows
    return counts.join(F.broadcast(sums), "type").select(*counts.columns, "total", "size")


def pruned(counts: DataFrame, least: int) -> DataFrame:
    """Counts of at least ``least``, with totals that follow."""
    return with_totals(counts.select("type", "feature", "n").where(F.col("n") >= least))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("type", "feature", "n").unionByName(b.select("type", "feature", "n"))
    return with_totals(both.groupBy("type", "feature").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("type").orderBy(F.desc("n"), "feature")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("type", "feature", "n", "rank")


def ratio(target: DataFrame, background: DataFrame, lam: float | None = None) -> DataFrame:
    """type, feature, score: ln of the smoothed probability in the target over
    that in the background, or, with ``lam``, that weighed against the target's
    own log probability. Features of the target; unseen ones of the background
    have its smoothing alone."""
    size = background.groupBy("type").agg(F.max("total").alias("bt"), F.max("size").alias("bs"))
    rows = target.join(background.select("type", "feature", F.col("n").alias("bn")), ["type", "feature"], "left").join(F.broadcast(size), "type", "left")
    p = F.ln((F.col("n") + SMOOTH) / (F.col("total") + SMOOTH * F.col("size")))
    q = F.ln((F.coalesce("bn", F.lit(0)) + SMOOTH) / (F.coalesce("bt", F.lit(0)) + SMOOTH * F.coalesce("bs", F.lit(1))))
    score = p - q if lam is None else lam * p + (1 - lam) * (p - q)
    return rows.select("type", "feature", score.alias("score"))


def members(vectors: DataFrame, vector: str = "vector", how: str = "max", least: float = 0.0) -> DataFrame:
    """Rows with the clusters they belong to: the (first) highest entry, all
    of at least ``least``, or all of at least the uniform share."""
    if how == "max":
        return vectors.withColumn("cluster", (F.array_position(vector, F.array_max(vector)) - 1).cast("int"))
    bound = F.lit(float(least)) if how == "threshold" else 1.0 / F.size(vector)
    if how not in ("threshold", "uniform"):
        raise ValueError(f"unknown membership {how!r}")
    return vectors.select("*", F.posexplode(vector).alias("cluster", "share")).where(F.col("share") >= bound)


def joint_counts(feats: DataFrame, clusters: DataFrame, ident: str = "doc_id") -> DataFrame:
    """cluster, type, feature, joint: occurrences in the clusters' documents."""
    rows = rows_of(slim(feats, ident).join(clusters.select(ident, "cluster"), ident))
    n = rows.groupBy("cluster", "feature").agg(F.sum("n").alias("joint"))
    return n.select("cluster", feature_type(F.col("feature")).alias("type"), "feature", "joint")


def cluster_counts(feats: DataFrame, clusters: DataFrame, background: DataFrame | None = None, ident: str = "doc_id") -> DataFrame:
    """cluster, type, feature, joint, cluster_total (of the type), and the
    feature's prior: smoothed for words, plain for tags; words from the
    background where one is given."""
    joint = stored(joint_counts(feats, clusters, ident))
    sums = joint.groupBy("cluster", "type").agg(F.sum("joint").alias("cluster_total"))  # three rows a cluster
    joint = joint.join(F.broadcast(sums), ["cluster", "type"])
    own = joint.groupBy("type", "feature").agg(F.sum("joint").alias("n"))
    if background is not None:
        every = rows_of(background)
        every = every.groupBy("feature").agg(F.sum(times(every)).alias("n")).select(feature_type(F.col("feature")).alias("type"), "feature", "n")
        own = own.where("type <> 'WORD'").unionByName(every.where("type = 'WORD'"))
    own = with_totals(stored(own))
    prior = F.when(F.col("type") == "WORD", (F.col("n") + SMOOTH) / (F.col("total") + SMOOTH * F.col("size"))).otherwise(F.col("n") / F.col("total"))
    return joint.join(own.select("type", "feature", prior.alias("prior")), ["type", "feature"])


def top_features(counts: DataFrame, k: int, kind: str = "WORD") -> DataFrame:
    """Each cluster's k features of highest pointwise mutual information."""
    pmi = F.round(F.ln(F.col("joint") / F.col("cluster_total")) - F.ln("prior"), 6)
    w = Window.partitionBy("cluster").orderBy(F.desc("pmi"), "feature")
    return counts.where(F.col("type") == kind).withColumn("pmi", pmi).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("cluster", "feature", "pmi", "rank")


def frequent_features(counts: DataFrame, k: int, kind: str = "WORD") -> DataFrame:
    w = Window.partitionBy("cluster").orderBy(F.desc("joint"), "feature")
    return counts.where(F.col("type") == kind).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("cluster", "feature", "joint", "rank")


def outside_probability(counts: DataFrame) -> DataFrame:
    """P(feature | other clusters)."""
    w, t = Window.partitionBy("type", "feature"), Window.partitionBy("type")
    totals = counts.select("cluster", "type", "cluster_total").distinct().withColumn("others", F.sum("cluster_total").over(t) - F.col("cluster_total"))
    return counts.withColumn("outside", F.sum("joint").over(w) - F.col("joint")).join(F.broadcast(totals.select("cluster", "type", "others")), ["cluster", "type"]).select("cluster", "type", "feature", F.try_divide("outside", "others").alias("p_outside"))


def top_documents(vectors: DataFrame, k: int, vector: str = "vector", ident: str = "doc_id", distance: bool = False) -> DataFrame:
    """Each cluster's k documents of highest share, or of least distance."""
    rows = vectors.select(ident, F.posexplode(vector).alias("cluster", "share")).withColumn("share", F.round(F.col("share").cast("double"), 6))
    w = Window.partitionBy("cluster").orderBy(F.asc("share") if distance else F.desc("share"), ident)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
