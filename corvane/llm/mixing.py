"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a seeded hash. A document's virtual
finish time is its source's tokens up to and with it, divided by the source's
target weight. In order of finish times the documents make the mixture, which
is cut where the total budget of tokens is used up.

The running sums never need a source in one task: a source's documents fall
into 4096 ranges of the shuffle key, whose totals are summed first, and a
window then runs inside each range. The cut works the same way on ranges of
finish time between its quantiles, whatever the weights are; only the range in
which the budget ends is looked at closely.

Defined results:

* tokens are white-space separated words; a null or empty text has none and
  finishes together with the document before it;
* a source without a weight of its own, null included, has ``default_weight``;
  a weight of 0 leaves its source out, a negative one is an error;
* rows that agree in id, source and tokens have one place in the shuffle: they
  finish together and stay or go together. Rows with a null id come first;
* the longest run of the order that fits the budget stays; an empty table
  stays empty. Other columns are passed through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import col, cut, fresh

DIGITS = 3
BINS = 4096


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s]+")), F.lit(0)).cast("long")


def shuffle_key(ident: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))) 


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    if min([default, *weights.values()]) < 0:
        raise ValueError("a weight is negative")
    if not weights:
        return F.lit(float(default))
    pairs = [F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(source.cast("string"), F.lit("\0"))), F.lit(float(default)))


def queue(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, seed: int = 0, text: str = "text", ident: str = "doc_id", source: str = "source") -> DataFrame:
    """id, source, n_tokens, shuffle key and virtual finish time of each row."""
    rows = docs.select(col(docs, ident).alias("doc_id"), col(docs, source).alias("source"), tokens(col(docs, text)).alias("n_tokens"), shuffle_key(col(docs, ident), seed).alias("mix_key"))
    rows = rows.withColumn("weight", _weight(F.col("source"), weights, default_weight)).where("weight > 0").withColumn("part", F.substring("mix_key", 1, DIGITS))
    rows = cut(rows)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "part").agg(F.sum("n_tokens").alias("of_part")).select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "part").orderBy("mix_key", F.col("doc_id").asc_nulls_first(), "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("own", F.sum("n_tokens").over(inside)).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return placed.select("doc_id", "source", "n_tokens", "mix_key", ((F.col("start") + F.col("own")) / F.col("weight")).alias("finish"))


def mix(queued: DataFrame, budget: int) -> DataFrame:
    """The rows of ``queued`` within the budget, with the mixture's tokens so far."""
    cuts = queued.approxQuantile("finish", [k / BINS for k in range(1, BINS)], 0.25 / BINS)
    splits = [-math.inf, *(sorted(set(cuts)) or [0.0]), math.inf]
    binned = Bucketizer(splits=splits, inputCol="finish", outputCol="bin").transform(queued).withColumn("bin", F.col("bin").cast("int"))
    sums = binned.groupBy("bin").agg(F.sum("n_tokens").alias("of_bin")).orderBy("bin").collect()  # BINS + 1 rows at most
    starts, so_far, last = [], 0, BINS + 1
    for r in sums:
        starts.append((r["bin"], so_far))
        so_far += r["of_bin"]
        if so_far > budget:
            last = r["bin"]
            break
    spark = queued.sparkSession
    begin = spark.createDataFrame(starts, "bin int, start long")
    order = Window.partitionBy("bin").orderBy("finish", F.col("source").asc_nulls_first(), "mix_key", F.col("doc_id").asc_nulls_first(), "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = binned.where(F.col("bin") <= last).withColumn("own", F.sum("n_tokens").over(order)).join(F.broadcast(begin), "bin")
    return kept.withColumn("mixed_tokens", F.col("start") + F.col("own")).where(F.col("mixed_tokens") <= budget).drop("bin", "own", "start")


def mixture(docs: DataFrame, weights: dict[str, float], budget_share: float = 1.0, default_weight: float = 1.0, seed: int = 0, text: str = "text", ident: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixture of ``budget_share`` of all tokens, in its order: id, source,
    n_tokens, finish, mixed_tokens."""
    queued = cut(queue(docs, weights, default_weight, seed, text, ident, source))
    total = queued.agg(F.sum("n_tokens")).first()[0] or 0
    out = mix(queued, int(total * budget_share))
    return out.orderBy("finish", F.col("source").asc_nulls_first(), "mix_key", F.col("doc_id").asc_nulls_first(), "n_tokens").drop("mix_key")


def take_mixture(docs: DataFrame, weights: dict[str, float], budget_share: float = 1.0, default_weight: float = 1.0, seed: int = 0, text: str = "text", ident: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are in the mixture, all columns.

    Inside a source finish times follow the shuffle, so what stays of a source
    is all up to one last place: each row is tested against its source's last
    place, and no text is shuffled.
    """
    queued = cut(queue(docs, weights, default_weight, seed, text, ident, source))
    total = queued.agg(F.sum("n_tokens")).first()[0] or 0
    place = F.struct(F.col("mix_key"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("i"), F.col("n_tokens"))
    last = mix(queued, int(total * budget_share)).groupBy("source").agg(F.max(place).alias("last"))
    s, at = fresh(docs, "mix_source"), fresh(docs, "mix_last")
    last = last.select(F.col("source").alias(s), F.col("last").alias(at))
    own = F.struct(shuffle_key(col(docs, ident), seed).alias("mix_key"), F.coalesce(col(docs, ident), F.lit(-(1 << 63))).alias("i"), tokens(col(docs, text)).alias("n_tokens"))
    return docs.join(last, col(docs, source).eqNullSafe(F.col(s))).where(own <= F.col(at)).drop(s, at)
