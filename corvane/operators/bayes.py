"""Multinomial Naive Bayes as tables: counts by groupBy, scores by joins.

A model is two small tables: ``labels`` (label, doc_count, token_count,
label_alpha, multiplier, alpha_total) and ``joint`` (label, feature, n, alpha).
Only pairs that occur are kept; what every other pair would score follows from
the label alone, so nothing grows with labels times vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.features import rows_of, sizes, slim
from corvane.plans.store import stored, written

PHI = 1.0
LAMBDA = 5.0
#: As many features at most are broadcast, those of most weight; the rest is shuffled.
HOT = 2**18
#: Sums of as many keys (labels) at most are columns, a row an occurrence; of more, rows.
WIDE = 64


@dataclass(frozen=True)
class Model:
    labels: DataFrame
    joint: DataFrame
    vocab: DataFrame
    phi: float = PHI
    lam: float = LAMBDA
    empirical: bool = True


def fit(feats: DataFrame, labels: DataFrame, weight: str | None = None, alphas: DataFrame | None = None, label_alphas: DataFrame | None = None, multipliers: DataFrame | None = None, ident: str = "doc_id") -> Model:
    """Counts of labelled documents that have a feature at all. ``labels`` has
    (doc_id, label) and perhaps a weight column; a label may be soft, in
    several rows with weights that are probabilities."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = slim(feats, ident).join(labels.select(ident, "label", w.alias("w")).where("label is not null"), ident)
    return _model(rows, alphas, label_alphas, multipliers, ident)


def _model(rows: DataFrame, alphas=None, label_alphas=None, multipliers=None, ident: str = "doc_id") -> Model:
    joint = stored(rows_of(rows).groupBy("label", "feature").agg(F.sum(F.col("w") * F.col("n")).alias("n")))
    per = rows.groupBy("label", ident).agg(F.max("w").alias("w"), F.sum(F.col("w") * sizes(rows)).alias("t")).groupBy("label").agg(F.sum("w").alias("doc_count"), F.sum("t").alias("token_count"))
    per = stored(per)
    return _assemble(joint, per, alphas, label_alphas, multipliers)


def _assemble(joint, per, alphas=None, label_alphas=None, multipliers=None) -> Model:
    if alphas is not None:
        joint = joint.join(alphas, ["label", "feature"], "full").select("label", "feature", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("alpha", F.lit(0.0)).alias("alpha"))
        total = joint.groupBy("label").agg(F.sum("alpha").alias("alpha_total"))
        per = per.join(total, "label", "left")
    else:
        joint = joint.withColumn("alpha", F.lit(0.0))
        per = per.withColumn("alpha_total", F.lit(0.0))
    per = per.join(label_alphas, "label", "left") if label_alphas is not None else per.withColumn("label_alpha", F.lit(0.0))
    per = per.join(multipliers, "label", "left") if multipliers is not None else per.withColumn("multiplier", F.lit(1.0))
    per = per.na.fill({"label_alpha": 0.0, "multiplier": 1.0, "alpha_total": 0.0, "doc_count": 0.0, "token_count": 0.0})
    return Model(per, joint, joint.select("feature").distinct())


def priors(m: Model) -> DataFrame:
    raw = F.col("multiplier") * (m.lam + F.col("label_alpha") + (F.col("doc_count") if m.empirical else F.lit(1.0)))
    return m.labels.withColumn("raw", raw).withColumn("prior", F.col("raw") / F.sum("raw").over(Window.partitionBy()))


def bases(m: Model) -> DataFrame:
    """Of each label: log prior, the denominator, and the log likelihood of a
    known feature that never occurred with it."""
    size = m.vocab.agg(F.count("*").alias("v"))
    denom = F.col("alpha_total") + m.phi * F.col("v") + F.col("token_count")
    return priors(m).crossJoin(size).select("label", F.ln("prior").alias("log_prior"), denom.alias("denom"), F.ln(m.phi / denom).alias("base"))


def loglik(m: Model) -> DataFrame:
    """label, feature, loglik of the pairs that occur or have an alpha."""
    return m.joint.join(m.vocab, "feature", "left_semi").join(F.broadcast(bases(m)), "label").select("label", "feature", F.ln((m.phi + F.col("alpha") + F.col("n")) / F.col("denom")).alias("loglik"), "base")


def scores(m: Model, feats: DataFrame, docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """doc_id, label, score for each document and label. Unknown features are
    skipped; a document without known ones has the log priors."""
    base = stored(bases(m))
    terms = m.joint.join(F.broadcast(base), "label").select("label", "feature", F.ln((m.phi + F.col("alpha") + F.col("n")) / F.col("denom")).alias("loglik"), "base")
    known = sums(terms, m.vocab, feats, base.select("label"), ident)
    return docs.select(ident).distinct().join(known, ident, "left").crossJoin(F.broadcast(base)).select(ident, "label", (F.col("log_prior") + F.coalesce(F.col("known"), F.lit(0)) * F.col("base") + _summed("label")).alias("score"))


def sums(terms: DataFrame, vocab: DataFrame | None, feats: DataFrame, among: DataFrame, ident: str = "doc_id", hot: int | None = None) -> DataFrame:
    """id, known, extras: of each document its occurrences of features of the
    vocabulary (of the terms, where it is None), and an array of (*keys, extra),
    the sums of loglik - base over them; keys that have none are left out or 0.
    ``among`` has the keys, its columns.

    Likelihoods of a key add up to 1 at most, so no more than ``hot`` features
    have as many times 1 / hot as there are keys. These are broadcast and summed up
    where the documents are; only occurrences of the other, rare ones are shuffled."""
    keys, n = among.columns, among.count()
    kinds = among.collect() if n <= WIDE else []
    least = max(n, 1) / (hot or HOT)
    d, p = F.col("loglik") - F.col("base"), F.sum(F.exp("loglik")).alias("p")
    if kinds or not n:
        of = lambda k: reduce(and_, [F.col(c).eqNullSafe(F.lit(k[c]).cast(terms.schema[c].dataType)) for c in keys])
        wide = [F.sum(F.when(of(k), d)).alias(f"d{i}") for i, k in enumerate(kinds)]
        rows = terms.withColumn("listed", F.lit(vocab is None))
        rows = rows if vocab is None else rows.unionByName(vocab.select("feature", F.lit(True).alias("listed")), allowMissingColumns=True)
        own = rows.groupBy("feature").agg(F.max("listed").alias("listed"), p, *wide).where("listed")
        held = [F.coalesce(f"d{i}", F.lit(0.0)).alias(f"d{i}") for i in range(len(kinds))]
    else:
        nil = F.struct(*[F.lit(None).cast(terms.schema[c].dataType).alias(c) for c in keys], F.lit(1.0).alias("d"))  # counts the known
        own = terms.groupBy("feature").agg(F.collect_list(F.struct(*keys, d.alias("d"))).alias("each"), p)
        own = own if vocab is None else vocab.select("feature").distinct().join(own, "feature", "left")
        held = [F.concat(F.array(nil), F.coalesce("each", F.array().cast(own.schema["each"].dataType))).alias("each")]
    table = stored(own.select("feature", *held, (F.coalesce("p", F.lit(0.0)) >= least).alias("hot")))
    rows, often = rows_of(slim(feats, ident)), table.where("hot").drop("hot")
    near = rows.join(F.broadcast(often), "feature")
    far = rows.join(F.broadcast(often.select("feature")), "feature", "left_anti").join(table.where("not hot").drop("hot"), "feature")
    both = near.unionByName(far)
    if kinds or not n:
        got = both.groupBy(ident).agg(F.sum("n").cast("long").alias("known"), *[F.sum(F.col("n") * F.col(f"d{i}")).alias(f"d{i}") for i in range(len(kinds))])
        extra = [F.struct(*[F.lit(k[c]).cast(terms.schema[c].dataType).alias(c) for c in keys], F.col(f"d{i}").alias("extra")) for i, k in enumerate(kinds)]
        none = F.array().cast("array<struct<" + ",".join(f"{c}:{terms.schema[c].dataType.simpleString()}" for c in keys) + ",extra:double>>")
        return got.select(ident, "known", (F.array(*extra) if extra else none).alias("extras"))
    added = both.select(ident, "n", F.inline("each")).groupBy(ident, *keys).agg(F.sum(F.col("n") * F.col("d")).alias("extra"))
    count = F.col(keys[0]).isNull()
    return added.groupBy(ident).agg(F.max(F.when(count, F.col("extra"))).cast("long").alias("known"), F.collect_list(F.when(~count, F.struct(*keys, "extra"))).alias("extras"))


def _summed(*keys: str) -> Column:
    """Of a row of ``sums``, beside these keys, its extra, 0 if there is none."""
    mine = F.filter("extras", lambda x: reduce(and_, [x[k] == F.col(k) for k in keys]))
    return F.coalesce(F.get(mine, F.lit(0))["extra"], F.lit(0.0))


def posterior(scored: DataFrame, ident: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(ident)
    e = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.select(ident, "label", (F.col("e") / F.sum("e").over(w)).alias("p"))


def best(scored: DataFrame, by: str = "score", ident: str = "doc_id") -> DataFrame:
    """The label of the highest score rounded to 6 places, ties by label."""
    w = Window.partitionBy(ident).orderBy(F.round(by, 6).desc(), "label")
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").select(ident, "label")


def length_normalised(scored: DataFrame, feats: DataFrame, ident: str = "doc_id") -> DataFrame:
    s = slim(feats, ident)
    size = s.groupBy(ident).agg(F.sum(sizes(s)).alias("size"))
    return scored.join(size, ident).select(ident, "label", (F.col("score") / F.col("size")).alias("score"))


def feature_count(m: Model) -> DataFrame:
    return m.joint.groupBy("feature").agg(F.sum(F.col("n") + F.col("alpha")).alias("count"))


def trim(m: Model, least: float) -> Model:
    """Rare features leave the vocabulary; label totals stay."""
    return replace(m, vocab=feature_count(m).where(F.col("count") >= least).select("feature").join(m.vocab, "feature", "left_semi"))


def unlabel(m: Model, feature: str) -> Model:
    """Take a feature's pseudo-counts away; it leaves the vocabulary if unseen."""
    gone = F.col("feature") == feature
    lost = m.joint.where(gone).groupBy("label").agg(F.sum("alpha").alias("lost"))
    labels = m.labels.join(lost, "label", "left").withColumn("alpha_total", F.col("alpha_total") - F.coalesce("lost", F.lit(0.0))).drop("lost")
    joint = m.joint.withColumn("alpha", F.when(gone, 0.0).otherwise(F.col("alpha"))).where(~gone | (F.col("n") > 0))
    return replace(m, labels=labels, joint=joint, vocab=joint.select("feature").distinct().join(m.vocab, "feature", "left_semi"))


def kld(m: Model) -> DataFrame:
    """Pairwise divergence in bits between the labels' smoothed likelihoods."""
    full = m.vocab.crossJoin(F.broadcast(bases(m).select("label", "base"))).join(loglik(m).select("label", "feature", "loglik"), ["label", "feature"], "left").select("label", "feature", F.coalesce("loglik", "base").alias("l"))
    a, b = full.select("feature", F.col("label").alias("label_a"), F.col("l").alias("a")), full.select("feature", F.col("label").alias("label_b"), F.col("l").alias("b"))
    return a.join(b, "feature").groupBy("label_a", "label_b").agg(F.sum(F.exp("a") * (F.col("a") - F.col("b")) / F.ln(F.lit(2.0))).alias("kld"))


def em_counts(m: Model, feats: DataFrame, docs: DataFrame, weight: float = 0.1, ident: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Expected counts of unlabelled documents: (label, feature, n) and
    (label, doc_count, token_count)."""
    soft = posterior(scores(m, feats, docs, ident), ident).select(ident, "label", (F.col("p") * weight).alias("w"))
    soft, s = stored(soft), slim(feats, ident)
    joint = rows_of(s.join(soft, ident)).groupBy("label", "feature").agg(F.sum(F.col("w") * F.col("n")).alias("n"))
    size = s.groupBy(ident).agg(F.sum(sizes(s)).alias("size"))
    per = soft.join(size, ident).groupBy("label").agg(F.sum("w").alias("doc_count"), F.sum(F.col("w") * F.col("size")).alias("token_count"))
    return joint, per


def em_step(m: Model, scorer: Model, feats: DataFrame, docs: DataFrame, weight: float = 0.1, ident: str = "doc_id") -> Model:
    """One pass: the expected counts under ``scorer`` are added to ``m``."""
    joint, per = em_counts(scorer, feats, docs, weight, ident)
    j = m.joint.join(joint.withColumnRenamed("n", "more"), ["label", "feature"], "full").select("label", "feature", (F.coalesce("n", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("n"), F.coalesce("alpha", F.lit(0.0)).alias("alpha"))
    p = per.select("label", F.col("doc_count").alias("d"), F.col("token_count").alias("t"))
    labels = m.labels.join(p, "label", "left").withColumn("doc_count", F.col("doc_count") + F.coalesce("d", F.lit(0.0))).withColumn("token_count", F.col("token_count") + F.coalesce("t", F.lit(0.0))).drop("d", "t")
    j = stored(j)
    return replace(m, labels=stored(labels), joint=j, vocab=j.select("feature").distinct())


def train_no_em(feats, labels, **options) -> Model:
    return fit(feats, labels, **options)


def train_bootstrap_em(feats, labels, pool_feats, pool, weight: float = 0.1, **options) -> Model:
    """The model with its pseudo-counts scores the pool and takes its counts."""
    m = fit(feats, labels, **options)
    return em_step(m, m, pool_feats, pool, weight)


def train_standard_em(feats, labels, pool_feats, pool, weight: float = 0.1, alphas=None, **options) -> Model:
    """The pool is scored by a model of the pseudo-counts alone; they enter the
    result too."""
    m = fit(feats, labels, alphas=alphas, **options)
    if alphas is None:
        return em_step(m, m, pool_feats, pool, weight)
    zero = m.labels.withColumn("doc_count", F.lit(0.0)).withColumn("token_count", F.lit(0.0))
    only = m.joint.where("alpha > 0").withColumn("n", F.lit(0.0))
    return em_step(m, replace(m, labels=zero, joint=only, vocab=only.select("feature").distinct()), pool_feats, pool, weight)


def one_vs_rest(feats: DataFrame, labels: DataFrame, ident: str = "doc_id", alphas: DataFrame | None = None, label_alphas: DataFrame | None = None, multipliers: DataFrame | None = None, empirical: bool = True) -> DataFrame:
    """Scores of each label against all others: doc_id, target, label, score,
    where label is the target or OTHER. All learners are fitted at once; with two
    labels or less there is one, whose target is the greater label. Alphas,
    label alphas and multipliers of a label go to the side that stands for it in
    each learner, those of the others to OTHER there."""
    targets = labels.select(F.col("label").alias("target")).where("label is not null").distinct()
    names = labels.where("label is not null").select("label").distinct()
    targets = targets.crossJoin(F.broadcast(names.agg(F.count("*").alias("kinds"), F.max("label").alias("last")))).where("kinds > 2 or target = last").select("target")

    def sides(table: DataFrame) -> DataFrame:
        own = F.when(F.col("label") == F.col("target"), F.col("target")).otherwise(F.lit("OTHER"))
        return table.crossJoin(F.broadcast(targets)).withColumn("side", own)

    targets = stored(targets)
    held = slim(feats, ident).join(labels.select(ident, "label"), ident)
    counts = rows_of(held).groupBy("label", "feature").agg(F.sum("n").alias("n"))
    names = [r.target for r in targets.limit(WIDE + 1).collect()]
    if alphas is None and len(names) <= WIDE and "OTHER" not in names:  # a feature's counts in one row
        of = [F.sum(F.when(F.col("label") == F.lit(t), F.col("n")).otherwise(0)).alias(f"n{i}") for i, t in enumerate(names)]
        per = stored(counts.groupBy("feature").agg(F.sum("n").alias("every"), *of))
        both = [F.struct(F.lit(t).alias("target"), side.alias("side"), n.alias("n")) for i, t in enumerate(names) for side, n in ((F.lit(t), F.col(f"n{i}")), (F.lit("OTHER"), F.col("every") - F.col(f"n{i}")))]
        joint = per.select("feature", F.inline(F.array(*both))).where("n > 0") if names else sides(counts).select("target", "side", "feature", "n")
        v = per.agg(F.count("*").alias("v"))
    else:
        joint, v = sides(stored(counts)).groupBy("target", "side", "feature").agg(F.sum("n").alias("n")), None
    docs = sides(held.select("label", ident).distinct()).select("target", "side", ident).distinct().groupBy("target", "side").agg(F.count("*").alias("docs"))
    size = joint.groupBy("target", "side").agg(F.sum("n").alias("total"))
    if alphas is not None:
        more = sides(alphas).groupBy("target", "side", "feature").agg(F.sum("alpha").alias("alpha"))
        joint = joint.join(more, ["target", "side", "feature"], "full").na.fill({"n": 0, "alpha": 0.0})
        size = size.join(more.groupBy("target", "side").agg(F.sum("alpha").alias("alpha_total")), ["target", "side"], "full").na.fill({"total": 0, "alpha_total": 0.0})
    else:
        joint, size = joint.withColumn("alpha", F.lit(0.0)), size.withColumn("alpha_total", F.lit(0.0))
    joint = stored(joint) if v is None else joint
    base = docs.join(size, ["target", "side"])
    base = base.join(sides(label_alphas).groupBy("target", "side").agg(F.sum("label_alpha").alias("label_alpha")), ["target", "side"], "left") if label_alphas is not None else base.withColumn("label_alpha", F.lit(0.0))
    base = base.join(multipliers.select(F.col("label").alias("side"), "multiplier"), "side", "left") if multipliers is not None else base.withColumn("multiplier", F.lit(1.0))
    base = base.na.fill({"label_alpha": 0.0, "multiplier": 1.0})
    v = joint.select("feature").distinct().agg(F.count("*").alias("v")) if v is None else v
    raw = F.col("multiplier") * (LAMBDA + F.col("label_alpha") + (F.col("docs") if empirical else F.lit(1.0)))
    base = base.crossJoin(F.broadcast(v)).withColumn("raw", raw).withColumn("log_prior", F.ln(F.col("raw") / F.sum("raw").over(Window.partitionBy("target")))).withColumn("denom", PHI * F.col("v") + F.col("alpha_total") + F.col("total")).withColumn("base", F.ln(PHI / F.col("denom")))
    base = stored(base)
    lik = joint.join(F.broadcast(base.select("target", "side", "denom", "base")), ["target", "side"]).select("target", "side", "feature", F.ln((PHI + F.col("alpha") + F.col("n")) / F.col("denom")).alias("loglik"), "base")
    known = sums(lik, None, feats, base.select("target", "side"), ident)
    every = feats.select(ident).distinct().join(known, ident, "left").crossJoin(F.broadcast(base.select("target", "side", "log_prior", "base")))
    return every.select(ident, "target", F.col("side").alias("label"), (F.col("log_prior") + F.coalesce("known", F.lit(0)) * F.col("base") + _summed("target", "side")).alias("score"))


def ovr_probabilities(ovr: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Each target's probability against the rest; they needn't add up to 1."""
    w = Window.partitionBy(ident, "target")
    e = ovr.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.withColumn("p", F.col("e") / F.sum("e").over(w)).where("label = target").select(ident, "label", "p")


def sfe(m: Model, pool_feats: DataFrame, pool: DataFrame, feats: DataFrame, docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Semi-supervised frequency estimate: score = log prior + the sum over
    known features of (log likelihood + log P(word) in the pool, 0 if unseen
    - S of the label), S being the summed likelihood of the pool's documents."""
    pool_feats = slim(pool_feats, ident)
    often = stored(rows_of(pool_feats).groupBy("feature").agg(F.sum("n").alias("n")))
    p = often.crossJoin(F.broadcast(often.agg(F.sum("n").alias("total")))).select("feature", (F.col("n") / F.col("total")).alias("p"))
    s = scores(m, pool_feats, pool, ident).groupBy("label").agg(F.sum(F.exp("score")).alias("s"))
    plain = scores(m, feats, docs, ident)
    lp = p.join(m.vocab, "feature", "left_semi").select("feature", F.lit("").alias("pool"), F.ln("p").alias("loglik"), F.lit(0.0).alias("base"))
    words = sums(lp, m.vocab, feats, lp.sparkSession.createDataFrame([("",)], "pool string"), ident).select(ident, "known", F.get("extras", F.lit(0))["extra"].alias("lp"))
    return plain.join(words, ident, "left").join(F.broadcast(s), "label", "left").select(ident, "label", (F.col("score") + F.coalesce("lp", F.lit(0.0)) - F.coalesce("known", F.lit(0)) * F.coalesce("s", F.lit(0.0))).alias("score"))


def marginal_root(n1, n2, n3, n4, pw, pt, steps: int = 100):
    """The probability of a word given the positive class that fits both its
    labelled counts and its overall probability: the root in (0, pw / pt) of
    n1/x + n2/(x-1) + l n3/(l x - k) + l n4/(l x - k + 1), by Newton steps kept
    inside a shrinking bracket. Arrays; NaN where there is no root."""
    n1, n2, n3, n4, pw = (np.asarray(x, float) for x in (n1, n2, n3, n4, pw))
    l, k = pt / (1 - pt), pw / (1 - pt)
    lo, hi = np.zeros_like(pw), np.minimum(pw / pt, 1.0)

    def f(x):
        return n1 / x + n2 / (x - 1) + l * n3 / (l * x - k) + l * n4 / (l * x - k + 1)

    def slope(x):
        return -n1 / x**2 - n2 / (x - 1) ** 2 - l * l * n3 / (l * x - k) ** 2 - l * l * n4 / (l * x - k + 1) ** 2

    with np.errstate(all="ignore"):
        lo, hi = np.maximum(lo, (k - 1) / l), hi.copy()
        x = (lo + hi) / 2
        for _ in range(steps):
            y = f(x)
            up = y > 0  # f falls on the bracket
            lo, hi = np.where(up, x, lo), np.where(up, hi, x)
            new = x - y / slope(x)
            x = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        return np.where((n2 > 0) & (n3 > 0) & (x > 0) & (x <= pw / pt), x, np.nan)


def feature_marginals(feats: DataFrame, labels: DataFrame, pool_feats: DataFrame, positive: str, ident: str = "doc_id") -> DataFrame:
    """feature, p_positive, p_negative (each normalised) for words of the pool
    that are constrained by the labelled counts of a binary problem."""
    rows = rows_of(slim(feats, ident).join(labels, ident)).withColumn("pos", F.when(F.col("label") == positive, F.col("n")).otherwise(0)).withColumn("neg", F.col("n") - F.col("pos"))
    joint = rows.groupBy("feature").agg(F.sum("pos").cast("double").alias("n1"), F.sum("neg").cast("double").alias("n3"))
    total = rows.agg(F.sum("pos").cast("double").alias("tp"), F.sum("neg").cast("double").alias("tn"))
    docs = labels.join(feats.select(ident).distinct(), ident, "left_semi").agg(F.avg((F.col("label") == positive).cast("double")).alias("pt"))
    pooled = rows_of(slim(pool_feats, ident))
    n = pooled.groupBy("feature").agg(F.sum("n").alias("c")).crossJoin(pooled.agg(F.sum("n").alias("t"))).select("feature", (F.col("c") / F.col("t")).alias("pw"))
    table = n.join(joint, "feature").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(docs)).select("feature", "pw", "n1", (F.col("tp") - F.col("n1")).alias("n2"), "n3", (F.col("tn") - F.col("n3")).alias("n4"), "pt")

    def solve(batches):
        for pdf in batches:
            pt = pdf["pt"].to_numpy(float)
            x = marginal_root(pdf["n1"], pdf["n2"], pdf["n3"], pdf["n4"], pdf["pw"], pt)
            y = (pdf["pw"].to_numpy(float) - x * pt) / (1 - pt)
            out = pd.DataFrame({"feature": pdf["feature"], "x": x, "y": y})
            yield out[np.isfinite(x) & (y >= 0)]

    found = table.mapInPandas(solve, "feature string, x double, y double")
    sums = found.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    return found.crossJoin(F.broadcast(sums)).select("feature", F.try_divide("x", "sx").alias("p_positive"), F.try_divide("y", "sy").alias("p_negative"))


def marginal_loglik(m: Model, marginals: DataFrame, positive: str) -> DataFrame:
    """label, feature, loglik, base: the fitted probability where there is one,
    else the model's likelihood. Of two labels ``positive`` has p_positive."""
    p = marginals.select("feature", F.posexplode(F.array("p_positive", "p_negative")).alias("side", "p")).where("p > 0")
    fitted = m.labels.select("label").crossJoin(F.broadcast(p)).where((F.col("label") == positive) == (F.col("side") == 0)).select("label", "feature", F.ln("p").alias("fitted"))
    both = loglik(m).drop("base").join(fitted.join(m.vocab, "feature", "left_semi"), ["label", "feature"], "full")
    return both.join(F.broadcast(bases(m).select("label", "base")), "label").select("label", "feature", F.coalesce("fitted", "loglik").alias("loglik"), "base")


def marginal_scores(m: Model, marginals: DataFrame, positive: str, feats: DataFrame, docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Scores with the fitted probabilities in place of likelihoods."""
    return precomputed_scores(precompute(m, marginal_loglik(m, marginals, positive)), feats, docs, ident)


@dataclass(frozen=True)
class Precomputed:
    """A model as two tables: ``labels`` (label, log_prior, base) and ``terms``
    (label, feature, loglik, base); ``vocab`` has the features it knows."""

    labels: DataFrame
    terms: DataFrame
    vocab: DataFrame


def precompute(m: Model, terms: DataFrame | None = None) -> Precomputed:
    """The tables of a model, or of a variant with other likelihoods, written
    once. The prior follows the model's own flag."""
    return Precomputed(written(bases(m).select("label", "log_prior", "base")), written(loglik(m) if terms is None else terms), written(m.vocab))


def precomputed_scores(p: Precomputed, feats: DataFrame, docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    known = sums(p.terms, p.vocab, feats, p.labels.select("label"), ident)
    return docs.select(ident).distinct().join(known, ident, "left").crossJoin(F.broadcast(p.labels)).select(ident, "label", (F.col("log_prior") + F.coalesce("known", F.lit(0)) * F.col("base") + _summed("label")).alias("score"))


def gender_classifier(names: DataFrame) -> Model:
    """Naive Bayes on first-name features from (gender, name, count), each name
    weighing as often as it was given."""
    from corvane.operators.features import first_name_features

    rows = names.where("gender is not null and name is not null and count > 0").select(F.concat_ws("/", "gender", "name").alias("doc_id"), F.col("gender").alias("label"), "name", F.col("count").cast("double").alias("weight"))
    feats = first_name_features(rows.withColumnRenamed("name", "first"), F.col("first"), "doc_id").select("doc_id", "feature")
    return fit(feats, rows.select("doc_id", "label", "weight"), weight="weight")
