"""Rooted n-grams: what stands around a word, as counts, pruned and ranked."""

from __future__ import annotations

from functools import cmp_to_key, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.store import stored

MOST = 6


def surroundings(toks: DataFrame, roots: list[str], most: int = MOST, ident: str = "doc_id") -> DataFrame:
    """root, left, right: up to most - 1 tokens before and most - 2 after each
    occurrence of a root. ``toks`` has a row a token, or ``forms``, a document's
    tokens in one array: then nothing is shuffled."""
    if most < 2:
        raise ValueError("n-grams need at least two tokens")
    if "forms" not in toks.columns:
        toks = toks.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("pos", "form"))).alias("t")).select(F.transform("t", lambda x: x["form"]).alias("forms"))
    size, none = F.size("forms"), F.array().cast("array<string>")
    word = lambda j: F.element_at("forms", j)
    span = lambda a, b: F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), word)).otherwise(none)
    at = F.when(size > 0, F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: word(i).isin(*roots))).otherwise(F.array().cast("array<int>"))
    each = F.transform("at", lambda i: F.struct(word(i).alias("root"), span(F.greatest(i - F.lit(most - 1), F.lit(1)), i - 1).alias("left"), span(i + 1, F.least(i + F.lit(most - 2), size)).alias("right")))
    return toks.select("forms", at.alias("at")).select(F.inline(each))


def _ngram(r: Column, f: Column) -> Column:
    """Of a row of ``surroundings``: r tokens, the root, f tokens."""
    return F.array_join(F.concat(F.slice("left", F.size("left") - r + 1, r), F.array("root"), F.slice("right", F.lit(1), f)), " ")


def rooted_counts(toks: DataFrame, roots: list[str], most: int = MOST, ident: str = "doc_id") -> DataFrame:
    """root, r, f, ngram, n: of each n-gram with r tokens before the root and f
    after it. With none before it may have most - 1 tokens, else most."""
    near = surroundings(toks, roots, most, ident)
    before = near.select("root", "left", "right", F.explode(F.sequence(F.lit(0), F.size("left"))).alias("r"))
    after = F.when(F.col("r") == 0, F.size("right")).otherwise(F.least(F.size("right"), F.lit(most - 1) - F.col("r")))
    each = before.select("root", "left", "right", "r", F.explode(F.sequence(F.lit(0), after)).alias("f"))
    return each.groupBy("root", "r", "f", _ngram(F.col("r"), F.col("f")).alias("ngram")).agg(F.count("*").alias("n"))


def _bad(least: int, leaf: float, levels: tuple[int, int, int]) -> Column:
    """Of a row with n, its parent's pn, its siblings' total and number."""
    share = F.col("n") / F.col("pn")
    bound = F.when(F.col("tot") < levels[0], 1.0).when(F.col("tot") < levels[1], 0.75).when(F.col("tot") < levels[2], 0.5).otherwise(F.greatest(1.0 / F.col("choices"), F.lit(leaf)))
    return (F.col("tot") == F.col("choices")) | (F.col("n") < least) | ((share < 1) & (share <= bound))


def rooted_pruned(toks: DataFrame, roots: list[str], least: int = 4, leaf: float = 0.2, levels: tuple[int, int, int] = (5, 7, 15), most: int = MOST, ident: str = "doc_id") -> DataFrame:
    """``pruned(rooted_counts(...))``, counted from the root outwards: only
    children of n-grams that stay are counted at all, as those of others go with
    them. With a leaf share of 0.2 an n-gram keeps at most four children a side,
    so what stays, and is joined, doesn't grow with the texts."""
    near = stored(surroundings(toks, roots, most, ident))
    key = ("root", "r", "f", "ngram")
    alive = stored(near.groupBy("root").agg(F.count("*").alias("n")).select("root", F.lit(0).alias("r"), F.lit(0).alias("f"), F.col("root").alias("ngram"), "n"))
    out = [alive]
    for _ in range(most - 1):
        shapes = [(x.r, x.f) for x in alive.select("r", "f").distinct().collect()]  # at most one a size of n-gram
        if not shapes:
            break
        shape = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(f).alias("f")) for r, f in shapes])).alias("s")
        r, f = F.col("r"), F.col("f")
        hits = near.select("root", "left", "right", shape).select("root", "left", "right", "s.r", "s.f").where((r <= F.size("left")) & (f <= F.size("right")))
        hits = hits.withColumn("ngram", _ngram(r, f)).join(alive.withColumnRenamed("n", "pn"), list(key))
        ahead = (f < F.size("right")) & (f + F.when(r == 0, 2).otherwise(r + 1) < most)
        back = (f == 0) & (r < F.size("left")) & (r + 1 < most)
        kid = lambda r, f, text: F.struct(r.alias("kr"), f.alias("kf"), text.alias("kid"))
        both = F.array(F.when(ahead, kid(r, f + 1, F.concat_ws(" ", "ngram", F.get("right", f)))), F.when(back, kid(r + 1, f, F.concat_ws(" ", F.get("left", F.size("left") - r - 1), F.col("ngram")))))
        kids = hits.select(*key, "pn", F.inline(F.filter(both, lambda x: x.isNotNull()))).groupBy(*key, "pn", "kr", "kf", "kid").agg(F.count("*").alias("n"))
        sums = kids.groupBy(*key, "kr", "kf").agg(F.sum("n").alias("tot"), F.count("*").alias("choices"))
        kept = kids.join(sums, [*key, "kr", "kf"]).where(~_bad(least, leaf, levels))
        alive = stored(kept.select("root", F.col("kr").alias("r"), F.col("kf").alias("f"), F.col("kid").alias("ngram"), "n"))
        out.append(alive)
    return reduce(DataFrame.unionByName, out)


def with_parents(counts: DataFrame) -> DataFrame:
    """Each n-gram with its parent: one token less at the far end, first of
    those after the root. ``forward`` tells the two kinds of children apart."""
    f, r = F.col("f"), F.col("r")
    cut_last = F.regexp_replace("ngram", r" [^ ]+$", "")
    cut_first = F.regexp_replace("ngram", r"^[^ ]+ ", "")
    return counts.withColumn("parent", F.when(f > 0, cut_last).when(r > 0, cut_first)).withColumn("forward", f > 0)


def pruned(counts: DataFrame, least: int = 4, leaf: float = 0.2, levels: tuple[int, int, int] = (5, 7, 15), most: int = MOST) -> DataFrame:
    """Without children that are rare among their siblings, and their children.
    Siblings that are all single go; else a child goes below ``least`` or, if
    not alone, at a share of its parent up to a bound that falls as the
    siblings' total passes the levels."""
    t = with_parents(counts)
    same = Window.partitionBy("root", "parent", F.when(F.col("forward"), F.col("r")).otherwise(F.col("r") - 1), F.when(F.col("forward"), F.col("f") - 1).otherwise(F.col("f")), "forward")
    up_r, up_f = F.when(F.col("forward"), F.col("r")).otherwise(F.col("r") - 1), F.when(F.col("forward"), F.col("f") - 1).otherwise(F.col("f"))
    above = counts.select(F.col("root").alias("p_root"), F.col("r").alias("p_r"), F.col("f").alias("p_f"), F.col("ngram").alias("p_ngram"), F.col("n").alias("pn"))
    joined = t.join(above, (F.col("root") == F.col("p_root")) & (F.col("parent") == F.col("p_ngram")) & (up_r == F.col("p_r")) & (up_f == F.col("p_f")), "left").select("root", "r", "f", "ngram", "n", "parent", "forward", "pn")
    tot, choices = F.sum("n").over(same), F.count("*").over(same)
    bad = _bad(least, leaf, levels)
    tested = joined.withColumn("tot", tot).withColumn("choices", choices).withColumn("ok", F.col("parent").isNull() | ~bad)
    kept = stored(tested.select("root", "r", "f", "ngram", "n", "parent", "forward", "ok"))
    # An n-gram stays if all its ancestors do: one semi-join a level.
    alive = kept.where("r = 0 and f = 0 and ok")
    out = alive
    for size in range(2, most + 1):
        level = kept.where((F.col("r") + F.col("f") + 1 == size) & F.col("ok"))
        up = alive.select(F.col("root").alias("u_root"), F.col("r").alias("u_r"), F.col("f").alias("u_f"), F.col("ngram").alias("u_ngram"))
        alive = level.join(up, (F.col("root") == F.col("u_root")) & (F.col("parent") == F.col("u_ngram")) & (F.when(F.col("forward"), F.col("r")).otherwise(F.col("r") - 1) == F.col("u_r")) & (F.when(F.col("forward"), F.col("f") - 1).otherwise(F.col("f")) == F.col("u_f")), "left_semi")
        alive = stored(alive)  # else each level would do all before it again
        out = out.unionByName(alive)
    return out.select("root", "r", "f", "ngram", "n")


def rank_rooted(rows: list[tuple[int, int, str, int]], root: str, k: int, least: int = 1, stopwords: frozenset = frozenset()) -> list[str]:
    """The k best n-grams (r, f, text, n) of one root. Two n-grams are compared
    by the counts of the branches that part them; then fewer stop words, then
    not ending in one; an n-gram yields to those that extend it."""
    count = {(r, f, tuple(text.split(" "))): n for r, f, text, n in rows}

    def path(key):
        r, f, words = key
        out = []
        for a in range(r + 1):
            out.append((a, 0, words[r - a : r + 1]))
        for b in range(1, f + 1):
            out.append((r, b, words[: r + 1 + b]))
        return out

    paths = {k_: path(k_) for k_ in count}

    def compare(x, y):
        p, q = paths[x], paths[y]
        i = 0
        while i < min(len(p), len(q)) and p[i] == q[i]:
            i += 1
        if i == len(p) or i == len(q):
            return (len(p) > len(q)) - (len(p) < len(q)) and (-1 if len(p) > len(q) else 1)
        a, b = count.get(p[i], 0), count.get(q[i], 0)
        if a != b:
            return -1 if a > b else 1
        s, t = (sum(w in stopwords for w in z[2]) for z in (x, y))
        if s != t:
            return -1 if s < t else 1
        s, t = (z[2][-1] in stopwords for z in (x, y))
        return s - t if s != t else (x[2] > y[2]) - (x[2] < y[2])

    best = sorted(sorted(count), key=cmp_to_key(compare))[:k]
    out = [" ".join(x[2]) for x in best if len(x[2]) >= least]
    return out or ([root] if least <= 1 else [])


def top_rooted(counts: DataFrame, k: int = 10, least: int = 1, stopwords: list[str] | None = None) -> DataFrame:
    """root, rank, ngram. The comparison isn't a sort key, so a root's n-grams
    are ranked together."""
    stops = frozenset(stopwords or ())

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        root = pdf["root"].iloc[0]
        got = rank_rooted(list(zip(pdf["r"], pdf["f"], pdf["ngram"], pdf["n"], strict=True)), root, k, least, stops)
        return pd.DataFrame({"root": pd.Series([root] * len(got), dtype=object), "rank": pd.Series(range(1, len(got) + 1), dtype="int64"), "ngram": pd.Series(got, dtype=object)})

    return counts.groupBy("root").applyInPandas(rank, "root string, rank long, ngram string")
