"""Phrase matching over token tables: joins on n-grams instead of an automaton
over each document; overlapping matches are resolved per document."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.features import item_ngrams


def phrase_matches(toks: DataFrame, phrases: DataFrame, ident: str = "doc_id", lower_case: bool = True) -> DataFrame:
    """doc_id, start, end (exclusive, in token positions), phrase of each place
    where a phrase (column phrase: words joined by spaces) occurs, overlaps
    included. Each phrase length in use is one equi-join."""
    form = F.lower("form") if lower_case else F.col("form")
    table = phrases.select((F.lower("phrase") if lower_case else F.col("phrase")).alias("phrase")).where("phrase is not null and phrase <> ''").distinct().withColumn("words", F.size(F.split("phrase", " ")))
    sizes = [r[0] for r in table.select("words").distinct().orderBy("words").collect()]  # a handful of lengths
    if not sizes:
        return toks.select(ident, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("phrase")).limit(0)
    if "items" in toks.columns:  # arrays: n-grams without a shuffle
        items = toks.select(ident, F.transform("items", lambda t: F.struct(t["pos"].alias("pos"), (F.lower(t["form"]) if lower_case else t["form"]).alias("form"))).alias("items"))
        parts = [item_ngrams(items, n, ident, " ").withColumn("words", F.lit(n)) for n in sizes]
        grams = parts[0]
        for more in parts[1:]:
            grams = grams.unionByName(more)
        grams = grams.withColumnRenamed("feature", "phrase")
    else:
        w = Window.partitionBy(ident).orderBy("pos")
        rows = toks.select(ident, "pos", F.collect_list(form).over(w.rowsBetween(0, sizes[-1] - 1)).alias("ahead"))
        first = table.select(F.split("phrase", " ")[0].alias("first")).distinct()
        rows = rows.withColumn("first", F.col("ahead")[0]).join(first, "first", "left_semi")
        grams = rows.select(ident, "pos", "ahead", F.explode(F.array(*map(F.lit, sizes))).alias("words")).where(F.size("ahead") >= F.col("words"))
        grams = grams.select(ident, "pos", "words", F.array_join(F.slice("ahead", F.lit(1), F.col("words")), " ").alias("phrase"))
    return grams.join(table, ["phrase", "words"]).select(ident, F.col("pos").alias("start"), (F.col("pos") + F.col("words")).alias("end"), "phrase")


def without_overlaps(matches: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Of overlapping matches the longest stays, of equal ones the leftmost."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.assign(size=pdf["end"] - pdf["start"]).sort_values(["size", "start", "phrase"], ascending=[False, True, True])
        taken: set[int] = set()
        keep = []
        for i, a, b in zip(order.index, order["start"], order["end"], strict=True):
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                keep.append(i)
        return pdf.loc[sorted(keep)]

    return matches.groupBy(ident).applyInPandas(pick, matches.schema)


def without_self_overlaps(matches: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Matches of one phrase don't overlap each other: scanning from the left,
    the next begins where the last ended. Different phrases may overlap."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        keep, end = [], -1
        for i, a, b in zip(pdf.index, pdf["start"], pdf["end"], strict=True):
            if a >= end:
                keep.append(i)
                end = b
        return pdf.loc[keep]

    return matches.groupBy(ident, "phrase").applyInPandas(pick, matches.schema)


def annotate(toks: DataFrame, matches: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Tokens with ``match``: the number, by place, of the match they are in."""
    w = Window.partitionBy(ident).orderBy("start", "end", "phrase")
    numbered = matches.withColumn("match", F.row_number().over(w) - 1)
    inside = numbered.select(ident, "match", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    last = inside.groupBy(ident, "pos").agg(F.max("match").alias("match"))
    return toks.join(last, [ident, "pos"], "left")


def phrase_features(annotated: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Runs of consecutive tokens with one match number, joined by _."""
    w = Window.partitionBy(ident).orderBy("pos")
    rows = annotated.where("match is not null")
    new = (F.col("match") != F.lag("match", 1, -1).over(w)) | (F.col("pos") != F.lag("pos", 1, -2).over(w) + 1)
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(w))
    return rows.groupBy(ident, "run").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "form"))), lambda x: x["form"]), "_").alias("feature")).drop("run")


def chunks(toks: DataFrame, matches: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Each document as alternating stretches: doc_id, start, end, phrase, where
    phrase is null for what lies between (non-overlapping) matches."""
    size = toks.groupBy(ident).agg((F.max("pos") + 1).alias("size"))
    w = Window.partitionBy(ident).orderBy("start")
    edges = matches.select(ident, "start", "end", "phrase").unionByName(size.select(ident, F.col("size").alias("start"), F.col("size").alias("end"), F.lit(None).cast("string").alias("phrase")))
    gaps = edges.select(ident, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("a"), F.col("start").alias("b")).where("a < b")
    return gaps.select(ident, F.col("a").alias("start"), F.col("b").alias("end"), F.lit(None).cast("string").alias("phrase")).unionByName(matches.select(ident, "start", "end", "phrase"))


def spans_within(inner: DataFrame, outer: DataFrame, ident: str = "doc_id", label: str = "label") -> DataFrame:
    """Tokens (start, end) inside labelled spans as B- and I- tags, O outside:
    an equi-join on the document with the range as its condition."""
    o = outer.select(ident, F.col("start").alias("s"), F.col("end").alias("e"), label)
    hit = inner.join(o, ident).where((F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e")))
    one = hit.groupBy(ident, "start", "end").agg(F.min(F.struct("s", "e", label)).alias("x"))
    return inner.join(one, [ident, "start", "end"], "left").withColumn("ner", F.when(F.col("x").isNull(), "O").when(F.col("start") == F.col("x.s"), F.concat(F.lit("B-"), F.col(f"x.{label}"))).otherwise(F.concat(F.lit("I-"), F.col(f"x.{label}")))).drop("x")


def heads_in_upper_case(forms: Column) -> Column:
    """Share of tokens whose first character is an upper-case letter."""
    first = F.filter(forms, lambda x: F.substring(x, 1, 1).rlike(r"\p{Lu}"))
    return F.try_divide(F.size(first), F.size(forms))


def headline_lowered(forms: Column, threshold: float) -> Column:
    """Forms in lower case if the share of capitalised ones reaches a bound."""
    return F.when(heads_in_upper_case(forms) >= threshold, F.transform(forms, F.lower)).otherwise(forms)


def batches(n: int, size: int) -> Iterable[tuple[int, int]]:
    return [(a, min(n, a + size)) for a in range(0, n, size)]
