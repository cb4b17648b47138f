"""Dependency n-grams and tree predicates over an edge table
(doc_id, id, form, pos, head, deprel), head 0 being the root."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.store import stored, written

PREPOSITIONS = ("IN", "TO")
NEGATIONS = ("no", "not", "n't", "never")


def _side(edges: DataFrame, prefix: str, ident: str) -> DataFrame:
    return edges.select(ident, *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "form", "pos", "head", "deprel")])


def collapsed(edges: DataFrame, prepositions: Iterable[str] = PREPOSITIONS, ident: str = "doc_id") -> DataFrame:
    """Prepositions taken out: their dependants hang on their heads, chains of
    prepositions included. Each round doubles how far up a preposition's head is
    looked for, and is written. Prepositions that head each other in a circle
    have no head outside of it; what hangs on them goes to the root (0)."""
    tags = list(prepositions)
    tagged = F.coalesce(F.col("pos").isin(tags), F.lit(False))
    ups = written(edges.where(tagged & (F.col("head") != 0)).select(ident, F.col("id").alias("p_id"), F.col("head").alias("p_head")))
    most = ups.groupBy(ident).count().agg(F.max("count")).first()[0] or 0  # no chain is longer
    for _ in range(most.bit_length() + 1):
        over = ups.select(F.col(ident).alias("d"), F.col("p_id").alias("q"), F.col("p_head").alias("q_head"))
        next_ = ups.join(over, (F.col(ident) == F.col("d")) & (F.col("p_head") == F.col("q")), "left")
        if next_.where("q_head is not null").isEmpty():
            break
        ups = written(next_.select(ident, "p_id", F.coalesce("q_head", "p_head").alias("p_head")))
    else:
        inner = ups.select(F.col(ident).alias("d"), F.col("p_id").alias("q"))
        ups = ups.join(inner, (F.col(ident) == F.col("d")) & (F.col("p_head") == F.col("q")), "left").select(ident, "p_id", F.when(F.col("q").isNull(), F.col("p_head")).otherwise(0).alias("p_head"))
    kept = edges.where(~tagged | (F.col("head") == 0)).alias("e")
    hung = kept.join(ups.alias("u"), (F.col(f"e.{ident}") == F.col(f"u.{ident}")) & (F.col("e.head") == F.col("u.p_id")), "left")
    return hung.select(*[F.coalesce("u.p_head", "e.head").alias("head") if c == "head" else F.col(f"e.{c}").alias(c) for c in edges.columns])


def trees(edges: DataFrame, ident: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """Documents whose ids are 1, 2, ... n with their edges in one array, ``tree``,
    of (id, form, head) in that order, so that a head is found by its place; and
    the edges of the others, None where there are none. Tokens are moved once."""
    if "tree" in edges.columns:
        return edges, None
    rows = edges.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("id", "form", "head"))).alias("tree"))
    placed = F.forall(F.sequence(F.lit(1), F.size("tree")), lambda i: F.element_at("tree", i)["id"].eqNullSafe(i))
    rows = stored(rows.withColumn("placed", placed))
    others = rows.where("not placed")
    return rows.where("placed").select(ident, "tree"), None if others.isEmpty() else others.select(ident, F.inline("tree"))


def _lowered(tree: DataFrame, lower_case: bool, ident: str) -> DataFrame:
    form = F.lower if lower_case else (lambda x: x)
    return tree.select(ident, F.transform("tree", lambda x: F.struct(x["id"].alias("id"), form(x["form"]).alias("form"), x["head"].alias("head"))).alias("tree"))


def _in_order(*edges: Column) -> Column:
    """The forms joined by - in the order of their ids."""
    parts = F.sort_array(F.array(*[F.struct(x["id"].alias("id"), x["form"].alias("form")) for x in edges]))
    return F.array_join(F.transform(parts, lambda x: x["form"]), "-")


def bigrams(edges: DataFrame, lower_case: bool = True, ident: str = "doc_id") -> DataFrame:
    """A token and its head, joined by - in the order of their ids."""
    tree, others = trees(edges, ident)
    head = lambda x: F.get("tree", x["head"] - 1)
    found = _lowered(tree, lower_case, ident).select(ident, F.explode(F.transform(F.filter("tree", lambda c: head(c).isNotNull()), lambda c: F.when(c["id"] < head(c)["id"], F.concat_ws("-", c["form"], head(c)["form"])).otherwise(F.concat_ws("-", head(c)["form"], c["form"])))).alias("feature"))
    return found if others is None else found.unionByName(_joined_bigrams(others, lower_case, ident))


def trigrams(edges: DataFrame, lower_case: bool = True, ident: str = "doc_id") -> DataFrame:
    """A token, its head and that one's head, in the order of their ids."""
    tree, others = trees(edges, ident)
    head = lambda x: F.get("tree", x["head"] - 1)
    found = _lowered(tree, lower_case, ident).select(ident, F.explode(F.transform(F.filter("tree", lambda c: head(head(c)).isNotNull()), lambda c: _in_order(c, head(c), head(head(c))))).alias("feature"))
    return found if others is None else found.unionByName(_joined_trigrams(others, lower_case, ident))


def _joined_bigrams(edges: DataFrame, lower_case: bool, ident: str) -> DataFrame:
    c, h = (edges.select(F.col(ident).alias(f"{p}_doc"), *[F.col(x).alias(f"{p}_{x}") for x in ("id", "form", "head")]) for p in "ch")
    form = (lambda x: F.lower(x)) if lower_case else F.col
    pair = c.join(h, (F.col("c_doc") == F.col("h_doc")) & (F.col("c_head") == F.col("h_id")))
    return pair.select(F.col("c_doc").alias(ident), F.when(F.col("c_id") < F.col("h_id"), F.concat_ws("-", form("c_form"), form("h_form"))).otherwise(F.concat_ws("-", form("h_form"), form("c_form"))).alias("feature"))


def _joined_trigrams(edges: DataFrame, lower_case: bool, ident: str) -> DataFrame:
    c, h, g = (edges.select(F.col(ident).alias(f"{p}_doc"), *[F.col(x).alias(f"{p}_{x}") for x in ("id", "form", "head")]) for p in "chg")
    two = c.join(h, (F.col("c_doc") == F.col("h_doc")) & (F.col("c_head") == F.col("h_id")))
    three = two.join(g, (F.col("c_doc") == F.col("g_doc")) & (F.col("h_head") == F.col("g_id")))
    form = F.lower if lower_case else (lambda x: x)
    return three.select(F.col("c_doc").alias(ident), _in_order(*[F.struct(F.col(f"{p}_id").alias("id"), form(F.col(f"{p}_form")).alias("form")) for p in "chg"]).alias("feature"))


def negated(edges: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Tokens with a dependant that negates them."""
    n = edges.where((F.col("deprel") == "neg") | F.lower("form").isin(*NEGATIONS)).select(ident, F.col("head").alias("id")).distinct()
    return edges.join(n, [ident, "id"], "left_semi")


def conjuncts(edges: DataFrame, ident: str = "doc_id", with_heads: bool = False) -> DataFrame:
    own = edges.where("deprel = 'conj'")
    if not with_heads:
        return own
    heads = own.select(ident, F.col("head").alias("id")).distinct()
    return own.unionByName(edges.join(heads, [ident, "id"], "left_semi")).distinct()


def dependants(edges: DataFrame, relations: Iterable[str], ident: str = "doc_id") -> DataFrame:
    return edges.where(F.col("deprel").isin(*relations))


def out_degree(edges: DataFrame, ident: str = "doc_id") -> DataFrame:
    n = edges.groupBy(ident, F.col("head").alias("id")).agg(F.count("*").alias("n"))
    return edges.join(n, [ident, "id"], "left").select(ident, "id", F.coalesce("n", F.lit(0).cast("long")).alias("out_degree"))


def siblings(edges: DataFrame, ident: str = "doc_id") -> DataFrame:
    a, b = _side(edges, "a", ident), _side(edges, "b", ident)
    return a.join(b, (a[ident] == b[ident]) & (F.col("a_head") == F.col("b_head")) & (F.col("a_id") != F.col("b_id"))).select(a[ident], F.col("a_id").alias("id"), F.col("b_id").alias("sibling"))


def ancestor(edges: DataFrame, k: int, ident: str = "doc_id") -> DataFrame:
    """doc_id, id, ancestor k steps up (0 is the root above all)."""
    now = edges.select(ident, "id", F.col("head").alias("ancestor"))
    for _ in range(k - 1):
        up = edges.select(F.col(ident).alias("u"), F.col("id").alias("v"), "head")
        now = now.join(up, (F.col(ident) == F.col("u")) & (F.col("ancestor") == F.col("v"))).select(ident, "id", F.col("head").alias("ancestor"))
    return now


def longest_path(edges: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Tokens on each document's longest way down from the root above all."""
    level, depth = edges.where("head = 0").select(ident, "id"), 1
    best = level.select(ident).distinct().withColumn("depth", F.lit(1))
    while not level.isEmpty():
        best = best.unionByName(level.select(ident).distinct().withColumn("depth", F.lit(depth)))
        level = written(edges.select(ident, "id", F.col("head").alias("h")).join(level.select(F.col(ident).alias("d"), F.col("id").alias("p")), (F.col(ident) == F.col("d")) & (F.col("h") == F.col("p"))).select(ident, "id").distinct())
        depth += 1
    return best.groupBy(ident).agg(F.max("depth").alias("depth"))


def from_conll(lines: DataFrame) -> DataFrame:
    """Edges from lines (doc_id, pos, value) of tab-separated columns: 0 id, 1
    form, 4 tag, 8 head, 10 relation; a blank line ends a sentence."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.split("value", "\t")
    rows = lines.withColumn("sentence", F.sum((F.trim("value") == "").cast("int")).over(w)).where(F.trim("value") != "")
    return rows.select("doc_id", "sentence", F.get(parts, 0).cast("int").alias("id"), F.get(parts, 1).alias("form"), F.get(parts, 4).alias("pos"), F.get(parts, 8).cast("int").alias("head"), F.get(parts, 10).alias("deprel"))


def to_conll(edges: DataFrame) -> DataFrame:
    """One line a token, columns that edges don't have as _."""
    blank = F.lit("_")
    return edges.select("doc_id", "sentence", "id", F.concat_ws("\t", F.col("id").cast("string"), "form", blank, blank, F.coalesce("pos", blank), blank, blank, blank, F.coalesce(F.col("head").cast("string"), blank), blank, F.coalesce("deprel", blank)).alias("value"))


def expanded_ngrams(edges: DataFrame, lower_case: bool = True, ident: str = "doc_id") -> DataFrame:
    """The n-grams of a walk down the tree: child-head pairs in that order, and
    grandchild-child-head triples."""
    form = F.lower if lower_case else (lambda x: x)
    c, h, g = _side(edges, "c", ident), *(_side(edges, p, ident).withColumnRenamed(ident, f"{p}_doc") for p in "hg")
    two = c.join(h, (F.col(ident) == F.col("h_doc")) & (F.col("c_head") == F.col("h_id")))
    three = two.join(g, (F.col(ident) == F.col("g_doc")) & (F.col("h_head") == F.col("g_id")))
    pairs = two.select(ident, F.concat_ws("-", form("c_form"), form("h_form")).alias("feature"))
    return pairs.unionByName(three.select(ident, F.concat_ws("-", form("c_form"), form("h_form"), form("g_form")).alias("feature")))
