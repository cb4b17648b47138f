"""Operators on whole documents: the same results as row by row, no shuffle of tokens."""

import random

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import active as A
from corvane.operators import bayes as B
from corvane.operators import contrast as C
from corvane.operators import dependencies as D
from corvane.operators import features as T
from corvane.operators import phrases as P
from corvane.operators import select as S
from corvane.plans import catalogue, spec
from corvane.plans.store import stored

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_rooted_ngrams_are_pruned_while_counted(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choices(("the", "idiot", "of", "old", "big", "cat", "dog"), (8, 2, 4, 4, 1, 1, 1), k=rnd.randrange(0, 60))) for _ in range(120)]
    texts += ["you are the idiot of all idiots here", "the"] * 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = ["the", "idiot", "clown"]
    counts = stored(P.rooted_counts(T.tokens(docs), roots))
    assert rows(P.rooted_counts(T.forms(docs), roots)) == rows(counts)
    for leaf in (0.2, 0.05):
        want = rows(P.pruned(counts, leaf=leaf))
        assert len(want) > 20 and max(r[1] + r[2] for r in want) >= 4
        assert rows(P.rooted_pruned(T.forms(docs), roots, leaf=leaf)) == want


def test_rooted_queries_shuffle_no_tokens(spark):
    for name in ("rooted_counts", "rooted_prune"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "collect_list" not in plan
    assert {r.root for r in catalogue.QUERIES["rooted_prune"](spark, SF).collect()} >= {"the"}


def test_packed_counts_are_the_bag(spark):
    docs = spark.createDataFrame([(1, "a b a c a"), (2, ""), (3, None), (4, "b b d"), (5, "x a"), (5, "a y"), (None, "z"), (None, "z")], "doc_id long, text string")
    packed = T.packed(docs)
    assert sorted(map(str, T.rows_of(packed).select("doc_id", "feature", "n").collect())) == sorted(map(str, T.bag(T.unigrams(T.tokens(docs))).select("doc_id", "feature", "n").collect()))
    assert {r.doc_id: r.k for r in packed.collect()} == {1: 5, 4: 3, 5: 4, None: 2}


def test_rare_and_frequent_features_score_alike(spark):
    docs = catalogue.table(spark, SF, "documents").limit(60)
    labels = docs.select("doc_id", F.col("lang").alias("label"))
    packed, bag = T.packed(docs), T.bag(T.unigrams(T.tokens(docs)))
    got = {}
    for name, feats, hot in (("bag", bag, 2**18), ("all rare", packed, 1), ("some", packed, 300), ("all frequent", packed, 2**30)):
        B.HOT, old = hot, B.HOT
        try:
            m = B.fit(feats, labels)
            got[name] = [[(*r[:-1], round(r[-1], 6)) for r in rows(x)] for x in (B.scores(m, feats, docs), B.one_vs_rest(feats, labels), B.sfe(m, feats, docs, feats, docs))]
        finally:
            B.HOT = old
    assert all(x == got["bag"] for x in got.values()) and len(got["bag"][0]) == 240


def test_packed_tables_serve_as_bags_do(spark):
    docs = catalogue.table(spark, SF, "documents").limit(60)
    labels = docs.select("doc_id", (F.col("doc_id") % 3).cast("string").alias("label"))
    clusters = docs.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("cluster")).where("doc_id % 2 = 0")
    soft = labels.withColumn("p", F.lit(0.5))
    both = []
    for feats in (T.packed(docs), T.bag(T.unigrams(T.tokens(docs)))):
        both.append([rows(S.evidence(feats, labels)), rows(C.cluster_counts(feats, clusters, feats)), rows(A.correlation(feats, soft)), rows(C.typed_counts(feats)), rows(B.fit(feats, labels).labels)])
    assert both[0] == both[1] and all(both[0])


def test_scores_join_features_by_broadcast_or_as_rare_ones(spark):
    """No join by feature of all occurrences: the frequent ones' side is broadcast."""
    docs = catalogue.table(spark, SF, "documents")
    feats = T.packed(docs)
    m = B.fit(feats, docs.select("doc_id", F.col("lang").alias("label")))
    plan = B.scores(m, feats, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan


def test_trees_by_place_and_by_joins(spark):
    odd = [(1, 1, "The", 2), (1, 2, "dog", 3), (1, 3, "ran", 0), (2, 5, "a", 7), (2, 7, "b", 9), (2, 9, "C", 0), (2, 9, "d", 0), (3, 1, "x", 9), (3, 2, "y", None), (None, 1, "n", 1)]
    edges = spark.createDataFrame(odd, "doc_id long, id int, form string, head int")
    assert rows(D.bigrams(edges)) == [(1, "dog-ran"), (1, "the-dog"), (2, "a-b"), (2, "b-c"), (2, "b-d")]
    assert rows(D.trigrams(edges)) == [(1, "the-dog-ran"), (2, "a-b-c"), (2, "a-b-d")]
    for name in ("dep_bigrams", "dep_trigrams"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan


def test_spans_without_windows(spark):
    docs = spark.createDataFrame([(1, " Hello :) wörld"), (2, None), (3, "")], "doc_id long, text string")
    assert rows(T.token_spans(docs), "doc_id", "pos", "form", "start", "end") == [(1, 0, "hello", 1, 6), (1, 1, ":)", 7, 9), (1, 2, "wörld", 10, 15)]
    plan = catalogue.QUERIES["json_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_tokens_are_those_of_the_plain_pattern(spark):
    """The tokeniser's own patterns against ``token_pattern``, which the SQL has."""
    rnd = random.Random(3)
    parts = ["a", "é", "É", "ß", "d:", "D:", ":p", ":P", ":-P", "=op", ";O)", "(x", "/o=", "\\^x", "d-;", ":/", "http://a.b/c-d", "HTTP://X", "h", "#", "@", "_", "'", "’", "``", "0", "٣", "́", "﻿", "​", "️", "\n", "\t", " ", ".", "漢", "İ", "K", "😀", "don't", "a_b_", "x:paul"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(0, 40))) for _ in range(3000)] + [None, "", " \n", "a_" * 20000 + "b", "a" + "'" * 20000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lower, upper in ((True, True), (False, True), (True, False)):
        t = X.clean(F.coalesce("text", F.lit("")))
        t = F.lower(t) if lower else t
        t = X._rewrite(t, f"(?i:{X.EMOTICON})", F.upper) if upper else t
        want = F.regexp_extract_all(t, F.lit(X.token_pattern()), F.lit(0))
        got = docs.select("text", X.tokenise(F.col("text"), lower_case=lower, emoticon_upper=upper).alias("got"), want.alias("want"))
        assert not got.where(~F.col("got").eqNullSafe(F.col("want"))).take(1)


def test_selectors_tokenise_labelled_documents_only(spark, monkeypatch):
    docs = catalogue.table(spark, SF, "documents")
    labels = docs.where("doc_id % 4 = 0").select("doc_id", (F.col("doc_id") % 3).cast("string").alias("label"))
    p = spec.build([("tokeniser", {"type": "basic"}), ("unigrams", True), ("feature_selection_basic", {"feature_selection_limit": "200", "feature_types": "unigram"})])
    read, plain = [], spec.Pipeline.tokens

    def tokens(self, rows, *a, **k):
        read.append(rows.count())
        return plain(self, rows, *a, **k)

    monkeypatch.setattr(spec.Pipeline, "tokens", tokens)
    fitted = p.fit(docs, labels).fitted[0][1]
    assert read == [labels.count()]
    want = S.top(S.evidence(T.unigrams(T.tokens(docs)), labels), S.wfo(0.5), 200)
    assert rows(fitted, "feature") == rows(want, "feature")
    monkeypatch.setattr(T, "FEW", 3)
    assert rows(p.fit(docs, labels).fitted[0][1], "feature") == rows(want, "feature")


def test_evidence_of_rows_reads_them_once(spark):
    docs = catalogue.table(spark, SF, "documents")
    labels = docs.select("doc_id", "lang").withColumnRenamed("lang", "label")
    e = S.evidence(T.unigrams(T.tokens(docs)), labels)
    assert "regexp" not in e._jdf.queryExecution().optimizedPlan().toString()
    assert rows(e) == rows(S.evidence(T.packed(docs), labels))


def test_sums_by_columns_and_by_rows(spark, monkeypatch):
    docs = catalogue.table(spark, SF, "documents").limit(60)
    labels = docs.select("doc_id", F.col("lang").alias("label"))
    bag = T.packed(docs)
    m = B.trim(B.fit(bag, labels), 3)  # its vocabulary is not that of its counts
    got = []
    for wide in (64, 3, 0):
        monkeypatch.setattr(B, "WIDE", wide)
        got.append([[(*r[:-1], round(r[-1], 6)) for r in rows(x)] for x in (B.scores(m, bag, docs), B.one_vs_rest(bag, labels))])
    assert got[0] == got[1] == got[2] and len(got[0][1]) == 480
    monkeypatch.setattr(B, "WIDE", 64)
    plan = B.scores(m, bag, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "generate inline(each" not in plan.lower()


def test_one_vs_rest_of_a_label_named_other(spark):
    """Its two sides are one."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "x"), (2, "OTHER"), (3, "y")], "doc_id long, label string")
    sides = {(r.target, r.label) for r in B.one_vs_rest(T.packed(docs), labels).collect()}
    assert sides == {("x", "x"), ("x", "OTHER"), ("y", "y"), ("y", "OTHER"), ("OTHER", "OTHER")}


def test_confusion_and_selection_look_at_labelled_documents_only(spark, monkeypatch):
    seen, plain = [], T.packed

    def packed(docs, *a, **k):
        seen.append(docs.count())
        return plain(docs, *a, **k)

    monkeypatch.setattr(T, "packed", packed)
    lab = catalogue._lab(spark, SF)
    labelled = catalogue._docs(spark, SF).join(lab, "doc_id", "left_semi").count()
    got = catalogue.QUERIES["eval_confusion"](spark, SF)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.n for r in got.collect()) == labelled
    for name in ("select_mi", "select_apply"):
        assert catalogue.QUERIES[name](spark, SF).count()
    assert seen == [labelled] * 3


def test_clusters_read_what_they_need(spark, monkeypatch):
    """cluster_frequent: members alone; the background is counted once."""
    seen, plain = [], T.packed

    def packed(docs, *a, **k):
        seen.append(docs.count())
        return plain(docs, *a, **k)

    monkeypatch.setattr(T, "packed", packed)
    assert catalogue.QUERIES["cluster_frequent"](spark, SF).count()
    ids = catalogue._vectors(spark, SF).select("doc_id")
    assert seen == [catalogue._docs(spark, SF).join(ids, "doc_id", "left_semi").count()]
    bag = plain(catalogue._docs(spark, SF))
    counts = C.cluster_counts(bag, C.members(catalogue._vectors(spark, SF)), bag)
    assert "inline" not in counts._jdf.queryExecution().optimizedPlan().toString()
