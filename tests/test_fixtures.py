"""Hand-computed values and, on the small tables, SQL side by side."""

import math
import os

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import bayes as B
from corvane.operators import dependencies as D
from corvane.operators import features as T
from corvane.plans import catalogue

SF = "/root/testdata/sf0.001"


def tokens(spark, text, **options):
    return spark.createDataFrame([(text,)], "t string").select(X.tokenise(F.col("t"), **options).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello :) world ;p d: paradox", ["hello", ":)", "world", ";P", "D", "paraDOX"]),
        ("#Tag @user_1 it’s  'quoted' café numb3rs", ["#tag", "@user_1", "it’s", "quoted", "café", "numb3rs"]),
        ("", []),
        (None, []),
        (":) :( =D", [":)", ":(", "d"]),
    ],
)
def test_tokeniser(spark, text, want):
    assert tokens(spark, text) == want


def test_addresses(spark):
    assert tokens(spark, "see https://www.www.com/a?b=1 now", normalise_urls=True) == ["see", "HTTPLINK", "now"]


def test_toy_bayes(spark):
    docs = [(1, "1", "1 2"), (2, "1", "1 3"), (3, "1", "1 2 3"), (4, "0", "1"), (5, "0", "2"), (6, "0", "3")]
    feats = spark.createDataFrame([(i, p, f) for i, _, t in docs for p, f in enumerate(t.split())], "doc_id long, pos int, feature string")
    model = B.fit(feats, spark.createDataFrame([(i, label) for i, label, _ in docs], "doc_id long, label string"))
    asked = {10: "1 2", 11: "1 3 2", 12: "99"}
    new = spark.createDataFrame([(i, p, f) for i, t in asked.items() for p, f in enumerate(t.split())], "doc_id long, pos int, feature string")
    got = {(r.doc_id, r.label): r.p for r in B.posterior(B.scores(model, new, new.select("doc_id"))).collect()}
    for i, want in ((10, 0.519231), (11, 0.492901), (12, 0.5)):
        assert math.isclose(got[i, "1"], want, abs_tol=1e-6) and math.isclose(got[i, "0"] + got[i, "1"], 1)


def test_marginal_root():
    x = B.marginal_root([5.0], [15.0], [1.0], [29.0], [0.1], 0.4)[0]
    assert math.isclose(x, 0.209591, abs_tol=1e-6) and math.isclose((0.1 - x * 0.4) / 0.6, 0.026939, abs_tol=1e-6)


def test_bigrams_bridge(spark):
    toks = spark.createDataFrame([(1, 0, "a"), (1, 2, "b")], "doc_id long, pos int, form string")
    assert [r.feature for r in T.ngrams(toks, 2).collect()] == ["a_b"]


def test_dependency_ngrams(spark):
    rows = [(1, 1, "The", "DT", 2, "det"), (1, 2, "dog", "NN", 3, "nsubj"), (1, 3, "ran", "VB", 0, "root")]
    edges = spark.createDataFrame(rows, "doc_id long, id int, form string, pos string, head int, deprel string")
    assert sorted(r.feature for r in D.bigrams(edges).collect()) == ["dog-ran", "the-dog"]
    assert [r.feature for r in D.trigrams(edges).collect()] == ["the-dog-ran"]


@pytest.mark.parametrize("name", ["tokens_count", "bigrams", "nb_predict_quality", "nb_alpha", "eval_prf", "select_wllr", "info_gain", "pmi_target_background", "phrase_match", "dep_trigrams", "way_radius"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))

    assert rows(got) == rows(want)
