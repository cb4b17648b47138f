"""Option pipelines, stores, readers, streams and stemmers; null and empty input."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import stem
from corvane.functions import text as X
from corvane.operators import bayes as B
from corvane.operators import contrast as C
from corvane.operators import dependencies as D
from corvane.operators import features as T
from corvane.operators import match as M
from corvane.plans import spec
from corvane.sources import readers, stores
from corvane.streaming import counts as ST

DOCS = [(1, "The dogs ran, ran to https://a.b/c @anna"), (2, None), (3, ""), (4, "running dogs!!! and   cats"), (4, "running dogs!!! and   cats")]
BASIC = ("tokeniser", {"type": "basic"})


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_options_make_a_pipeline(docs):
    p = spec.build([("tokeniser", '{"type": "basic", "normalise_urls": "true", "normalise_twitter_usernames": true}'), ("remove_stopwords", {"use": True, "lang": "en"}), ("stemmer", {"lang": "en"}), ("unigrams", "true"), ("bigrams", False)])
    assert got(p.extract(docs).where("doc_id = 1"), "pos", "feature") == [(1, "dog"), (2, "ran"), (3, "ran"), (5, "HTTPLINK"), (6, "USERNAME")]
    assert len(got(p.extract(docs).where("doc_id = 4"), "feature")) == 6


def test_a_normaliser_may_end_the_chain(docs):
    p = spec.build([BASIC, ("unigrams", True)])
    p = p.add(spec.Component("author", "normaliser", lambda f: X.by_form(f, ["dogs"], "DOGS"))).add(spec.Component("lower", "normaliser", F.lower))
    assert {f for (f,) in got(p.extract(docs), "feature")} >= {"DOGS", "ran"}


@pytest.mark.parametrize(
    "options",
    [[], [("unigrams", True)], [("nonsense", 1)], [("tokeniser", {"type": "none"})], [("tokeniser", {"kind": 1})], [BASIC, ("unigrams", "yes please")], [BASIC, ("remove_stopwords", {"use": True, "lang": "xx"})], [BASIC, ("filter_keywords", 3)], [BASIC, ("illinois_ner", True)], [BASIC, ("feature_selection_basic", {"lambda": "much"})], [("tokeniser", {"type": "arabicstanford"})]],
)
def test_wrong_options_are_refused(options):
    with pytest.raises(spec.ConfigurationError):
        spec.build(options)


def test_edits_derive_pipelines(docs):
    p = spec.build([BASIC, ("unigrams", True), ("unigrams", True), ("bigrams", True)])
    assert [c.name for c in p.components] == ["tokeniser", "unigrams", "unigrams:2", "bigrams"]
    q = p.deduplicated().online("bigrams", False)
    assert {t for (t,) in got(q.extract(docs), "type")} == {"unigram"} and len(p.components) == 4
    assert [c.name for c in p.remove("unigrams:2").find("inferrer")] == ["unigrams", "bigrams"]
    with pytest.raises(spec.ConfigurationError):
        p.remove("trigrams")


def test_selectors_keep_additional_features(docs, spark):
    labels = spark.createDataFrame([(1, "a"), (4, "b")], "doc_id long, label string")
    p = spec.build([BASIC, ("unigrams", True), ("feature_selection_basic", {"feature_selection_limit": 1, "feature_count_cutoff": 1, "feature_types": "unigram"})]).fit(docs, labels)
    few = {f for (f,) in got(p.extract(docs), "feature")}
    more = {f for (f,) in got(p.with_additional(["cats"]).extract(docs), "feature")}
    assert len(few) == 1 and more == few | {"cats"} and p.with_additional(["cats"]).without_additional().additional == ()


def test_plugins_and_presets(docs):
    with pytest.raises(spec.ConfigurationError):
        spec.preset("none")
    spec.plugin("arabicstanford", lambda t: F.split(t, " "))
    try:
        p = spec.build([("tokeniser", {"type": "arabicstanford", "filter_punctuation": False}), ("unigrams", True)])
        assert ("dogs!!!",) in got(p.extract(docs), "feature")
    finally:
        spec.PLUGINS.clear()
    assert got(spec.preset("basic").extract(docs.limit(0)), "feature") == []


def test_array_ngrams_equal_windows(docs):
    items, toks = T.token_items(docs.where("doc_id < 4")), T.tokens(docs.where("doc_id < 4"))
    for n in (1, 2, 3, 9):
        assert got(T.item_ngrams(items, n), "doc_id", "pos", "feature") == got(T.ngrams(toks, n), "doc_id", "pos", "feature")


def test_phrases_of_several_lengths_and_overlaps(spark):
    docs = spark.createDataFrame([(1, "x a b c d x a b"), (2, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([("A b C",), ("b c d",), ("a b",), ("",), (None,)], "phrase string")
    both = [got(M.phrase_matches(x, phrases), "start", "end", "phrase") for x in (T.token_items(docs), T.tokens(docs))]
    assert both[0] == both[1] == [(1, 3, "a b"), (1, 4, "a b c"), (2, 5, "b c d"), (6, 8, "a b")]
    left = got(M.without_overlaps(M.phrase_matches(T.token_items(docs), phrases)), "start", "end")
    assert all(a[1] <= b[0] for a, b in zip(left, left[1:])) and len(left) == 2


def test_clean_before_tokens(spark):
    df = spark.createDataFrame([("a​b﻿ c\td️e\nf",)], "t string")
    assert df.select(X.tokenise(F.col("t")).alias("x")).first().x == ["ab", "c", "de", "f"]


def test_bag_counts_as_occurrences_do(spark, docs):
    feats, labels = T.unigrams(T.tokens(docs)), spark.createDataFrame([(1, "a"), (4, "b"), (4, None)], "doc_id long, label string")
    bag = T.bag(feats)
    for f in (lambda x: B.loglik(B.fit(x, labels)), lambda x: B.scores(B.fit(x, labels), x, docs), lambda x: C.typed_counts(x)):
        a, b = (sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in f(x).collect()) for x in (feats, bag))
        assert a == b and a


def test_one_vs_rest_options(spark):
    feats = spark.createDataFrame([(i, 0, f) for i, t in enumerate(["x y", "y z", "z x", "x"]) for f in t.split()], "doc_id long, pos int, feature string")
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, label string")
    plain = got(B.one_vs_rest(feats, labels), "doc_id", "target", "label", "score")
    assert {(t, x) for _, t, x, _ in plain} == {(t, x) for t in "abc" for x in (t, "OTHER")}
    alphas = spark.createDataFrame([("a", "x", 50.0)], "label string, feature string, alpha double")
    raised = {r[:3]: r[3] for r in got(B.one_vs_rest(feats, labels, alphas=alphas, multipliers=spark.createDataFrame([("a", 3.0)], "label string, multiplier double")), "doc_id", "target", "label", "score")}
    before = {r[:3]: r[3] for r in plain}
    assert raised[3, "a", "a"] - raised[3, "a", "OTHER"] > before[3, "a", "a"] - before[3, "a", "OTHER"]
    two = labels.where("label <> 'c'")
    assert {t for (t,) in got(B.one_vs_rest(feats, two), "target")} == {"b"}


def test_marginals_replace_likelihoods(spark):
    feats = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "y")], "doc_id long, pos int, feature string")
    m = B.fit(feats, spark.createDataFrame([(1, "1"), (2, "0")], "doc_id long, label string"))
    marginals = spark.createDataFrame([("y", 0.25, 0.5)], "feature string, p_positive double, p_negative double")
    lik = {(r.label, r.feature): r.loglik for r in B.marginal_loglik(m, marginals, "1").collect()}
    plain = {(r.label, r.feature): r.loglik for r in B.loglik(m).collect()}
    import math

    assert math.isclose(lik["1", "y"], math.log(0.25)) and math.isclose(lik["0", "y"], math.log(0.5)) and lik["1", "x"] == plain["1", "x"]


def test_gender_classifier(spark):
    names = spark.createDataFrame([("F", "anna", 90), ("F", "maria", 70), ("M", "otto", 80), ("M", "hans", 60), (None, "x", 1), ("F", None, 1)], "gender string, name string, count long")
    m = B.gender_classifier(names)
    feats = T.first_name_features(spark.createDataFrame([(1, "Hanna"), (2, "Benno")], "doc_id long, name string"), F.col("name"), "doc_id")
    assert got(B.best(B.scores(m, feats, feats.select("doc_id").distinct())), "doc_id", "label") == [(1, "F"), (2, "M")]


def test_failing_save_leaves_the_old(spark, tmp_path):
    at = f"file://{tmp_path}/m"
    good = lambda p: spark.range(3).write.parquet(p)
    stores.save_all(spark, at, {"a": good})

    def bad(path):
        raise OSError("disk is full")

    with pytest.raises(OSError):
        stores.save_all(spark, at, {"a": good, "b": bad})
    assert spark.read.parquet(f"{at}/a").count() == 3 and [p.name for p in tmp_path.iterdir()] == ["m"]
    stores.save_all(spark, at, {"c": good})
    assert not stores.exists(spark, f"{at}/a") and stores.exists(spark, f"{at}/c")


def test_models_and_services(spark, tmp_path):
    feats = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "doc_id long, pos int, feature string")
    m, at = B.fit(feats, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, label string")), f"file://{tmp_path}/m"
    assert not stores.is_model(spark, at)
    with pytest.raises(stores.StoreError):
        stores.load_model(spark, at)
    stores.save_model(m, at, options=[BASIC, ("http_service", {"url": "http://old"})], note="n")
    assert stores.move_service(spark, at, "http://old", "http://new")["options"][1][1]["url"] == "http://new"
    assert stores.read_metadata(spark, at)["note"] == "n" and got(B.loglik(stores.load_model(spark, at)), "label", "feature", "loglik") == got(B.loglik(m), "label", "feature", "loglik")


def test_cache_works_on_new_documents_only(spark, docs, tmp_path):
    cache, seen = stores.DocumentCache(spark, f"file://{tmp_path}/c"), []

    def work(rows):
        seen.append(rows.count())
        return rows.select("doc_id", F.length("text").alias("n"))

    cache.processed(docs.where("doc_id < 3"), [BASIC], work)
    out = cache.processed(docs, [BASIC], work)
    assert seen == [2, 3] and out.count() == 5 and cache.count([BASIC]) == 4 and cache.fraction(docs, [BASIC]) == 1.0
    assert cache.datasets([BASIC]) == ["all"] and cache.delete([BASIC]) and cache.count([BASIC]) == 0


def test_readers_of_odd_files(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"label": "a", "id": "1", "text": "é\\n"}, {"id": null}, {"other": 1}]', encoding="utf-8")
    assert got(readers.read_instances(spark, f"file://{tmp_path}/bad.json"), "label", "id", "text") == [("a", "1", "é\n")]
    (tmp_path / "t.csv").write_text('n,text\n1," a — b "\n2,"two\nlines"\n', encoding="utf-16")
    assert got(readers.read_texts_csv(spark, f"file://{tmp_path}/t.csv"), "text") == [("a  b",), ("two\nlines",)]
    readers.write_array(spark.createDataFrame([], "label string, id long, text string"), f"file://{tmp_path}/e")
    assert readers.read_instances(spark, f"file://{tmp_path}/e").count() == 0


def test_service_is_tried_again(spark):
    def call(rows):
        return [{"doc_id": r["doc_id"], "n": len(r["text"] or "")} for r in rows]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert got(readers.enriched(df, call, "doc_id long, n long"), "doc_id", "n") == [(1, 3), (2, 0)]


def test_streams_count_and_classify(spark, tmp_path):
    for k, rows in enumerate([[(1, "a b a")], [(2, "b #c"), (3, None)]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    ST.keep_counts(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert got(ST.kept_counts(spark, f"file://{tmp_path}/out"), "type", "feature", "n", "total") == [("HASH_TAG", "#c", 1, 1), ("WORD", "a", 2, 4), ("WORD", "b", 2, 4)]
    feats = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "doc_id long, pos int, feature string")
    model = B.precompute(B.fit(feats, spark.createDataFrame([(1, "A"), (2, "B")], "doc_id long, label string")))
    ST.classify_batches(stream, model, f"file://{tmp_path}/lab", f"file://{tmp_path}/cp2").awaitTermination()
    assert got(spark.read.parquet(f"file://{tmp_path}/lab"), "doc_id", "label") == [(1, "A"), (2, "B"), (3, "A")]


@pytest.mark.parametrize(
    ("lang", "pairs"),
    [
        ("en", "consistency consist consigned consign knightly knight generously generous hopping hop hoped hope skies sky happily happili dying die vietnamization vietnam adjustable adjust communism communism"),
        ("porter", "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sized size falling fall happy happi relational relat triplicate triplic revival reviv adjustment adjust"),
        ("de", "aufeinander aufeinand häuser haus kategorischen kategor aufgaben aufgab"),
        ("sv", "jaktkarlarne jaktkarl klostergården klostergård friskt frisk"),
        ("no", "havnedistriktene havnedistrikt opning opning"),
        ("da", "undersøgelsen undersøg indtagelse indtag"),
    ],
)
def test_stemmers(spark, lang, pairs):
    words = pairs.split()
    df = spark.createDataFrame([(words[::2],), ([],), (None,), ([None, ""],)], "w array<string>")
    assert [r.s for r in df.select(stem.stemmer(lang)("w").alias("s")).collect()] == [words[1::2], [], None, [None, ""]]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, label string")
    bag = T.bag(T.unigrams(T.tokens(docs)))
    m = B.fit(bag, labels)
    for df in (bag, T.inverted_index(bag), C.typed_counts(bag), B.loglik(m), B.scores(m, bag, docs), B.one_vs_rest(bag, labels), B.kld(m), T.item_ngrams(T.token_items(docs), 2)):
        assert df.collect() == []


TREE = [(1, 1, "dog", "NN", 2, "nsubj"), (1, 2, "ran", "VB", 0, "root"), (1, 3, "up", "IN", 2, "prep"), (1, 4, "to", "TO", 3, "prep"), (1, 5, "him", None, 4, "pobj"), (1, 6, "not", "RB", 2, "neg"), (2, 1, "of", "IN", 2, "prep"), (2, 2, "in", "IN", 1, "prep"), (2, 3, "x", "NN", 1, "pobj")]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(TREE, "doc_id long, id int, form string, pos string, head int, deprel string")


def test_prepositions_collapse_and_circles_end(edges):
    assert got(D.collapsed(edges), "doc_id", "id", "head") == [(1, 1, 2), (1, 2, 0), (1, 5, 2), (1, 6, 2), (2, 3, 0)]
    assert got(D.collapsed(edges.limit(0)), "id") == []
    assert got(D.bigrams(D.collapsed(edges)), "feature") == [("dog-ran",), ("ran-him",), ("ran-not",)]


def test_tree_predicates(edges):
    assert got(D.negated(edges), "id") == [(2,)]
    assert got(D.longest_path(edges), "doc_id", "depth") == [(1, 4)]
    assert got(D.out_degree(edges).where("out_degree > 1"), "doc_id", "id", "out_degree") == [(1, 2, 3), (2, 1, 2)]
    assert got(D.ancestor(edges, 2).where("doc_id = 1 and id = 4"), "ancestor") == [(2,)]
    assert got(D.siblings(edges).where("doc_id = 1 and id = 1"), "sibling") == [(3,), (6,)]
    assert ("to-up-ran",) in got(D.expanded_ngrams(edges), "feature") and ("dog-ran",) in got(D.expanded_ngrams(edges), "feature")


def test_conll_round_trip(edges):
    lines = D.to_conll(edges.withColumn("sentence", F.lit(0))).withColumnRenamed("id", "pos")
    assert got(D.from_conll(lines).na.fill("_"), "doc_id", "id", "form", "pos", "head", "deprel") == got(edges.na.fill("_"), "doc_id", "id", "form", "pos", "head", "deprel")
