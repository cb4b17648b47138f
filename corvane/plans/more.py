"""Registered queries of option pipelines, stores and readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.functions import stem
from corvane.operators import bayes as B
from corvane.operators import contrast as C
from corvane.operators import features as T
from corvane.plans import catalogue as K
from corvane.plans import spec
from corvane.plans.catalogue import query
from corvane.plans.store import shared_folder
from corvane.sources import readers, stores

BASIC = ("tokeniser", {"type": "basic"})
STOPPED = (BASIC, ("filter_keywords", K._STOP))
_STOP_EN = ", ".join("'" + w.replace("'", "''") + "'" for w in K.X.STOPWORDS["en"])


def _place(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _typed(kind: str, sql: str) -> str:
    return f"SELECT doc_id, '{kind}' AS type, pos, feature FROM ({sql})"


@query("SELECT doc_id, 'unigram' AS type, pos, form AS feature FROM tok WHERE lower(form) NOT IN (%s)" % _STOP_EN, "tok")
def spec_stopwords(s, d):
    return spec.build([BASIC, ("remove_stopwords", {"use": "true", "lang": "en"}), ("unigrams", "true")]).extract(K._docs(s, d))


@query(_typed("bigram", K._lead_sql(2)), "kept")
def spec_bigrams(s, d):
    return spec.build([*STOPPED, ("bigrams", True)]).extract(K._docs(s, d))


@query(_typed("trigram", K._lead_sql(3)), "kept")
def spec_trigrams(s, d):
    return spec.build([*STOPPED, ("trigrams", True)]).extract(K._docs(s, d))


@query("SELECT doc_id, 'unigram' AS type, pos, CASE WHEN starts_with(form, '@') AND length(form) > 1 THEN 'USERNAME' ELSE form END AS feature FROM tok WHERE NOT regexp_full_match(lower(form), 't.*e')", "tok")
def spec_regex_usernames(s, d):
    return spec.build([("tokeniser", {"type": "basic", "normalise_twitter_usernames": "true"}), ("filter_regex", "t.*e"), ("unigrams", True)]).extract(K._docs(s, d))


@query("""SELECT doc_id, 'customNgram' AS type, CAST(0 AS INTEGER) AS pos, feature FROM (SELECT DISTINCT doc_id, feature FROM (SELECT doc_id, form || '_' || lead(form) OVER w AS two, form || '_' || lead(form) OVER w || '_' || lead(form, 2) OVER w AS three FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    UNPIVOT (feature FOR k IN (two, three)) WHERE feature IN ('of_the', 'the_the_and', 'it_is'))""", "tok")
def spec_custom_ngrams(s, d):
    return spec.build([BASIC, ("custom_ngrams", {"ngrams": ["of_the", "the_the", "the_the_and", "it_is"]})]).extract(K._docs(s, d))


@query(f"SELECT doc_id, 'unigram' AS type, pos, feature FROM feat SEMI JOIN ({K._wfo_sql(0.5, 500)}) USING (feature)", "feat", "evi")
def spec_wllr(s, d):
    p = spec.build([BASIC, ("unigrams", True), ("feature_selection_basic", {"feature_selection_limit": "500", "feature_types": "unigram"})])
    return p.fit(K._docs(s, d), K._lab(s, d)).extract(K._docs(s, d))


@query("SELECT doc_id, 'unigram' AS type, pos, feature FROM feat SEMI JOIN (SELECT feature FROM feat GROUP BY feature HAVING count(*) >= 3 AND count(*) < 50) USING (feature)", "feat")
def spec_frequency_range(s, d):
    p = spec.build([BASIC, ("unigrams", True), ("feature_selection_frequency_range", {"lower": 3, "upper": 50.0})])
    return p.fit(K._docs(s, d)).extract(K._docs(s, d))


@query("SELECT doc_id, 'unigram' AS type, pos, CAST(dense_rank() OVER (ORDER BY feature) - 1 AS BIGINT) AS number FROM feat WHERE feature IN (SELECT feature FROM feat GROUP BY feature HAVING count(*) > 2)", "feat")
def spec_indexed(s, d):
    known = T.term_frequency(K._feats(s, d)).where("tf > 2").select("feature")
    return spec.build([BASIC, ("unigrams", True)]).with_vocabulary(known).indexed(K._docs(s, d))[0]


@query("""SELECT id AS doc_id, type, CAST(0 AS INTEGER) AS pos, CASE type WHEN 'firstName' THEN n WHEN 'lastIsVowel' THEN 'lastIsVowel:' || CASE WHEN right(n, 1) IN ('a', 'e', 'i', 'o', 'u', 'y') THEN 'true' ELSE 'false' END
    WHEN 'lastLetter' THEN 'lastLetter:' || right(n, 1) ELSE 'lastTwo:' || right(n, 2) END AS feature
    FROM (SELECT doc_id AS id, form AS n FROM tok WHERE pos = 0) CROSS JOIN (SELECT unnest(['firstName', 'lastIsVowel', 'lastLetter', 'lastTwoLetters']) AS type)
    WHERE length(n) > 1""", "tok")
def spec_first_names(s, d):
    return spec.preset("first_names").extract(K._docs(s, d))


@query("SELECT * FROM pred", "pred")
def store_model(s, d):
    model, bag, docs = K._fitted(s, d)
    at = _place(s, "model")
    stores.save_model(model, at, options=STOPPED, training=K._lab(s, d))
    return B.best(B.scores(stores.load_model(s, at), bag, docs))


@query("SELECT * FROM pred", "pred")
def store_precomputed(s, d):
    model, bag, docs = K._fitted(s, d)
    at = _place(s, "tables")
    stores.save_precomputed(B.precompute(model), at)
    return B.best(B.precomputed_scores(stores.load_precomputed(s, at), bag, docs))


@query("SELECT label, feature, round(loglik, 6) AS loglik FROM lik", "lik")
def store_model_json(s, d):
    at = _place(s, "json")
    stores.model_to_json(K._model(s, d)).write.text(at)
    return B.loglik(stores.model_from_json(s.read.text(at))).select("label", "feature", K._r("loglik").alias("loglik"))


@query("SELECT doc_id, quality AS old, CAST(label AS INTEGER) AS new FROM pred JOIN labels USING (doc_id) WHERE quality IS NOT NULL", "pred")
def store_relabelled(s, d):
    model, bag, docs = K._fitted(s, d)
    at = _place(s, "model")
    stores.save_model(model, at, training=K._lab(s, d).withColumn("old", F.col("label").cast("int")))
    new = stores.load_training(s, at, B.best(B.scores(model, bag, docs)))
    return new.select("doc_id", "old", F.col("label").cast("int").alias("new"))


@query("SELECT * FROM bg", "bg")
def store_counts(s, d):
    at = _place(s, "counts")
    stores.save_counts(C.typed_counts(K._feats(s, d)), at)
    return stores.load_counts(s, at)


@query("SELECT doc_id, pos, feature FROM feat", "feat")
def store_cache(s, d):
    """The second half finds the first half's documents in the cache."""
    cache, docs = stores.DocumentCache(s, _place(s, "cache")), K._docs(s, d)
    work = lambda rows: T.unigrams(T.tokens(rows))
    cache.processed(docs.where("doc_id % 2 = 0"), [BASIC], work)
    return cache.processed(docs, [BASIC], work)


def _instances(s, d):
    return K._docs(s, d).select(F.col("lang").alias("label"), F.col("doc_id").cast("string").alias("id"), "text")


@query("SELECT lang AS label, CAST(doc_id AS VARCHAR) AS id, text FROM documents")
def json_array(s, d):
    at = _place(s, "array")
    readers.write_array(_instances(s, d), at)
    return readers.read_instances(s, at)


@query("SELECT lang AS label, CAST(doc_id AS VARCHAR) AS id, text FROM documents")
def json_lines_to_array(s, d):
    at = _place(s, "lines")
    readers.write_instances(_instances(s, d), at)
    readers.lines_to_array(s, at, f"{at}-array")
    return readers.read_instances(s, f"{at}-array")


@query("SELECT doc_id, text, n FROM documents JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) USING (doc_id)", "tok")
def json_documents(s, d):
    docs = readers.documents(T.span_items(K._docs(s, d)))
    back = docs.select("doc_id", readers.document_from_json(readers.document_to_json(F.col("document"))).alias("x"))
    return back.select("doc_id", "x.source.text", F.size("x.annotatedTokens").cast("long").alias("n")).where("n > 0")


@query("SELECT regexp_replace(trim(item), '[^\\x00-\\x{200f}]', '', 'g') AS text FROM (SELECT text AS item FROM benchmark)")
def csv_texts(s, d):
    at = _place(s, "csv")
    K.table(s, d, "benchmark").select("text").write.csv(at, header=True, encoding="UTF-16", escape='"')
    return readers.read_texts_csv(s, at)


@query("SELECT 'page ' || item_id AS title, text FROM benchmark")
def wiki_dump(s, d):
    at = _place(s, "wiki")
    page = F.concat(F.to_json(F.struct(F.struct(F.col("item_id").cast("string").alias("_id")).alias("index"))), F.lit("\n"), F.to_json(F.struct(F.concat(F.lit("page "), F.col("item_id")).alias("title"), "text")))
    K.table(s, d, "benchmark").select(page.alias("value")).write.text(at)
    return readers.read_wiki_dump(s, at)


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, 'name' || (c_custkey % 30) AS name, CAST(sum(c_custkey % 7) AS BIGINT) AS count FROM customer GROUP BY ALL")
def name_counts(s, d):
    at = _place(s, "names")
    key = F.col("c_custkey")
    K.table(s, d, "customer").select(F.concat(F.lit("Name"), key % 30), F.when(key % 2 == 0, "F").otherwise("M"), key % 7).write.csv(at)
    return readers.read_name_counts(s, at)


@query("SELECT doc_id, label FROM pred", "pred")
def ovr_two_labels(s, d):
    bag = K._bag(s, d)
    two = B.best(B.one_vs_rest(bag, K._lab(s, d)).withColumn("label", F.when(F.col("label") == "OTHER", "0").otherwise(F.col("label"))))
    none = K._docs(s, d).join(two, "doc_id", "left_anti").select("doc_id")
    return two.unionByName(none.crossJoin(F.broadcast(B.priors(B.fit(bag, K._lab(s, d))).orderBy(F.desc("prior")).limit(1).select("label"))))


@query()
def fm_scores(s, d):
    model, bag, docs = K._fitted(s, d)
    marginals = B.feature_marginals(bag, K._lab(s, d), K._pooled(s, d, bag)[0], "1")
    return B.marginal_scores(model, marginals, "1", bag, docs).withColumn("score", K._r("score"))


@query()
def stems_english(s, d):
    items = K._items(s, d)
    return items.select("doc_id", F.posexplode(stem.stemmer("en")(F.transform("items", lambda t: t["form"]))).alias("pos", "form"))
