"""Pipelines from lists of options: (key, value) pairs to one DataFrame transform.

A ``Pipeline`` is an immutable list of named components. Changing one derives
another, so a temporary change is simply a derived pipeline that isn't kept.
``extract`` turns documents (doc_id, text) into features (doc_id, type, pos,
feature) as one plan: token arrays go through the filters and normalisers as
Column expressions and are exploded once, by the feature inferrers. Selectors
are fitted in order, each to the features that the components before it give.

Filtered tokens stay in the array, marked; inferrers leave them out. A token
that a filter took isn't normalised. A normaliser may end the chain of its token.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import stem
from corvane.functions import text as X
from corvane.operators import features as T
from corvane.operators import match as M
from corvane.operators import select as S
from corvane.plans.store import spread, stored


class ConfigurationError(ValueError):
    """An option that is unknown, of the wrong kind, or can't be met here."""


@dataclass(frozen=True)
class Component:
    """``kind`` is tokeniser, processor, filter, normaliser, stemmer, inferrer or
    selector; ``run`` is what the kind asks for (see ``Pipeline.extract``)."""

    name: str
    kind: str
    run: Callable
    online: bool = True
    only_online: bool = False


Handler = Callable[["Pipeline", Any], "Pipeline"]
HANDLERS: dict[str, Handler] = {}
#: Taggers, parsers and services by name, for the options that need one.
PLUGINS: dict[str, Callable] = {}


def handler(key: str) -> Callable[[Handler], Handler]:
    """Register the handler of an option key; a plug-in may add its own."""

    def add(f: Handler) -> Handler:
        HANDLERS[key] = f
        return f

    return add


def plugin(name: str, f: Callable) -> None:
    """Provide a model that isn't bundled: a tokeniser (text Column to array of
    strings), or a processor (DataFrame with ``items`` to the same)."""
    PLUGINS[name] = f


class Options:
    """An option's dictionary; values are coerced, what is left over is an error."""

    def __init__(self, key: str, value: Any):
        value = json.loads(value) if isinstance(value, str) and value.strip()[:1] in ("{", "[") else value
        if not isinstance(value, dict):
            raise ConfigurationError(f"{key} takes named options, not {value!r}")
        self.key, self.left = key, dict(value)

    def take(self, name: str, default: Any) -> Any:
        value = self.left.pop(name, None)
        return default if value is None else coerce(name, value, default)

    def done(self) -> None:
        if self.left:
            raise ConfigurationError(f"{self.key}: unknown options {sorted(self.left)}")


def coerce(name: str, value: Any, default: Any) -> Any:
    """``value`` as the kind of ``default``: "true" and true, 3, 3.0 and "3"."""
    try:
        if isinstance(default, bool):
            return boolean(value)
        if isinstance(default, int) and not isinstance(value, bool):
            return int(float(value)) if not isinstance(value, str) else int(value)
        if isinstance(default, float) and not isinstance(value, bool):
            return float(value)
        if isinstance(default, (list, tuple)) and isinstance(value, (list, tuple)):
            return list(value)
        if isinstance(default, str) and isinstance(value, str):
            return value
    except (TypeError, ValueError):
        pass
    raise ConfigurationError(f"can't read {name}: {value!r}")


def boolean(value: Any) -> bool:
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.strip().lower() in ("true", "false"):
        return value.strip().lower() == "true"
    raise ConfigurationError(f"a boolean was expected, not {value!r}")


@dataclass(frozen=True)
class Pipeline:
    components: tuple[Component, ...] = ()
    additional: tuple[str, ...] = ()
    vocabulary: DataFrame | None = None
    fitted: tuple[tuple[str, DataFrame], ...] = ()
    options: tuple[tuple[str, Any], ...] = ()

    # Edits: each derives another pipeline.

    def add(self, c: Component) -> Pipeline:
        """Add at the end; a second component of a name gets a number."""
        taken, name, k = {x.name for x in self.components}, c.name, 2
        while name in taken:
            name, k = f"{c.name}:{k}", k + 1
        if c.kind == "tokeniser":
            return replace(self, components=(replace(c, name=name), *(x for x in self.components if x.kind != "tokeniser")))
        return replace(self, components=(*self.components, replace(c, name=name)))

    def remove(self, *names: str) -> Pipeline:
        missing = set(names) - {c.name for c in self.components}
        if missing:
            raise ConfigurationError(f"no component is called {sorted(missing)}")
        return replace(self, components=tuple(c for c in self.components if c.name not in names))

    def deduplicated(self) -> Pipeline:
        """Without later components that do what an earlier one of the kind does."""
        seen, kept = set(), []
        for c in self.components:
            mark = (c.kind, c.name.rsplit(":", 1)[0] if c.name.rsplit(":", 1)[-1].isdigit() else c.name)
            if mark not in seen:
                seen.add(mark)
                kept.append(c)
        return replace(self, components=tuple(kept))

    def online(self, name: str, on: bool = True) -> Pipeline:
        return replace(self, components=tuple(replace(c, online=on) if c.name == name else c for c in self.components))

    def find(self, kind: str | None = None, prefix: str = "") -> list[Component]:
        return [c for c in self.components if (kind is None or c.kind == kind) and c.name.startswith(prefix)]

    def with_additional(self, features: Iterable[str]) -> Pipeline:
        return replace(self, additional=tuple(sorted({*self.additional, *features})))

    def without_additional(self, features: Iterable[str] | None = None) -> Pipeline:
        return replace(self, additional=() if features is None else tuple(sorted(set(self.additional) - set(features))))

    def with_vocabulary(self, vocabulary: DataFrame | None) -> Pipeline:
        """Only these features (column feature) are given; others are left out."""
        return replace(self, vocabulary=vocabulary)

    # Running.

    def _running(self, live: bool) -> list[Component]:
        return [c for c in self.components if c.online and (live or not c.only_online)]

    def tokens(self, docs: DataFrame, ident: str = "doc_id", text: str = "text", live: bool = True, placed: bool = False) -> DataFrame:
        """doc_id and ``items``: array of (pos, form, filtered, done). ``placed``
        puts whole texts where their ids belong, so that what is grouped or joined
        by document afterwards moves no feature."""
        use = self._running(live)
        tokeniser = next((c for c in use if c.kind == "tokeniser"), None)
        if tokeniser is None:
            raise ConfigurationError("a pipeline needs a tokeniser")
        rows = docs.select(ident, text)
        rows = (rows.repartition(F.col(ident)) if placed else spread(rows)).select(ident, tokeniser.run(F.col(text)).alias("items"))
        rows = rows.withColumn("items", F.transform("items", lambda x, i: F.struct(i.alias("pos"), x.alias("form"), F.lit(False).alias("filtered"), F.lit(False).alias("done"))))
        for kinds in (("processor",), ("filter",), ("normaliser", "stemmer")):
            for c in use:
                if c.kind not in kinds:
                    continue
                if c.kind in ("processor", "stemmer"):
                    rows = c.run(rows, ident)
                elif c.kind == "filter":
                    rows = rows.withColumn("items", F.transform("items", _marker(c.run)))
                else:
                    rows = rows.withColumn("items", F.transform("items", _normaliser(c.run)))
        return rows

    def _inferred(self, docs: DataFrame, items: DataFrame, use: list[Component], ident: str, fit: DataFrame | None) -> tuple[DataFrame | None, list[tuple[str, DataFrame]]]:
        feats, chosen, known = None, [], dict(self.fitted)
        for c in use:
            if c.kind == "inferrer":
                more = c.run(docs, items, ident).select(ident, "type", "pos", "feature")
                feats = more if feats is None else feats.unionByName(more)
            elif c.kind == "selector" and feats is not None:
                if fit is not None:
                    known[c.name] = stored(c.run["fit"](feats, fit, ident))
                if c.name in known:
                    chosen.append((c.name, known[c.name]))
        return feats, chosen

    def fit(self, docs: DataFrame, labels: DataFrame | None = None, ident: str = "doc_id", text: str = "text") -> Pipeline:
        """Fit the selectors in order, each to what the components before it
        give; the fitted pipeline."""
        selectors = self.find("selector")
        if not selectors:
            return self
        if labels is not None and all(c.run.get("labelled") for c in selectors):
            docs = T.only(docs, labels, ident)
        items = self.tokens(docs, ident, text, placed=True)
        labels = labels if labels is not None else docs.select(ident, F.lit("all").alias("label"))
        return replace(self, fitted=tuple(self._inferred(docs, items, self._running(True), ident, labels)[1]))

    def extract(self, docs: DataFrame, ident: str = "doc_id", text: str = "text", live: bool = True) -> DataFrame:
        """doc_id, type, pos, feature of each document."""
        use = self._running(live)
        items = self.tokens(docs, ident, text, live)
        feats, chosen = self._inferred(docs, items, use, ident, None)
        if feats is None:
            raise ConfigurationError("a pipeline needs something that infers features")
        extra = docs.sparkSession.createDataFrame([(f,) for f in self.additional], "feature string") if self.additional else None
        for name, top in chosen:
            types = next(c.run["types"] for c in use if c.name == name)
            feats = S.apply(feats, top, extra, types)
        if self.vocabulary is not None:
            feats = feats.join(self.vocabulary.select("feature").distinct(), "feature", "left_semi")
        return feats.select(ident, "type", "pos", "feature")

    def labelled(self, docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
        """Features with labels from another table (doc_id, label)."""
        return self.extract(docs, ident, text).join(labels, ident)

    def indexed(self, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
        """Features as numbers, and the index (feature, number) in order of name."""
        from pyspark.sql import Window

        feats = self.extract(docs, ident, text)
        # Numbers follow the order of names, counted by first letters, so no task sorts all.
        names = feats.select("feature").distinct().withColumn("head", F.substring("feature", 1, 2))
        heads = names.groupBy("head").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        index = names.withColumn("k", F.row_number().over(Window.partitionBy("head").orderBy("feature"))).join(F.broadcast(heads), "head").select("feature", (F.col("before") + F.col("k") - 1).alias("number"))
        return feats.join(index, "feature").select(ident, "type", "pos", "number"), index


def _marker(f: Callable) -> Callable[[Column], Column]:
    return lambda t: t.withField("filtered", t["filtered"] | F.coalesce(f(t["form"]), F.lit(False)))


def _normaliser(f: Callable) -> Callable[[Column], Column]:
    def run(t: Column) -> Column:
        got = f(t["form"])
        new, ends = got if isinstance(got, tuple) else (got, F.lit(False))
        skip = t["filtered"] | t["done"]
        return F.struct(t["pos"].alias("pos"), F.when(skip, t["form"]).otherwise(new).alias("form"), t["filtered"].alias("filtered"), (t["done"] | (~skip & ends)).alias("done"))

    return run


def build(options: Iterable[tuple[str, Any]]) -> Pipeline:
    """The pipeline that a list of options describes; unknown keys, values of
    the wrong kind and a missing tokeniser are errors."""
    options = tuple(options)
    out = Pipeline(options=options)
    for key, value in options:
        if key not in HANDLERS:
            raise ConfigurationError(f"unknown option {key!r}; known are {sorted(HANDLERS)}")
        out = HANDLERS[key](out, value)
    if not out.find("tokeniser"):
        raise ConfigurationError("a pipeline needs a tokeniser")
    return out


# The option keys.

_MODELS = ("cmu", "cmuTokeniseOnly", "chinesestanford", "arabicstanford", "germanstanford", "illinois")


def _plain(text: Column) -> Column:
    return F.regexp_extract_all(X.clean(F.coalesce(text, F.lit(""))), F.lit(r"(?i)(?:https?|ftp|file)://\S+|[#@]\w+|[\p{L}\p{Mn}\d]+(?:['’_-][\p{L}\p{Mn}\d]+)*|[^\s\p{L}\p{Mn}\d]+"), F.lit(0))


def bmp_only(text: Column) -> Column:
    """Letters beyond the basic plane go, white space becomes single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\u0000-￿]", ""), r"\s", " "))


@handler("tokeniser")
def _tokeniser(p: Pipeline, value: Any) -> Pipeline:
    o = Options("tokeniser", value)
    kind = o.take("type", "basic")
    punct, lower, urls, users = o.take("filter_punctuation", True), o.take("lower_case", True), o.take("normalise_urls", False), o.take("normalise_twitter_usernames", False)
    o.done()
    if kind == "basic":
        p = p.add(Component("tokeniser", "tokeniser", lambda t: X.tokenise(t, lower, urls, False, None if punct else X.ALL_PUNCT)))
        return p.add(Component("normalise_twitter_usernames", "normaliser", X.username)) if users else p
    if kind not in _MODELS:
        raise ConfigurationError(f"unsupported tokeniser {kind!r}")
    run = PLUGINS.get(kind) or (_plain if kind == "cmuTokeniseOnly" else None)
    if run is None:
        raise ConfigurationError(f"tokeniser {kind!r} needs a model that isn't bundled; provide it by plugin({kind!r}, f)")
    before = bmp_only if kind in ("chinesestanford", "arabicstanford") else X.clean
    p = p.add(Component("tokeniser", "tokeniser", lambda t: run(before(F.coalesce(t, F.lit(""))))))
    if lower:
        p = p.add(Component("lower_case", "normaliser", F.lower))
    if punct:
        p = p.add(Component("filter_punctuation", "filter", lambda f: X.is_punctuation(f)))
    if urls:
        p = p.add(Component("normalise_urls", "normaliser", lambda f: X.by_match(f, X.URL, "HTTPLINK")))
    if users:
        p = p.add(Component("normalise_twitter_usernames", "normaliser", X.username))
    return p


def _switch(key: str, *parts: Component) -> None:
    @handler(key)
    def _(p: Pipeline, value: Any) -> Pipeline:
        if boolean(value):
            for c in parts:
                p = p.add(c)
        return p


def _kept(items: DataFrame, ident: str) -> DataFrame:
    rows = F.transform(F.filter("items", lambda t: ~t["filtered"] & (t["form"] != "")), lambda t: F.struct(t["pos"].alias("pos"), t["form"].alias("form")))
    return items.select(ident, rows.alias("items"))


def _grams(kind: str, n: int) -> Component:
    return Component(f"{kind}s", "inferrer", lambda docs, items, ident: T.item_ngrams(_kept(items, ident), n, ident).withColumn("type", F.lit(kind)))


def _names(docs: DataFrame, items: DataFrame, ident: str) -> DataFrame:
    first = items.select(ident, F.try_element_at("items", F.lit(1))["form"].alias("first"))
    return T.first_name_features(first, F.col("first"), ident).withColumn("pos", F.lit(0))


_switch("unigrams", _grams("unigram", 1))
_switch("bigrams", _grams("bigram", 2))
_switch("trigrams", _grams("trigram", 3))
_switch("filter_links", Component("filter_links", "filter", X.is_link))
_switch("normalise_repeated_qe_marks", Component("normalise_repeated_qe_marks", "normaliser", X.repeated_queries))
_switch("first_name_gender_features", Component("first_name_gender_features", "inferrer", _names))


@handler("remove_stopwords")
def _stopwords(p: Pipeline, value: Any) -> Pipeline:
    named = isinstance(value, dict) or isinstance(value, str) and value.strip().startswith("{")
    use, lang = boolean(value) if not named else None, "en"
    if named:
        o = Options("remove_stopwords", value)
        lang, use = o.take("lang", "en"), o.take("use", False)
        o.done()
    return p.add(Component("remove_stopwords", "filter", lambda f, words=stopwords(lang): X.is_stopword(f, words))) if use else p


def stopwords(lang: str) -> list[str]:
    if lang not in X.STOPWORDS:
        raise ConfigurationError(f"no stop words for {lang!r}; there are lists for {sorted(X.STOPWORDS)}")
    return X.STOPWORDS[lang]


@handler("filter_keywords")
def _keywords(p: Pipeline, value: Any) -> Pipeline:
    words = json.loads(value) if isinstance(value, str) else value
    if not isinstance(words, (list, tuple, set)):
        raise ConfigurationError("filter_keywords takes a list of words")
    return p.add(Component("filter_keywords", "filter", lambda f: X.is_keyword(f, words)))


@handler("filter_regex")
def _regex(p: Pipeline, value: Any) -> Pipeline:
    if not isinstance(value, str):
        raise ConfigurationError("filter_regex takes a pattern")
    return p.add(Component(f"filter_regex:{value}", "filter", lambda f: X.matches(f, value)))


@handler("stemmer")
def _stemmer(p: Pipeline, value: Any) -> Pipeline:
    stemmed = stem.stemmer(Options("stemmer", value).take("lang", "en"))

    def run(rows: DataFrame, ident: str) -> DataFrame:
        rows = rows.withColumn("stems", stemmed(F.transform("items", lambda t: t["form"])))
        both = F.zip_with("items", "stems", lambda t, s: t.withField("form", F.when(t["filtered"] | t["done"], t["form"]).otherwise(s)).withField("done", ~t["filtered"] | t["done"]))
        return rows.select(ident, both.alias("items"))

    return p.add(Component("stemmer", "stemmer", run))


@handler("normalise_leading_trailing_punctuation")
def _strip(p: Pipeline, value: Any) -> Pipeline:
    keep = Options("normalise_leading_trailing_punctuation", value).take("exclude_twitter_tags", False)
    return p.add(Component("normalise_leading_trailing_punctuation", "normaliser", lambda f: X.strip_punctuation(f, keep)))


@handler("custom_ngrams")
def _custom(p: Pipeline, value: Any) -> Pipeline:
    o = Options("custom_ngrams", value)
    grams, filtered = o.take("ngrams", []), o.take("include_filtered_tokens", False)
    o.done()

    def run(docs, items, ident):
        rows = items if filtered else _kept(items, ident)
        toks = rows.select(ident, F.inline("items")).select(ident, "pos", "form")
        return T.custom_ngrams(toks, grams, ident).withColumn("pos", F.lit(0)).withColumn("type", F.lit("customNgram"))

    return p.add(Component("custom_ngrams", "inferrer", run)) if grams else p


@handler("phrase_ngrams")
def _phrases(p: Pipeline, value: Any) -> Pipeline:
    o = Options("phrase_ngrams", value)
    grams, overlaps, lower, take, ignore = o.take("ngrams", []), o.take("allow_overlaps", False), o.take("lowercase", True), o.take("filter_matches", True), o.take("ignore_filtered_tokens", True)
    o.done()

    def run(docs, items, ident):
        spark = items.sparkSession
        all_ = items.select(ident, F.transform("items", lambda t: F.struct(t["pos"].alias("pos"), t["form"].alias("form"))).alias("items"))
        found = M.phrase_matches(all_, spark.createDataFrame([(g,) for g in grams], "phrase string"), ident, lower)
        found = found if overlaps else M.without_overlaps(found, ident)
        toks = items.select(ident, F.inline("items")).select(ident, "pos", "form", "filtered")
        toks = toks.where(~F.col("filtered")) if ignore and not take else toks
        return M.phrase_features(M.annotate(toks.drop("filtered"), found, ident), ident).withColumn("type", F.lit("phraseNgram"))

    return p.add(Component("phrase_ngrams", "inferrer", run)) if grams else p


@handler("dependency_ngrams")
def _dependencies(p: Pipeline, value: Any) -> Pipeline:
    from corvane.operators import dependencies as D

    o = Options("dependency_ngrams", value)
    two, three, collapse, keep, lower = o.take("include_bigrams", True), o.take("include_trigrams", True), o.take("collapse_prepositions", True), o.take("keep_uncollapsed_prepositional_ngrams", False), o.take("lower_case", True)
    o.done()
    if not (two or three):
        return p

    def run(docs, items, ident):
        if "edges" not in PLUGINS:
            raise ConfigurationError("dependency_ngrams needs parsed documents; provide plugin('edges', docs -> edge table)")
        edges = PLUGINS["edges"](docs)
        parts = [f(e) for e in ([D.collapsed(edges), edges] if collapse and keep else [D.collapsed(edges)] if collapse else [edges]) for f in ([D.bigrams] if two else []) + ([D.trigrams] if three else [])]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        out = out.withColumn("feature", F.lower("feature")) if lower else out
        return out.withColumn("pos", F.lit(0)).withColumn("type", F.lit("dependencyNgram"))

    return p.add(Component("dependency_ngrams", "inferrer", run))


def _model_switch(key: str) -> None:
    @handler(key)
    def _(p: Pipeline, value: Any) -> Pipeline:
        if not boolean(value):
            return p
        if key not in PLUGINS:
            raise ConfigurationError(f"{key} needs a model that isn't bundled; provide it by plugin({key!r}, f)")
        return p.add(Component(key, "processor", PLUGINS[key]))


for _key in ("dependency_parser", "tag_converter", "illinois_ner"):
    _model_switch(_key)


@handler("http_service")
def _service(p: Pipeline, value: Any) -> Pipeline:
    url = Options("http_service", value).take("url", "")
    if url and "http_service" not in PLUGINS:
        raise ConfigurationError("http_service needs plugin('http_service', url -> processor)")
    return p.add(Component(f"service:{url}", "processor", PLUGINS["http_service"](url))) if url else p


@handler("feature_selection_basic")
def _select(p: Pipeline, value: Any) -> Pipeline:
    o = Options("feature_selection_basic", value)
    each, kind, lam, n, cutoff = o.take("selector_per_feature_type", False), o.take("feature_selection_type", "wllr").lower(), o.take("lambda", 0.5), o.take("feature_selection_limit", 1000), o.take("feature_count_cutoff", 3)
    types = [t for t in (x.strip() for x in o.take("feature_types", "bigram,unigram").split(",")) if t]
    o.take("custom_setup", "")
    o.done()
    lam = {"wllr": 0.5, "df": 1.0}.get(kind, lam)

    def one(own: list[str]) -> Component:
        def fit(feats: DataFrame, labels: DataFrame, ident: str) -> DataFrame:
            rows = feats.where(F.col("type").isin(own)) if own else feats
            e = S.evidence(rows, labels, ident)
            if kind == "mi":
                e = e.crossJoin(F.broadcast(labels.agg(F.countDistinct("label").alias("k"))))
            return S.top(e, S.mutual_information(F.col("k")) if kind == "mi" else S.wfo(lam), n, cutoff).select("feature")

        return Component(f"selector_basic_{kind}:{','.join(own)}", "selector", {"fit": fit, "types": tuple(own) or None, "labelled": True})

    for own in ([t] for t in types) if each else [types]:
        p = p.add(one(list(own)))
    return p


@handler("feature_selection_frequency_range")
def _range(p: Pipeline, value: Any) -> Pipeline:
    o = Options("feature_selection_frequency_range", value)
    lower, upper = o.take("lower", 3), o.take("upper", -1)
    o.done()
    fit = lambda feats, labels, ident: S.frequency_range(feats, lower, upper).select("feature")
    return p.add(Component(f"selector_freqrange_from_{lower}_to_{upper}", "selector", {"fit": fit, "types": None}))


#: Named option lists.
PRESETS: dict[str, tuple[tuple[str, Any], ...]] = {
    "basic": (("tokeniser", {"type": "basic"}), ("remove_stopwords", True), ("unigrams", True)),
    "basic_bigrams": (("tokeniser", {"type": "basic"}), ("remove_stopwords", True), ("unigrams", True), ("bigrams", True)),
    "social": (("tokeniser", {"type": "basic", "normalise_urls": True, "normalise_twitter_usernames": True}), ("remove_stopwords", True), ("unigrams", True)),
    "first_names": (("tokeniser", {"type": "basic"}), ("first_name_gender_features", True)),
}


def preset(name: str) -> Pipeline:
    if name not in PRESETS:
        raise ConfigurationError(f"no preset {name!r}; there are {sorted(PRESETS)}")
    return build(PRESETS[name])
