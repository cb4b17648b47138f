"""Models, counters and processed documents in folders of Parquet tables.

Everything is saved beside its place and moved there whole: a save that fails
leaves what was there before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.bayes import Model, Precomputed

TABLES = ("labels", "joint", "vocab")


class StoreError(ValueError):
    """A path that holds no such thing, or a configuration that doesn't match."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


def save_all(spark: SparkSession, folder: str, parts: dict[str, Callable[[str], None]]) -> None:
    """Write all ``parts`` (name: writer of a path) of a folder, or none of them."""
    fs, at = _fs(spark, folder)
    new = _fs(spark, f"{folder.rstrip('/')}.new-{uuid.uuid4().hex}")[1]
    old = _fs(spark, f"{folder.rstrip('/')}.old-{uuid.uuid4().hex}")[1]
    try:
        fs.mkdirs(new)
        for name, write in parts.items():
            write(f"{new}/{name}")
    except BaseException:
        fs.delete(new, True)
        raise
    had = fs.exists(at)
    if had:
        fs.rename(at, old)
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        fs.delete(new, True)
        raise StoreError(f"can't put {folder} in place")
    if had:
        fs.delete(old, True)


def _text(spark: SparkSession, value: str) -> Callable[[str], None]:
    return lambda path: spark.createDataFrame([(value,)], "value string").coalesce(1).write.text(path)


def _table(df: DataFrame) -> Callable[[str], None]:
    return lambda path: df.write.parquet(path)


def save_model(m: Model, folder: str, options=(), training: DataFrame | None = None, **metadata) -> None:
    """A model with the options of its pipeline, its training documents and
    whatever else describes it."""
    spark = m.labels.sparkSession
    meta = {"type": "naive-bayes", "phi": m.phi, "lam": m.lam, "empirical": m.empirical, "options": [list(o) for o in options], **metadata}
    parts = {"metadata": _text(spark, json.dumps(meta)), **{t: _table(getattr(m, t)) for t in TABLES}}
    if training is not None:
        parts["training"] = _table(training)
    save_all(spark, folder, parts)


def is_model(spark: SparkSession, folder: str) -> bool:
    return all(exists(spark, f"{folder}/{t}") for t in ("metadata", *TABLES))


def read_metadata(spark: SparkSession, folder: str) -> dict:
    if not exists(spark, f"{folder}/metadata"):
        raise StoreError(f"no model at {folder}")
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/metadata").collect()))  # one short file


def load_model(spark: SparkSession, folder: str) -> Model:
    if not is_model(spark, folder):
        raise StoreError(f"no model at {folder}")
    meta = read_metadata(spark, folder)
    return Model(*(spark.read.parquet(f"{folder}/{t}") for t in TABLES), phi=meta["phi"], lam=meta["lam"], empirical=meta["empirical"])


def load_training(spark: SparkSession, folder: str, labels: DataFrame | None = None, ident: str = "doc_id") -> DataFrame:
    """The training documents, with new labels (id, label) where they are given."""
    rows = spark.read.parquet(f"{folder}/training")
    return rows if labels is None else rows.drop("label").join(labels, ident)


def save_precomputed(p: Precomputed, folder: str) -> None:
    """Log probabilities alone, as models of older versions were kept."""
    save_all(p.labels.sparkSession, folder, {t: _table(getattr(p, t)) for t in ("labels", "terms", "vocab")})


def load_precomputed(spark: SparkSession, folder: str) -> Precomputed:
    return Precomputed(*(spark.read.parquet(f"{folder}/{t}") for t in ("labels", "terms", "vocab")))


def model_to_json(m: Model) -> DataFrame:
    """One JSON line a pair of label and feature, and one a label, by their names."""
    pairs = m.joint.select(F.to_json(F.struct(F.lit("pair").alias("kind"), "label", "feature", "n", "alpha")).alias("value"))
    return pairs.unionByName(m.labels.select(F.to_json(F.struct(F.lit("label").alias("kind"), "*")).alias("value")))


def model_from_json(lines: DataFrame) -> Model:
    row = F.from_json("value", "kind string, label string, feature string, n double, alpha double, doc_count double, token_count double, alpha_total double, label_alpha double, multiplier double")
    rows = lines.select(row.alias("r")).select("r.*")
    joint = rows.where("kind = 'pair'").select("label", "feature", "n", "alpha")
    labels = rows.where("kind = 'label'").select("label", "doc_count", "token_count", "alpha_total", "label_alpha", "multiplier")
    return Model(labels, joint, joint.select("feature").distinct())


def save_counts(counts: DataFrame, folder: str) -> None:
    """A background counter (type, feature, n)."""
    save_all(counts.sparkSession, folder, {"counts": _table(counts.select("type", "feature", "n"))})


def load_counts(spark: SparkSession, folder: str) -> DataFrame:
    from corvane.operators.contrast import with_totals

    return with_totals(spark.read.parquet(f"{folder}/counts"))


def config_key(options) -> str:
    """A pipeline's key in the cache: 256 bits of its options, in their order."""
    import hashlib

    return hashlib.sha256(json.dumps([list(o) for o in options], sort_keys=True).encode()).hexdigest()


class DocumentCache:
    """Processed documents of pipelines, a folder a pipeline and dataset."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, options, dataset: str) -> str:
        return f"{self.folder}/{config_key(options)}/{dataset}"

    def _guard(self, options) -> None:
        """The options are kept beside the key; other options under it are an error."""
        at, want = f"{self.folder}/{config_key(options)}.options", json.dumps([list(o) for o in options], sort_keys=True)
        if not exists(self.spark, at):
            _text(self.spark, want)(at)
        elif "\n".join(r[0] for r in self.spark.read.text(at).collect()) != want:  # one short file
            raise StoreError("two configurations have one key")

    def processed(self, docs: DataFrame, options, process: Callable[[DataFrame], DataFrame], dataset: str = "all", ident: str = "doc_id") -> DataFrame:
        """What ``process`` gives for ``docs``; only documents that aren't held
        are worked on, and then held."""
        self._guard(options)
        at = self._at(options, dataset)
        held = f"{at}/ids"
        new = docs.join(self.spark.read.parquet(held), ident, "left_anti") if exists(self.spark, held) else docs
        process(new).write.mode("append").parquet(f"{at}/rows")
        new.select(ident).write.mode("append").parquet(held)
        return self.spark.read.parquet(f"{at}/rows").join(docs.select(ident).distinct(), ident, "left_semi")

    def count(self, options, dataset: str = "all") -> int:
        at = f"{self._at(options, dataset)}/ids"
        return self.spark.read.parquet(at).distinct().count() if exists(self.spark, at) else 0

    def fraction(self, docs: DataFrame, options, dataset: str = "all", ident: str = "doc_id") -> float:
        at, total = f"{self._at(options, dataset)}/ids", docs.count()
        return docs.join(self.spark.read.parquet(at), ident, "left_semi").count() / total if total and exists(self.spark, at) else 0.0

    def datasets(self, options) -> list[str]:
        fs, at = _fs(self.spark, f"{self.folder}/{config_key(options)}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, options, dataset: str | None = None) -> bool:
        return delete(self.spark, f"{self.folder}/{config_key(options)}" + (f"/{dataset}" if dataset else ""))


def move_service(spark: SparkSession, folder: str, old: str, new: str) -> dict:
    """Put another address of a service into a saved model's options."""
    meta = read_metadata(spark, folder)
    for option in meta["options"]:
        if option[0] == "http_service" and option[1].get("url") == old:
            option[1]["url"] = new
    keep = {t: spark.read.parquet(f"{folder}/{t}") for t in (*TABLES, "training") if exists(spark, f"{folder}/{t}")}
    save_all(spark, folder, {"metadata": _text(spark, json.dumps(meta)), **{t: _table(df) for t, df in keep.items()}})
    return meta
