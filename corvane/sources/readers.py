"""Readers and writers of labelled texts and background corpora.

Files are read by Spark's own sources, so they are split, pruned and spread.
Malformed JSON records become rows of nulls, which are left out.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSTANCE = "label string, id string, text string"
TOKEN = "struct<attributes:map<string,string>,filtered:boolean,start:int,end:int>"
DOCUMENT = f"struct<source:struct<label:string,id:string,text:string>,annotatedTokens:array<{TOKEN}>>"


def read_instances(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """label, id, text from files of JSON arrays, or of one JSON record a line
    (which split, and so suit large files)."""
    rows = spark.read.schema(INSTANCE).json(path, multiLine=not lines, encoding="UTF-8")
    return rows.where("label is not null or id is not null or text is not null")


def write_instances(rows: DataFrame, path: str) -> None:
    """JSON lines of label, id and text; null fields are left out."""
    rows.select("label", F.col("id").cast("string"), "text").write.json(path)


def write_array(rows: DataFrame, path: str) -> None:
    """Files that are each one JSON array, a file a partition, written as a stream."""

    def run(batches):
        first = True
        for batch in batches:
            out = [("[" if first and not i else ",") + x for i, x in enumerate(batch.column(0).to_pylist())]
            if out:
                first = False
                yield pa.record_batch({"value": pa.array(out, pa.string())})
        yield pa.record_batch({"value": pa.array(["[]" if first else "]"])})

    rows.select(F.to_json(F.struct("label", F.col("id").cast("string").alias("id"), "text")).alias("value")).mapInArrow(run, "value string").write.text(path)


def lines_to_array(spark: SparkSession, lines: str, path: str) -> None:
    """Files of JSON lines as files of JSON arrays."""
    write_array(read_instances(spark, lines, lines=True), path)


def document_to_json(document: Column) -> Column:
    return F.to_json(document)


def document_from_json(text: Column) -> Column:
    return F.from_json(text, DOCUMENT)


def documents(docs: DataFrame, tokens: DataFrame | None = None, ident: str = "doc_id") -> DataFrame:
    """id and document (source and annotated tokens) from texts and token spans
    (id, pos, form, start, end), or from rows that hold them as ``spans``."""
    token = lambda x: F.struct(F.create_map(F.lit("form"), x["form"]).alias("attributes"), F.lit(False).alias("filtered"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))
    if tokens is None:
        rows = docs
    else:
        rows = docs.join(tokens.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("pos", "form", "start", "end"))).alias("spans")), ident, "left")
    source = F.struct(F.lit(None).cast("string").alias("label"), F.col(ident).cast("string").alias("id"), F.col("text"))
    return rows.select(ident, F.struct(source.alias("source"), F.coalesce(F.transform("spans", token), F.array().cast(f"array<{TOKEN}>")).alias("annotatedTokens")).cast(DOCUMENT).alias("document"))


def read_texts_csv(spark: SparkSession, path: str, encoding: str = "UTF-16") -> DataFrame:
    """Texts of a CSV with a header column ``text``, trimmed, without characters
    beyond U+200F."""
    rows = spark.read.csv(path, header=True, encoding=encoding, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, escape='"')
    return rows.select(F.trim(F.regexp_replace("text", r"[^\u0000-‏]", "")).alias("text"))


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """title and text of a search dump, in which lines of an index action and of
    a page alternate; a page is told by its own fields, so files may be split."""
    page = F.from_json("value", "title string, text string, index struct<_id:string>")
    rows = spark.read.text(path).select(page.alias("p"))
    return rows.where("p.index is null and p.text is not null").select("p.title", "p.text")


def read_name_counts(spark: SparkSession, path: str) -> DataFrame:
    """gender, name (lower case), count over all years of files of the lines
    name,gender,count."""
    rows = spark.read.schema("name string, gender string, count long").csv(path)
    return rows.where("name is not null and gender is not null").groupBy("gender", F.lower("name").alias("name")).agg(F.sum("count").alias("count"))


def name_training_data(spark: SparkSession, path: str, to: str) -> None:
    """Name counts as labelled instances: the label is the gender, the id the count."""
    write_instances(read_name_counts(spark, path).select(F.col("gender").alias("label"), F.col("count").alias("id"), F.col("name").alias("text")), to)


def enriched(docs: DataFrame, call, schema: str, tries: int = 5) -> DataFrame:
    """Rows through a service: ``call`` takes a list of dictionaries and returns
    as many; a call that fails is tried again, up to ``tries`` times."""

    def run(batches):
        for batch in batches:
            for k in range(tries):
                try:
                    got = call(batch.to_pylist())
                    break
                except OSError:
                    if k == tries - 1:
                        raise
            if got:
                yield pa.RecordBatch.from_pylist([json.loads(json.dumps(r)) for r in got])

    return docs.mapInArrow(run, schema)
