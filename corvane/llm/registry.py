"""Queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.chat_template import format_chats
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.html_extract import extract_pages
from corvane.llm.jaccard_join import near_groups
from corvane.llm.mixing import mixture
from corvane.llm.nearest import neighbours
from corvane.llm.sentencepiece_scan import encode, read_model
from corvane.llm.suffix_dedup import repeated_passages
from corvane.llm.toxicity import fit_lexicon, toxicity
from corvane.llm.warc import normalised_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target weights; a source that isn't named has weight 1.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 0.5, "src3": 0.25, "src4": 3.0}
BUDGET_SHARE = 0.5


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_table(spark, sf_dir, "embeddings"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"), WEIGHTS, BUDGET_SHARE)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised_pages(spark, _table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, fit_lexicon(docs, _table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), read_model())


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours,
        op2_chat_formatting,
        op3_mixing,
        op4_warc,
        op5_suffix_array_dedup,
        op6_toxicity,
        op7_sentencepiece,
        op8_html_extraction,
        op9_exact_dedup,
        op10_ngram_jaccard_join,
    )
}

SQL = {
    "op2_chat_formatting": """
        WITH m AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
                   coalesce(role, 'unknown') AS role, coalesce(text, '') || '<|im_end|>' AS body
            FROM conversations),
        p AS (SELECT *, '<|im_start|>' || role || chr(10) AS head FROM m),
        q AS (
            SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY n) - length(body) - 1 AS begins FROM p)
        SELECT conv_id, string_agg(head || body || chr(10), '' ORDER BY n) AS text, count(*) AS n_messages,
               coalesce(string_agg(CAST(CAST(begins AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS spans,
               CAST(coalesce(sum(length(body)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS generated_chars
        FROM q GROUP BY conv_id""",
    "op4_warc": """
        SELECT page_id, url, strlen(html) AS payload_bytes, md5(html) AS payload_md5 FROM pages""",
    "op5_suffix_array_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        g AS (
            SELECT doc_id, unnest(range(0, len(w) - 49)) AS pos,
                   unnest(list_transform(range(0, len(w) - 49), lambda i: md5(array_to_string(w[i + 1:i + 50], ' ')))) AS h
            FROM w WHERE len(w) >= 50),
        k AS (SELECT h, min({'d': doc_id, 'p': pos}) AS lead FROM g GROUP BY h HAVING count(*) > 1),
        r AS (SELECT DISTINCT doc_id, pos, (doc_id <> lead.d OR pos <> lead.p) AS later FROM g JOIN k USING (h)),
        s AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS opens FROM r),
        t AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM s)
        SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, count(*) AS windows, CAST(sum(CASE WHEN later THEN 1 ELSE 0 END) AS BIGINT) AS removable
        FROM t GROUP BY doc_id, span""",
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(lower(text), '[^\s]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS gram
            FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
        p AS MATERIALIZED (
            SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.6 * (x.size + y.size - shared) - 1e-9),
        e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r(doc_id, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
        c AS (SELECT doc_id, min(seen) AS group_id FROM r GROUP BY doc_id)
        SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM c""",
    "op3_mixing": """
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\s]+')), 0) AS BIGINT) AS n_tokens,
                   md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS mix_key,
                   CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 1.5 WHEN 'src2' THEN 0.5 WHEN 'src3' THEN 0.25 WHEN 'src4' THEN 3.0 ELSE 1.0 END AS weight
            FROM documents),
        q AS (
            SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY mix_key, doc_id NULLS FIRST, n_tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / weight AS finish
            FROM d),
        m AS (
            SELECT *, CAST(sum(n_tokens) OVER (ORDER BY finish, source NULLS FIRST, mix_key, doc_id NULLS FIRST, n_tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS mixed_tokens
            FROM q)
        SELECT doc_id, source, n_tokens, finish, mixed_tokens FROM m
        WHERE mixed_tokens <= (SELECT CAST(floor(sum(n_tokens) * 0.5) AS BIGINT) FROM d)""",
    "op9_exact_dedup": """
        SELECT doc_id,
               CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
               CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies
        FROM documents""",
}
