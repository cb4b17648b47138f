"""From raw documents to token ids, in five stages.

Every stage works on all that its predecessor kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.llm._common import shared_dir
from corvane.llm.exact_dedup import drop_exact_copies
from corvane.llm.jaccard_join import drop_near_copies
from corvane.llm.mixing import take_mixture
from corvane.llm.sentencepiece_scan import encode, read_model
from corvane.llm.toxicity import drop_toxic, fit_lexicon

#: Target weights of the mixture; sources that aren't named have weight 1.
WEIGHTS = {"src0": 2.0}
#: Share of the tokens that reach the mixture which it may hold.
BUDGET_SHARE = 0.9


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, doesn't reject."""
    return drop_toxic(docs, fit_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, that with the least id."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies, that with the least id."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the weighted mixture within its budget."""
    return take_mixture(docs, WEIGHTS, BUDGET_SHARE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text."""
    return encode(docs, read_model())


STAGES = [("toxicity", toxicity), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("SentencePiece", token_ids)]

#: Learned lexicons and token ids can't be said in SQL; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder as
    Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
