"""A raw corpus made into training tokens, in five stages. Each stage's rows are written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm.bpe import bpe_encode
from tidebar.llm.common import cut, discard
from tidebar.llm.mixing import replicate
from tidebar.llm.ngram_join import one_of_each
from tidebar.llm.quality import fit_quality, keep_good
from tidebar.llm.secrets import without_secrets
from tidebar.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, rejects go."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at random so that sources get their weights, and shuffled."""
    return replicate(docs).drop("copy", "shuffle_key")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)."""
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("source mixing", mixing), ("BPE", tokens)]

#: The classifier and the tokenizer can't be said in SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
