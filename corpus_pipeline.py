"""A pipeline from raw documents to token ids: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir), with the columns of `documents`, and
works on all rows that the one before kept; all but the last return these
columns.  Rows with nulls, empty texts and repeated rows are treated as the
operators' docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackplan.llm.bpe import encode_documents
from trackplan.llm.exact_dedup import drop_exact_duplicates
from trackplan.llm.langid import drop_unidentified
from trackplan.llm.minhash import drop_near_duplicates
from trackplan.llm.mixing import in_mixture_order
from trackplan.llm.storage import Scratch, with_stored_order

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SIMILARITY = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the models reject."""
    return drop_unidentified(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    return drop_exact_duplicates(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates keep the row with the smallest doc_id."""
    return drop_near_duplicates(spark, docs, percent=SIMILARITY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the rows in the order of the mixture of sources."""
    return in_mixture_order(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, mixture_order and token_ids of a stored mixture; mixture_order rises with the place of the row."""
    return encode_documents(spark, with_stored_order(docs, "mixture_order"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ["doc_id", "lang", "source", "mixture_order"])


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mixture), ("byte-level BPE", encode)]

#: The models, hashes and tokenizer of the stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; results of the stages are tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
