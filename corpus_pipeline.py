"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
folder and reads it again for the next. All but the last keep the columns of the documents.

1. quality rules: documents that a rule rejects go.
2. n-gram Jaccard join: one document of each group of near copies stays.
3. secret scans: base spans and live candidates are replaced by a mark in the text.
4. mixing: documents are repeated or left out so that the sources come to their target weights.
5. byte-level BPE: token counts and digests of what goes to training.

An empty table gives an empty result at each stage. Columns beyond those of the documents are
carried along by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import bpe, mixing, ngram_join, quality, secrets
from siftwork.llm._common import materialize, workspace

#: Ranks and pre-token pattern of the last stage.
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words and go; repeated rows stay or go together."""
    return quality.keep_clean(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies and of equal texts: that with the least id, a null id last. Null texts are no copies of each other."""
    return ngram_join.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with reported secrets replaced in ``text`` and ``n_chars`` counted anew. A null text stays null."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out for their source's target; null sources are one source, and texts without words are left out or repeated by chance alone."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of counts and digests for each row that goes to training; a null text has no tokens."""
    return bpe.encode(docs, VOCABULARY, PATTERN)


STAGES = [("quality_rules", clean), ("ngram_join", distinct), ("secret_scan", without_secrets), ("source_mix", mixed), ("byte_bpe", encoded)]

#: SQL can express neither the join's classes nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``."""
    path = workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
