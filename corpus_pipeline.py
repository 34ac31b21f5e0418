"""A corpus of documents from raw table to token shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gapmend.llm import decontaminate, host_rules, jaccard_join, mixing, token_store
from gapmend.llm.common import staged, table
from gapmend.session import scratch_path

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host does, go."""
    return host_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 stays."""
    return jaccard_join.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as the weights of their sources ask, in a new global order."""
    return mixing.replicated(docs).select("doc.*")


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the shards that this stage writes."""
    path = scratch_path(spark, "tokens")
    token_store.write_store(docs, path, TOKENIZER)
    return token_store.stored_documents(spark, path, docs.select("doc_id")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("mixing sources to target weights", source_mix), ("token-ID / binary output", token_shards)]

#: Token ids cannot be expressed in SQL; the tests compare each stage with SQL or direct encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage{i + 1}")
    return docs
