"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, encoding.

Each stage takes all that its predecessor kept; all but the last return the columns of documents. What a stage does with
nulls, empty and very long texts, ties, repeated rows and clashing names is what the operator it calls states; here:

- quality: a null or empty text fails and goes; a null source is a host of its own.
- exact: null counts as empty, empty texts form one group; of equal texts the longest row stays, then the smallest doc_id.
- near: empty texts are linked with nothing and stay; a row without doc_id stays.
- mix: texts without a word are never taken; of repeated rows each counts and each is drawn by itself.
- encode: a null or empty text has no tokens; a column token_ids of documents is replaced.

Every stage gives no rows for an empty table, and passes further columns on unchanged, whatever their names (the last
returns doc_id, source, n_chars, token_ids).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberframe.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from emberframe.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that too many documents of their host share."""
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids, and n_chars of the text."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "source", "n_chars", "token_ids")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]
#: BPE can't be told in SQL: the whole is tested against plain loops in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    folder: where the stages are written, below the shared folder. A run of the same folder that was broken off goes on
    after the last stage that was written whole (Parquet's job commit leaves _SUCCESS only then).
    """
    top = f"{shared_dir(spark)}/{folder or f'corpus-pipeline-{uuid.uuid4().hex}'}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        if not (folder and _finished(spark, path)):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a stage's folder was committed, told by Spark's own file system for it."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
