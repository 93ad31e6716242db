"""The queries of the corpus operators, each over its whole table, and what they should return as SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, exact_dedup, language_id, minhash, mixing, quality_rules, substring_dedup, url_filters, warc
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.examples(rows.unionByName(more)))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assignments(table(spark, sf_dir, "documents"))


def capture_records(pages: DataFrame) -> DataFrame:
    """WARC records told by pages: a response per page (every fifth a 404), and a revisit half a day later.

    The revisit's validators go by page_id modulo 4: the same ETag, a weak one, an older one, or only a date.
    """
    page, tag = F.col("page_id"), F.md5("html")
    when = F.timestamp_seconds(F.lit(1_700_000_000) + page * 3600)
    date = F.concat(F.lit("day "), F.floor(page / 24).cast("string"))
    stored = F.create_map(
        F.lit("etag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("last-modified"), date, F.lit("cache-control"), F.lit("max-age=60"),
        F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("content-type"), F.lit("text/html"),
    )
    status = F.when(page % 5 == 0, 404).otherwise(200)
    told = F.when(page % 4 == 0, F.concat(F.lit('"'), tag, F.lit('"'))).when(page % 4 == 1, F.concat(F.lit('W/"'), tag, F.lit('"'))).when(page % 4 == 2, F.lit('"old"'))
    asked = F.map_concat(
        F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0")),
        F.when(page % 4 == 3, F.create_map(F.lit("last-modified"), date)).otherwise(F.create_map(F.lit("etag"), told)),
    )
    first = pages.select(F.concat(F.lit("r"), page).alias("record_id"), F.lit("response").alias("kind"), "url", when.alias("time"), status.alias("status"), stored.alias("headers"))
    later = pages.select(F.concat(F.lit("v"), page).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#later")).alias("url"), (when + F.expr("interval 12 hours")).alias("time"), F.lit(304).alias("status"), asked.alias("headers"))
    return first.unionByName(later)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(capture_records(table(spark, sf_dir, "pages")))
    number = lambda c: F.substring(c, 2, 20).cast("long")
    told = F.array_join(F.transform(F.sort_array(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(number("record_id").alias("page_id"), "canonical_url", number("response_id").alias("response_page_id"), "result", told.alias("headers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_url_filters, op3_substring_dedup, op4_bpe, op5_quality_rules, op6_mixing,
        op7_chat_formatting, op8_minhash_near_dedup, op9_exact_dedup, op10_warc_revisits,
    )
}
