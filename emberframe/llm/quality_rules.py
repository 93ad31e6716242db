"""Quality rules: base counts of a text, and cross-document line frequency.

Cross-document part: every line with a word is normalised (A-Z and other letters lower-cased, runs of white space made
one space) and hashed. For each host and line the distinct documents that hold it are counted, exactly. Copies count
once: documents of a host with the same set of lines are one, and so are documents that hold the same frequent lines
(those in more rows than the limit) and beside them at most ``OWN`` of their words. All others are different documents,
however many lines they share. A line in more than ``max(min_documents, share * documents of the host)`` documents is
removed; a document that keeps less than ``least_left`` of its words is depleted and rejected. All work is DataFrame
operations; the lines are hashed once, into a table in the shared folder.

Hosts: the column ``source``. Hot hosts and hot lines are pre-aggregated by (host, line, document) before any shuffle.

Defined results: null text has no words and fails the base rules; a null source is a host of its own. Rows that repeat a
doc_id with the same text get the same verdict. A text is judged as one row, so the longest one has to fit a task several
times. An empty table gives no rows; further columns pass through ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, trimmed, word_array, written

MIN_DOCUMENTS, SHARE, LEAST_LEFT = 20, 0.02, 0.2
#: A page with a template of 20 lines and one own line of their length is a document; an own line in 30 makes a near copy.
OWN = 0.04
#: Fixed value: the characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs (columns doc_id, source, text)."""
    rows = docs.select("*", word_array(F.col("text")).alias("w"), _lines(F.col("text")).alias("lines"))
    rows = rows.select("*", F.size("w").alias("n"))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p")),
    )
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    rows = rows.select("*", F.when(F.col("n") >= 3, F.sort_array(windows)).otherwise(none).alias("sorted"))
    again = F.filter("sorted", lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    # a generator, as filters on its output are not pushed below it: they would evaluate the sorted windows once an element
    counts = F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
    )
    counts = rows.select(*docs.columns, F.inline(F.array(counts)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def _normal(line: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(line), SPACE + "+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def _host(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit(""))


def _key(docs: DataFrame) -> list[Column]:
    """What a verdict is found by: the id and the text, so that a reused id does no harm."""
    return [F.coalesce(docs["doc_id"], F.lit(-1)).alias("k_id"), F.xxhash64(docs["doc_id"].isNull(), docs["text"]).alias("k_text")]


def _line_table(docs: DataFrame) -> DataFrame:
    """k_id, k_text, host, lines: the hash and the words of every line that has a word. Written, as three steps read it."""
    words = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    lines = F.transform(F.transform(_lines(docs["text"]), _normal), lambda line: F.struct(F.xxhash64(line).alias("h"), words(line).alias("words")))
    return written(docs.select(*_key(docs), _host(docs).alias("host"), lines.alias("lines")), "quality-lines")


def frequent_lines(table: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """host, h: the hashes of the lines above the limit; table as _line_table gives it."""
    rows = table.select("host", F.sort_array(F.array_distinct("lines")).alias("lines"))
    counts = rows.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").count().where(F.col("count") > min_documents)
    hosts = table.groupBy("host").agg(F.count("*").alias("documents"))
    limit = F.greatest(F.lit(float(min_documents)), F.col("documents") * share)
    # there are no more documents than rows, so only these lines can be above the limit; written, so its size is known
    maybe = written(counts.join(hosts, "host").where(F.col("count") > limit).select("host", "h", limit.alias("limit")), "quality-maybe")
    total = F.aggregate("lines.words", F.lit(0), lambda n, x: n + x)
    held = rows.select("host", F.xxhash64("lines").alias("set"), total.alias("total"), F.inline("lines")).join(maybe, ["host", "h"])
    # rows with the same lines become one document; what differs beside the frequent lines is measured in words
    sets = held.groupBy("host", "set", "total").agg(F.sort_array(F.collect_set(F.struct("h", "words", "limit"))).alias("found"))
    own = F.col("total") - F.aggregate("found.words", F.lit(0), lambda n, x: n + x)
    name = F.when(own <= F.col("total") * OWN, F.struct(F.lit(True).alias("near"), F.xxhash64("found.h").alias("h"))).otherwise(F.struct(F.lit(False).alias("near"), F.col("set").alias("h")))
    names = sets.select("host", name.alias("name"), F.inline("found")).select("host", "h", "limit", "name").distinct()
    return names.groupBy("host", "h", "limit").count().where(F.col("count") > F.col("limit")).select("host", "h")


def losses(docs: DataFrame, **limits) -> DataFrame:
    """k_id, k_text, gone, removed: for documents that lose lines, the words they lose and the hashes of the lines."""
    table = _line_table(docs)
    lost = table.select("k_id", "k_text", "host", F.inline("lines")).join(frequent_lines(table, **limits), ["host", "h"])
    gone = lost.groupBy("k_id", "k_text").agg(F.sum("words").alias("gone"), F.collect_set("h").alias("removed"))
    # rows that repeat each other have summed their losses
    copies = table.groupBy("k_id", "k_text").agg(F.count("*").alias("copies")).where("copies > 1")
    gone = gone.join(copies, ["k_id", "k_text"], "left")
    return gone.select("k_id", "k_text", (F.col("gone") / F.coalesce("copies", F.lit(1))).cast("long").alias("gone"), "removed")


def _depleted(least_left: float) -> Column:
    return F.col("n_words") - F.coalesce("gone", F.lit(0)) < least_left * F.col("n_words")


def judge(docs: DataFrame, least_left: float = LEAST_LEFT, **limits) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, n_removed_words. No text travels through a shuffle."""
    rows = docs.select("doc_id", "source", "text")
    counts = base_counts(rows)
    small = counts.select(*_key(counts), *(c for c in counts.columns if c not in ("source", "text")))
    out = small.join(losses(rows, **limits).drop("removed"), ["k_id", "k_text"], "left")
    kept = ~F.col("base_failed") & ~_depleted(least_left)
    return out.withColumn("kept", kept).withColumn("n_removed_words", F.coalesce("gone", F.lit(0))).drop("k_id", "k_text", "gone")


def clean(docs: DataFrame, least_left: float = LEAST_LEFT, **limits) -> DataFrame:
    """The documents that pass, with all their columns; text without the lines above the limit, n_chars (if any) to match."""
    gone = losses(docs.select("doc_id", "source", "text"), **limits)
    names = [c if c in ("doc_id", "source", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    counts = base_counts(docs.toDF(*names)).where("not base_failed")
    rows = counts.select(*names, "n_words", *_key(counts)).join(gone, ["k_id", "k_text"], "left").where(~_depleted(least_left))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda line: ~F.array_contains("removed", line_hash(line))), "\n")
    rows = rows.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(left))
    out = rows.select(*names).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
