"""Exact dedup: skew-safe combining in three stages, comparing full content at each.

Two texts are equal when they are identical without white space. Of equal texts the row with the most code
points stays, then the smallest doc_id. All work is DataFrame operations.

1. Deduplicate locally: the map side of the first aggregation leaves one row per content and task.
2. Merge salted digest groups: those rows meet by (digest, content, salt); the salt is dealt by task.
3. Combine salt winners globally: at most ``salts`` rows per content meet by digest and are compared by content.

A group that holds a third of all rows thus reaches no task whole. Afterwards rows need only their digest to find
their group, in a join that adaptive execution may split at hot digests, as nothing after it needs them together; where
two contents share a digest, the content itself decides.

Defined results: null text counts as empty; empty texts form one group. A null doc_id ranks after all others.
Rows that repeat a doc_id with the same text are one group, of which one row stays. An empty table gives no rows.
Further columns pass through ``deduplicate`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import squeezed, written

SALTS = 16


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, content, digest and the order in which rows are preferred."""
    rows = docs.select("doc_id", squeezed(F.col("text")).alias("content"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))
    return rows.withColumn("digest", digest(F.col("content")))


def _rank() -> Column:
    """The greatest is the row that stays: most code points, then a doc_id, then the smallest."""
    return F.struct(F.col("points"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id") - 1).alias("late"))


def winners(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per content: digest, keep_id, keep_points, group_size and, where other contents share the digest, the content."""
    rows = _keyed(docs, digest).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = rows.groupBy("digest", "content", "salt").agg(F.max(_rank()).alias("best"), F.count("*").alias("n"))
    whole = salted.repartition("digest").groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    contents = whole.withColumn("contents", F.count("*").over(Window.partitionBy("digest")))
    return contents.select(
        "digest",
        (-F.col("best.late") - 1).alias("keep_id"),
        F.col("best.points").alias("keep_points"),
        "group_size",
        F.when(F.col("contents") > 1, F.col("content")).alias("clash"),
    )


def assignments(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (the digest, SHA-256 unless another is given)."""
    best = written(winners(docs, salts, digest), "exact-winners")
    rows = _keyed(docs, digest)
    same = ["digest", "doc_id", "points"]
    # rows that agree in all of this give equal results but for kept: they are counted here and told apart by number
    # at the end, so that the last join is followed by nothing that needs a digest's rows in one task
    found = rows.groupBy(*same).agg(F.count("*").alias("n")).join(best.where("clash is null").drop("clash"), "digest")
    if not best.where("clash is not null").isEmpty():
        other = best.where("clash is not null").withColumnRenamed("clash", "content")
        clashing = rows.join(other.select("digest").distinct(), "digest", "left_semi")
        clashing = clashing.groupBy(*same, "content").agg(F.count("*").alias("n")).join(other, ["digest", "content"])
        found = found.unionByName(clashing.select(found.columns))
    found = found.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")) & (F.col("turn") == 1)
    return found.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    best = written(winners(docs, salts, digest), "exact-winners")
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    text, doc_id = F.col(names[docs.columns.index("text")]), F.col(names[docs.columns.index("doc_id")])
    rows = flat.select("*", doc_id.alias("own_id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"), digest(squeezed(text)).alias("digest"))
    same = (rows.digest == best.digest) & (rows.points == best.keep_points) & rows.own_id.eqNullSafe(best.keep_id)
    same &= best.clash.isNull() | (best.clash == squeezed(text))
    kept = rows.join(best, same, "left_semi")
    # rows that repeat each other altogether are still here: one stays
    order = Window.partitionBy("digest", "points", "own_id").orderBy(*(F.col(n) for n, kind in flat.dtypes if not kind.startswith("map")))
    return kept.withColumn("turn", F.row_number().over(order)).where("turn = 1").select(*names).toDF(*docs.columns)
