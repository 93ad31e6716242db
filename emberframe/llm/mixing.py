"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources in code point order (null last) have weights that repeat; the total size is shared by weight, no
source gets more than ``most_epochs`` times its own size, and what is above is shared again by weight among the rest.
That fixed point is found directly: with r = cap / weight in rising order, the capped sources are the first ones.

Selection: a source with target t and size s is taken floor(t / s) times whole (complete epochs come first); the rest of
its target is drawn from its documents in the order of their keys -ln(u) / quality, smallest first, where u in (0, 1)
comes from a hash of doc_id. Documents are taken while their prefix sum of sizes stays within the rest; the document
across the boundary is taken if that brings the sum nearer. Reruns agree.

Prefix sums of a source are never one task's work: keys are dealt to ranges, ``bins`` for each doubling of the key; sizes
are summed by (source, bin) and prefix-summed over bins; only the bin in which the rest ends is ordered document by
document. Keys of one quality are exponential, so no bin expects more than 1/900 of a source, whatever its qualities are.
All work is DataFrame operations.

Quality: 1 / (1 + 10 * symbols / words), so that junk is drawn late.

Defined results: null text has size 0 and is taken 0 words; a source of size 0 has target 0; null source is a source of
its own; equal keys are ordered by doc_id. Rows that repeat each other have one key and are drawn one after the other, so
a source ends within half a document of its target. A null doc_id draws its key from the text. Targets are found in one
ordered pass over the sources, one row each, so there should be fewer than millions of them. An empty table gives no rows. Further columns pass through ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, trimmed, written

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS, BINS = 3, 256


def size_of(text: Column) -> Column:
    bare = trimmed(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE + "+", -1))).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * symbols / F.greatest(size, F.lit(1)))


def uniform(doc_id: Column, text_key: Column) -> Column:
    """In (0, 1), from the first 48 bits of a digest of the id."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), text_key.cast("string")))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds target to sizes(source, source_size), which has one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(rank, F.lit(len(weights))))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most_epochs))
    rows = rows.withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    # the level that all from here on would get if exactly the sources before were capped
    rows = rows.withColumn("shared", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    # the first source whose own level is not below it starts the sources that are not capped
    water = F.min(F.when(F.col("shared") <= F.col("level"), F.struct("level", "shared"))).over(whole)["shared"]
    rows = rows.withColumn("water", water)
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def _units(docs: DataFrame) -> DataFrame:
    """One row per distinct document: doc_id, text_key, source, size, quality, copies, unit_size."""
    rows = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_key"), size_of(F.col("text")).alias("size"))
    rows = rows.select("doc_id", "text_key", "source", "size", quality_of(F.col("text"), F.col("size")).alias("quality"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).withColumn("unit_size", F.col("size") * F.col("copies"))


def _drawn(docs: DataFrame, bins: int) -> DataFrame:
    """The units of docs with source_size, target, epochs (how often each copy is taken) and extra (how many copies are taken once more)."""
    key = -F.log(uniform(F.col("doc_id"), F.col("text_key"))) / F.col("quality")
    rows = _units(docs).withColumn("key", key)
    # the logarithm keeps the order, and a lower quality only moves keys to bins that are as narrow
    rows = written(rows.withColumn("bin", F.floor(F.log("key") * (bins / math.log(2))).cast("int")), "mix-units")
    by_bin = rows.groupBy("source", "bin").agg(F.sum("unit_size").alias("bin_size"))
    goals = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    plan = by_bin.withColumn("bin_from", F.coalesce(F.sum("bin_size").over(up_to), F.lit(0)))
    plan = plan.join(goals.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    plan = plan.withColumnsRenamed({"source": "p_source", "bin": "p_bin"})
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bin") == F.col("p_bin"))).drop("p_source", "p_bin")
    within = F.col("bin_from") + F.col("bin_size") <= F.col("rest")
    beyond = F.col("bin_from") >= F.col("rest")
    sure = out.where(within | beyond).withColumn("extra", F.when(within & (F.col("rest") > 0), F.col("copies")).otherwise(0).cast("long"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    edge = out.where(~within & ~beyond).withColumn("start", F.col("bin_from") + F.coalesce(F.sum("unit_size").over(order), F.lit(0)))
    # copies are drawn one by one: those that fit whole, and one more if that brings the sum nearer
    room = F.greatest(F.col("rest") - F.col("start"), F.lit(0.0))
    fit = F.when(F.col("size") > 0, F.least(F.floor(room / F.col("size")), F.col("copies"))).otherwise(0)
    left = room - fit * F.col("size")
    more = (F.col("size") > 0) & (fit < F.col("copies")) & (left > 0) & (2 * left >= F.col("size"))
    edge = edge.withColumn("extra", (fit + more.cast("long")).cast("long")).drop("start")
    # no source is taken more than MOST_EPOCHS times, so nothing is left to draw where epochs has reached it
    out = sure.unionByName(edge).withColumn("extra", F.when(F.col("epochs") >= MOST_EPOCHS, 0).otherwise(F.col("extra")))
    return out.withColumn("epochs", F.least("epochs", F.lit(MOST_EPOCHS)))


def draw(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and source, quality, times."""
    out = _drawn(docs, bins).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    out = out.withColumn("times", F.col("epochs") + (F.col("copy") <= F.col("extra")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "quality", "times")


def mix(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with all columns of docs."""
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    taken = _drawn(docs, bins).where("size > 0 and epochs + extra > 0")
    taken = taken.select(F.col("doc_id").alias("t_id"), "text_key", "epochs", "extra", "copies")
    rows = docs.toDF(*names).withColumn("key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("key") == F.col("text_key"))
    out = rows.join(taken, same).drop("t_id", "text_key")
    single = out.where("copies = 1").withColumn("times", F.col("epochs") + F.col("extra"))
    # equal rows are combined before they are numbered, so a row that is repeated any number of times is one
    again = out.where("copies > 1").groupBy(*names, "key", "epochs", "extra", "copies").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id", "key").orderBy(*(n for n in names if n not in ("doc_id", "text")), "n").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    several = again.withColumn("before", before).withColumn("times", F.col("n") * F.col("epochs") + F.greatest(F.least(F.col("extra") - F.col("before"), F.col("n")), F.lit(0)))
    out = single.select(*names, "times").union(several.where("times > 0").select(*names, "times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*names).toDF(*docs.columns)
