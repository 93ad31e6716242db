"""Checks that return violations, distributions, reconciliations and anomaly catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_missing


def missing_matrix(rows: DataFrame, by: Column, columns: list[str]) -> DataFrame:
    """group, field, n, missing: one scan, unpivoted after aggregation."""
    wide = rows.groupBy(by.alias("group")).agg(F.count("*").alias("n"), *(F.count_if(is_missing(F.col(c).cast("string"))).alias(c) for c in columns))
    return wide.unpivot(["group", "n"], columns, "field", "missing")


def completeness(rows: DataFrame, column: str) -> DataFrame:
    """n, missing and the percentage to four places."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(is_missing(F.col(column).cast("string"))).alias("missing"))
    return out.withColumn("percent", F.round(F.try_divide(100.0 * F.col("missing"), F.col("n")), 4))


def distribution(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Exact quantiles with linear interpolation, at any number of values a group."""
    points = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    values = rows.select(*by, F.col(column).cast("double").alias("value"))
    out = values.groupBy(*by).agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))
    found = quantiles(values, by, points)
    same = F.lit(True)
    for c in by:
        same &= out[c].eqNullSafe(found[c])
    six = lambda c: F.round(c, 6).alias(c)
    return out.join(found, same, "left").select(*(out[c] for c in by), "n", six("least"), six("most"), six("mean"), *(F.round(f"q{i}", 6).alias(f"p{int(p * 100)}") for i, p in enumerate(points)))


def quantiles(values: DataFrame, by: list[str], points: list[float], bins: int = 256) -> DataFrame:
    """by and q0, q1, ..: exact quantiles of value, interpolated. No task holds the values of a group.

    Equal values are counted first. Approximate quantiles part each group's range into bins; counts of bins tell which bins
    hold the wanted ranks, and only those are ordered, each by itself.
    """
    counts = values.where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("m"))
    parts = values.groupBy(*by).agg(F.count("value").alias("n"), F.percentile_approx("value", [i / bins for i in range(1, bins)], 4 * bins).alias("ends")).where("n > 0")
    keys = [f"k{i}" for i in range(len(by))]
    parts = parts.toDF(*keys, "n", "ends")
    same = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        same &= F.col(c).eqNullSafe(F.col(k))
    # a value that is itself an end comes into the bin below it, so equal values share one
    binned = counts.join(parts, same).select(*keys, "n", "value", "m", F.size(F.filter("ends", lambda e: e < F.col("value"))).alias("bin"))
    # approximate quantiles may differ each time they are found, so bins are found once and then told by the values they hold
    sums = binned.groupBy(*keys, "n", "bin").agg(F.sum("m").alias("held"), F.min("value").alias("least"), F.max("value").alias("most"))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), side.cast("long").alias("rank")) for i, p in enumerate(points) for side in (F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1)))))
    asked = F.filter(ranks, lambda r: (r["rank"] >= F.col("start")) & (r["rank"] < F.col("start") + F.col("held")))
    wanted = sums.select(*keys, "n", "start", "least", "most", asked.alias("asked")).where(F.size("asked") > 0)
    within = Window.partitionBy(*keys, "least").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(wanted, same & F.col("value").between(F.col("least"), F.col("most"))).withColumn("first", F.col("start") + F.coalesce(F.sum("m").over(within), F.lit(0)))
    hits = placed.select(*keys, "n", "value", "m", "first", F.explode("asked").alias("r")).where((F.col("r.rank") >= F.col("first")) & (F.col("r.rank") < F.col("first") + F.col("m")))
    ends = hits.groupBy(*keys, "n", F.col("r.i").alias("i"), F.col("r.p").alias("p")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.col("p") * (F.col("n") - 1)
    value = F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))
    wide = ends.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, value)).alias(f"q{i}") for i in range(len(points))))
    return wide.toDF(*by, *(f"q{i}" for i in range(len(points))))


def anomalies(rows: DataFrame, ident: str, rules: dict[str, Column]) -> DataFrame:
    """rule, n, records: every rule has a row, also without a hit."""
    hits = rows.select(F.col(ident).alias("id"), F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
    # the names as a literal relation, whose size the planner knows
    axis = rows.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"(:r{i})" for i in range(len(rules))) + " AS t(rule)", args={f"r{i}": k for i, k in enumerate(rules)})
    return axis.join(hits.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("id").alias("records")), "rule", "left").na.fill(0, ["n", "records"])


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """side and value: what one has and the other not, with multiplicity."""
    one = lambda x, y, side: x.exceptAll(y).select(F.lit(side).alias("side"), "*")
    return one(a, b, "missing").unionByName(one(b, a, "unexpected"))


def reconcile(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name and problem of manifest(name, bytes, sha256) against files(name, bytes, sha256)."""
    both = manifest.alias("m").join(files.alias("f"), "name", "full")
    bad = F.when(F.col("f.bytes").isNull(), "missing").when(F.col("m.bytes").isNull(), "unexpected").when(F.col("m.bytes") != F.col("f.bytes"), "size").when(F.col("m.sha256") != F.col("f.sha256"), "checksum")
    return both.select("name", bad.alias("problem")).where("problem is not null")


def unique_ids(rows: DataFrame, ident: str, expected: int | None = None) -> DataFrame:
    """Violations: problem and count."""
    c = F.col(ident).cast("string")
    got = rows.agg(F.count("*").alias("n"), F.count_distinct(F.when(~is_missing(c), c)).alias("d"), F.count_if(is_missing(c)).alias("m"))
    told = F.array(F.struct(F.lit("missing id").alias("problem"), F.col("m").alias("count")), F.struct(F.lit("repeated id").alias("problem"), (F.col("n") - F.col("m") - F.col("d")).alias("count")), F.struct(F.lit("row count").alias("problem"), (F.col("n") != F.lit(expected if expected is not None else -1)).cast("long").alias("count") if expected is not None else F.lit(0).cast("long").alias("count")))
    return got.select(F.explode(told).alias("x")).select("x.*").where("count > 0")


def stages_agree(rows: DataFrame, level: str, ident: str) -> DataFrame:
    """Per level: rows, distinct ids, and how many ids of other levels it lacks."""
    per = rows.groupBy(level).agg(F.count("*").alias("n"), F.count_distinct(ident).alias("ids"))
    every = rows.agg(F.count_distinct(ident).alias("every"))
    return per.crossJoin(F.broadcast(every)).select(level, "n", "ids", (F.col("every") - F.col("ids")).alias("lacking"))
