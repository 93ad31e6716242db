"""Validation: rules that give errors and warnings, checksums, completeness of partitions, bounded examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(rows: DataFrame, errors: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """rows with the names of the errors and warnings whose condition holds, and whether the row may go on."""
    names = lambda rules: F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    out = rows.withColumns({"errors": names(errors), "warnings": names(warnings)})
    return out.withColumn("accepted", F.size("errors") == 0)


def checksum_breaks(rows: DataFrame, ident: str, content: Column, stored: str) -> DataFrame:
    """ident, stored, found where a stored digest is not that of the content."""
    out = rows.select(ident, F.col(stored).alias("stored"), F.sha2(content, 256).alias("found"))
    return out.where(~F.col("stored").eqNullSafe(F.col("found")))


def missing_partitions(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys of expected that no row has."""
    return expected.join(rows.select(*keys).distinct(), keys, "left_anti")


def forbidden(columns: list[str], names: list[str]) -> list[str]:
    return [c for c in columns if c in names]


def leaks(rows: DataFrame, ident: str, texts: list[str], pattern: str) -> DataFrame:
    """ident, column of texts that match what must not be published."""
    found = F.array_compact(F.array(*(F.when(F.col(c).rlike(pattern), F.lit(c)) for c in texts)))
    return rows.select(ident, F.explode(found).alias("column"))


def first_examples(rows: DataFrame, keys: list[str], value: str, order: str, most: int = 3) -> DataFrame:
    """keys, examples: the first distinct values in source order, at most ``most`` (a report: the limit is the feature).

    Distinct values with their first place are aggregated, then the least few are kept by a bounded aggregation.
    """
    places = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("at"))
    ranked = places.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("n") <= most)
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))), lambda x: x["v"].cast("string")), ",").alias("examples"))


def repetitions(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, least, middle, upper_middle, most, mean of a few repeated measurements; upper_middle is the later of two middles."""
    out = rows.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = lambda i: F.get("v", i.cast("int"))
    n = F.size("v")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / n
    return out.select(by, at(F.lit(0)).alias("least"), F.round(middle, 6).alias("middle"), at(F.floor(n / 2)).alias("upper_middle"), at(n - 1).alias("most"), F.round(mean, 6).alias("mean"))


def ordered_distinct(values: Column) -> Column:
    """Each value once, where it first stands."""
    return F.array_distinct(values)


def superset(values: Column, needed: list[str]) -> Column:
    """Whether an array holds all that is needed."""
    return F.size(F.array_except(F.array(*(F.lit(x) for x in needed)), values)) == 0
