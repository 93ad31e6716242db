"""What a viewer asks: filters, metric cards, histograms, lists, options, bounds, point history, asset choice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """A viewer's selection over records(source, entity, year, province, cause, municipality, area, is_gif)."""

    sources: list[str] = field(default_factory=list)
    years: tuple[int, int] | None = None
    provinces: list[str] = field(default_factory=list)
    min_area: float = 0.0
    cause: str | None = None
    municipality: str | None = None
    only_gif: bool = False

    def not_temporal(self) -> Column:
        out = F.coalesce("area", F.lit(0)) >= self.min_area
        for name, some in (("source", self.sources), ("province", self.provinces)):
            out = out & F.col(name).isin(some) if some else out
        for name, one in (("cause", self.cause), ("municipality", self.municipality)):
            out = out & (F.col(name) == one) if one is not None else out
        return out & F.col("is_gif") if self.only_gif else out

    def all(self) -> Column:
        return self.not_temporal() & F.col("year").between(*self.years) if self.years else self.not_temporal()


def municipality_key(ident: Column, province: Column, slug: Column) -> Column:
    return F.coalesce(ident, F.concat(F.lit("raw:"), province, F.lit(":"), slug))


def metric_cards(records: DataFrame, filters: Filters) -> DataFrame:
    """Per source: perimeters (rows), entities, their area (once each) and large fires."""
    seen = records.where(filters.all())
    once = seen.groupBy("source", "entity").agg(F.count("*").alias("n"), F.max(F.coalesce("area", F.lit(0.0))).alias("area"), F.bool_or("is_gif").alias("gif"))
    return once.groupBy("source").agg(F.sum("n").alias("perimeters"), F.count("*").alias("entities"), F.round(F.sum("area"), 2).alias("area"), F.count_if("gif").alias("large"))


def year_histogram(records: DataFrame, filters: Filters, first: int, last: int, sources: list[str]) -> DataFrame:
    """year and a column of distinct entities per source, zero-filled; the years themselves are not filtered."""
    counts = records.where(filters.not_temporal()).groupBy("year").pivot("source", sources).agg(F.count_distinct("entity"))
    axis = records.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return axis.join(counts, "year", "left").select("year", *(F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("long").alias(s) for s in sources))


def bar_shares(counts: DataFrame) -> DataFrame:
    """counts(year, source, n) with share of its year's bar and percentage of the highest bar."""
    total = F.sum("n").over(Window.partitionBy("year"))
    out = counts.withColumn("total", total)
    top = out.agg(F.max("total").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("year", "source", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(100 * F.col("total") / F.col("top"), 6).alias("height"))


def top_entities(records: DataFrame, filters: Filters, limit: int = 60) -> DataFrame:
    """The largest distinct entities: a top-k report."""
    once = records.where(filters.all()).groupBy("source", "entity").agg(F.max(F.coalesce("area", F.lit(0.0))).alias("area"))
    return once.orderBy(F.col("area").desc(), "source", "entity").limit(limit)


def options(records: DataFrame, ident: str, label: str, order: str) -> DataFrame:
    """ident and its last label."""
    return records.groupBy(ident).agg(F.max_by(label, order).alias(label))


def bounds_rollup(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Bounds and counts of x, y by each prefix of levels."""
    return rows.rollup(*levels).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def expected_against_observed(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected, observed over the whole expected grid; missing observed is 0; only where they differ."""
    out = expected.join(observed, keys, "left").select(*keys, "expected", F.coalesce("observed", F.lit(0)).alias("observed"))
    return out.where("expected <> observed")


def assets_for(assets: DataFrame, level: str, provinces: list[str], first: int, last: int) -> DataFrame:
    """Assets of a level whose block of years overlaps."""
    return assets.where((F.col("level") == level) & F.col("province").isin(provinces) & (F.col("block_end") >= first) & (F.col("block_start") <= last))
