"""Publication profiles: which sources, assets and coverage rows a view may show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of coverage rows that go with the administrative source, beside those that begin with its name.
SHARED_COVERAGE = ("coverage_start_requested", "coverage_end_requested", "coverage_complete", "warnings")


def coverage_columns(columns: list[str], requested: list[str]) -> list[str]:
    """The columns of a coverage table that the requested sources may show; all with both recent sources."""
    if {"sigif", "effis"} <= set(requested):
        return columns
    keep = [c for c in columns if c in ("year", "acquired_at")]
    for source in ("sigif", "effis"):
        if source in requested:
            keep += [c for c in columns if c.startswith(f"{source}_") or (source == "sigif" and c in SHARED_COVERAGE)]
    return keep


def blocked(catalog: DataFrame, requested: list[str], profile: str) -> DataFrame:
    """source, problem: requested sources that the public profile may not show, or that the catalogue lacks."""
    wanted = catalog.sparkSession.sql("SELECT explode(:names) AS source", args={"names": requested}) if requested else catalog.select("source").limit(0)
    both = wanted.join(catalog, "source", "left")
    bad = F.when(F.col("publishable").isNull(), "unknown source").when(~F.col("publishable") & F.lit(profile == "public"), "not publishable")
    return both.select("source", bad.alias("problem")).where("problem is not null")


def assets_of(assets: DataFrame, requested: list[str]) -> DataFrame:
    """Assets of the requested sources by the beginning of their kind; links need both recent sources."""
    rules = {"sigif": "sigif" in requested, "effis": "effis" in requested, "link_candidates": {"sigif", "effis"} <= set(requested)}
    dropped = [kind for kind, shown in rules.items() if not shown]
    out = assets
    for kind in dropped:
        out = out.where(~F.col("kind").startswith(kind))
    return out


def composition(catalog: DataFrame, requested: list[str], default_year: int) -> DataFrame:
    """One row: the span of years of the requested sources and the year to begin with."""
    active = catalog.where(F.col("source").isin(requested))
    out = active.agg(F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return out.withColumn("default_year", F.least(F.lit(default_year), F.col("year_max")))


def covering(coverage: DataFrame, first: int, last: int) -> DataFrame:
    return coverage.where(F.col("year").between(first, last))


def late_satellite(day: Column, source: Column, cutoff: str) -> Column:
    """Whether a satellite record is later than the administrative source reaches."""
    return (source == "effis") & (day > F.lit(cutoff).cast("date"))


def record_view(icv: DataFrame, sigif: DataFrame, effis: DataFrame) -> DataFrame:
    """One typed view of three sources: names by the first of the written, raw and old forms; areas without a value are 0."""
    first = lambda *cs: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cs))
    area = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias("area")
    place, cause = first("municipality_name", "municipality_raw", "municipality").alias("municipality"), first("cause_label", "cause_raw", "cause").alias("cause")
    a = icv.select(F.lit("icv").alias("source"), "entity", "geometry", "year", place, F.col("province"), "place_name", cause, F.col("start_date").alias("day"), "end_date", area("forest_area"))
    a = a.withColumn("is_gif", F.col("area") >= 500)
    b = sigif.select(F.lit("sigif").alias("source"), "entity", F.col("entity").alias("geometry"), "year", place, "province", "place_name", cause, "day", F.lit(None).cast("date").alias("end_date"), area("reported_area"), (F.coalesce("reported_area", F.lit(0.0)) >= 500).alias("is_gif"))
    text = F.lit(None).cast("string")
    c = effis.select(F.lit("effis").alias("source"), F.col("geometry").alias("entity"), "geometry", "year", place, "province", text.alias("place_name"), first("cause_label", "cause_raw").alias("cause"), "day", F.col("final_date").alias("end_date"), area("mapped_area"), F.lit(False).alias("is_gif"))
    return a.unionByName(b).unionByName(c)
