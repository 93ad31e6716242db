"""Historical administrative reports: one flat record per report, its metrics, anomalies and contrasts with published totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: A large fire's forest area, and the area above which a report is doubted, in hectares.
LARGE, DOUBTFUL = 500, 100000
#: The totals that the 1992 publication prints: province, reports, wooded, non-wooded and forest hectares.
PUBLISHED_1992 = [("Alicante", 201, 981.4, 3298.5, 4279.9), ("Castellon", 214, 4542.5, 2689.8, 7232.3), ("Valencia", 354, 8816.0, 5860.3, 14676.3)]


def decimal_of(c: Column) -> Column:
    """A number with a comma or a point, exact to four places."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("decimal(18,4)")


def normalised(rows: DataFrame, municipalities: DataFrame, causes: DataFrame) -> DataFrame:
    """One record per report; every input but province_code, coordinates and affected is text as the source has it.

    rows(number, database_id, year, province, province_code, municipality_code, cause_code, wooded, nonwooded, agricultural,
    other, detection, extinction, place, sheet, grid, coordinates array, affected); municipalities(codine, municipality) and
    causes(cause_code, cause) are dictionaries of fixed size. Blank texts count as missing, throughout.
    """
    t = {c: S.text_of(F.col(c)) for c in ("number", "database_id", "cause_code", "detection", "extinction", "place", "sheet", "grid")}
    year = F.coalesce(S.int_of(F.col("year")), S.year_prefix(t["number"]))
    code = S.int_of(F.col("municipality_code"))
    codine = F.when(code > 0, F.concat("province_code", F.lpad(code.cast("string"), 3, "0")))
    wooded, nonwooded, agricultural, other = (decimal_of(F.col(c)) for c in ("wooded", "nonwooded", "agricultural", "other"))
    flat = rows.select(
        t["number"].alias("source_record_id"), t["database_id"].alias("source_database_id"), year.alias("year"), "province", "province_code",
        code.alias("municipality_source_code"), codine.alias("codine"), t["cause_code"].alias("cause_code"), wooded.alias("wooded"), nonwooded.alias("nonwooded"),
        S.forest_area(wooded, nonwooded).alias("forest"), agricultural.alias("agricultural"), other.alias("other"), t["detection"].alias("detection"),
        t["extinction"].alias("extinction"), t["place"].alias("place"), t["sheet"].alias("sheet"), t["grid"].alias("grid"),
        F.filter(F.coalesce("coordinates", F.array().cast("array<string>")), lambda x: ~S.is_missing(x)).alias("coordinates"), S.int_of(F.col("affected")).alias("affected"),
    )
    out = flat.join(municipalities, "codine", "left").join(causes.where("cause_code <> '0'"), "cause_code", "left")
    parts = F.array_compact(F.array("forest", "agricultural", "other"))
    total = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast("decimal(20,4)"), lambda s, x: (s + x).cast("decimal(20,4)")))
    has = {"coordinates": F.size("coordinates") > 0, "sheet": F.col("sheet").isNotNull() | F.col("grid").isNotNull(), "municipality": F.col("municipality").isNotNull(), "place": F.col("place").isNotNull()}
    anything = has["coordinates"] | has["sheet"] | has["municipality"] | has["place"] | (F.coalesce("municipality_source_code", F.lit(0)) != 0)
    number = lambda c: c.cast("double")
    return out.select(
        "source_record_id", "source_database_id", F.lit("unresolved").alias("episode_identity_status"), "year", "province", "province_code", "municipality", "municipality_source_code",
        F.col("codine").alias("municipality_codine"), F.col("place").alias("paraje"), "detection", "extinction", number(total).alias("total_area"), number(F.col("forest")).alias("forest_area"),
        number(F.col("wooded")).alias("wooded_area"), number(F.col("nonwooded")).alias("nonwooded_area"), number(F.col("agricultural")).alias("agricultural_area"), number(F.col("other")).alias("other_area"),
        "cause", "cause_code", F.when(S.cause_status(F.col("cause_code")) == "unknown", "unknown").otherwise("reported").alias("cause_status"),
        F.coalesce(F.col("forest") >= LARGE, F.lit(False)).alias("is_large"), F.when(has["coordinates"], "raw_unvalidated").otherwise("absent").alias("coordinate_status"),
        S.location_quality(*has.values()).alias("location_quality"), anything.alias("has_spatial_information"), has["sheet"].alias("has_sheet_or_grid"), "affected",
        S.form_model(F.col("year")).alias("form_model"), S.coverage_regime(F.col("year")).alias("coverage_status"), F.lit("none").alias("geometry_availability"),
    )


#: The metrics of a set of records, each a flag that is counted.
METRICS: dict[str, Column | str] = {
    "large": "is_large", "with_municipality": "municipality is not null", "with_paraje": "paraje is not null", "with_surface": "forest_area is not null",
    "with_cause": "cause_code is not null", "with_known_cause": "cause_status = 'reported'", "with_spatial": "has_spatial_information", "with_sheet_or_grid": "has_sheet_or_grid",
    "with_coordinates": "coordinate_status = 'raw_unvalidated'", "with_transformable": "false", "without_location": "not has_spatial_information",
}


def metrics(records: DataFrame, keys: list[str]) -> DataFrame:
    """records and the eleven flags counted by keys and in all (total is true there), in one pass."""
    out = records.groupingSets([[F.col(k) for k in keys], []], *keys)
    return out.agg(F.count("*").alias("records"), *(F.count_if(F.expr(c)).alias(k) for k, c in METRICS.items()), (F.grouping(keys[0]) == 1).alias("total"))


def _time(c: Column) -> Column:
    return F.when(c.rlike(S.ISO_TIME), F.try_to_timestamp(F.replace(c, F.lit("Z"), F.lit("+00:00"))))


def anomaly_rules() -> dict[str, Column]:
    """The rules by which a record is put up for review. source_province is the province that the report itself names."""
    found, out, area = F.col("detection"), F.col("extinction"), F.col("forest_area")
    number = F.col("source_record_id")
    ten = number.rlike(r"^\d{10}$")
    return {
        "invalid_detection_date": found.isNotNull() & _time(found).isNull(),
        "invalid_extinction_date": out.isNotNull() & _time(out).isNull(),
        "extinction_before_detection": _time(out) < _time(found),
        "detection_year_mismatch": _time(found).isNotNull() & ~F.col("year").eqNullSafe(F.year(_time(found))),
        "source_report_id_year_or_province_mismatch": ten & (~F.substring(number, 1, 4).eqNullSafe(F.col("year").cast("string")) | (F.substring(number, 5, 2) != F.col("province_code"))),
        "source_province_mismatch": ~F.col("source_province").eqNullSafe(F.col("province_code").cast("int")),
        "unresolved_municipality_code": (F.coalesce("municipality_source_code", F.lit(0)) != 0) & F.col("municipality").isNull(),
        "negative_surface": area < 0, "zero_surface": area == 0, "surface_over_100000_ha": area > DOUBTFUL,
        "source_export_repeated_scalar": F.col("repeated_scalars") > 0,
    }


def publication_contrast(records: DataFrame, year: int, published: list[tuple] = PUBLISHED_1992) -> DataFrame:
    """province, records, wooded, nonwooded, forest of that year, and how much more than was published."""
    marks = ", ".join(f"('{p}', {n}, {a}D, {b}D, {c}D)" for p, n, a, b, c in published)
    told = records.sparkSession.sql(f"SELECT * FROM VALUES {marks} AS t(province, p_records, p_wooded, p_nonwooded, p_forest)")
    sums = records.where(F.col("year") == year).groupBy("province").agg(F.count("*").alias("records"), *(F.sum(F.coalesce(f"{c}_area", F.lit(0.0))).alias(c) for c in ("wooded", "nonwooded", "forest")))
    out = told.join(sums, "province", "left")
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 1)
    n = F.coalesce("records", F.lit(0))
    return out.select(
        "province", n.alias("records"), (n - F.col("p_records")).alias("more_records"), *(value(c).alias(c) for c in ("wooded", "nonwooded", "forest")),
        *(F.round(value(c) - F.col(f"p_{c}"), 1).alias(f"more_{c}") for c in ("wooded", "nonwooded", "forest")),
    )


def zero_filled_years(records: DataFrame, first: int, last: int) -> DataFrame:
    """year, n for every year of the period."""
    axis = records.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return axis.join(records.groupBy("year").agg(F.count("*").alias("n")), "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))
