"""Duplicate groups: equal content, comparison of attributes, classes, time patterns, summaries, bounded selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import differs


def equal_groups(rows: DataFrame, content: Column, ident: str) -> DataFrame:
    """group_id, members, identifiers, first and last of each content that several rows share. Digests travel, not contents."""
    keyed = rows.select(F.sha2(content, 256).alias("digest"), F.col(ident).alias("ident"))
    out = keyed.groupBy("digest").agg(F.count("*").alias("members"), F.count_distinct("ident").alias("identifiers"), F.min("ident").alias("first_id"), F.max("ident").alias("last_id"))
    return out.where("members > 1").select(F.substring("digest", 1, 16).alias("group_id"), "members", "identifiers", "first_id", "last_id")


def classified(rows: DataFrame, digest: str, ids: list[str], year: str) -> DataFrame:
    """digest, members, category: A one identity, B one year, C several years; null identities count as values."""
    out = rows.groupBy(digest).agg(F.count("*").alias("members"), F.count_distinct(F.struct(*ids)).alias("n_ids"), F.count_distinct(F.struct(year)).alias("n_years"))
    category = F.when(F.col("n_ids") == 1, "A").when(F.col("n_years") == 1, "B").otherwise("C")
    return out.where("members > 1").select(digest, "members", category.alias("category"))


def year_gaps(rows: DataFrame, key: str, year: Column) -> DataFrame:
    """key, year, gap: the distance from the year before, per distinct year."""
    years = rows.select(F.col(key), year.alias("year")).distinct()
    return years.withColumn("gap", F.col("year") - F.lag("year").over(Window.partitionBy(key).orderBy("year")))


def time_pattern(rows: DataFrame, key: str, year: Column) -> DataFrame:
    """key, n_years, span, consecutive."""
    out = rows.groupBy(key).agg(F.array_sort(F.collect_set(year)).alias("ys"))
    span = F.element_at("ys", -1) - F.get("ys", F.lit(0))
    return out.select(key, F.size("ys").alias("n_years"), span.alias("span"), (span == F.size("ys") - 1).alias("consecutive"))


def tri_state(year: Column, detection: Column, extinction: Column, prefix: Column) -> dict[str, Column]:
    """Checks of a row's dates: true, false, or null where a side is missing."""
    return {
        "detection_in_year": F.year(detection) == year, "prefix_is_detection_year": prefix == F.year(detection), "prefix_is_year": prefix == year,
        "extinct_before_detected": extinction < detection,
    }


#: What the audit says of a group's republication.
REPUBLISHED = ("not_applicable_single_year", "attribute_candidate_not_confirmed", "not_supported_by_record_attributes")


def group_report(rows: DataFrame, digest: str, ids: list[str], year: str, detection: str, checks: list[str], fields: list[str], exact: str, raw: str) -> DataFrame:
    """One row per content that several rows share: members, identities, years, category, patterns, differing fields, flags.

    ids: the identity; fields: substantial attributes (detection among them); exact and raw: digests of all attributes and of
    the content as stored. checks: columns that tri_state gave. All is one aggregation of minima, maxima and short sets.
    """
    pair = F.struct(*ids)
    out = rows.groupBy(digest).agg(
        F.count("*").alias("members"), F.count_distinct(pair).alias("n_ids"), F.array_sort(F.collect_set(year)).alias("years"), F.count_distinct(detection).alias("n_detections"),
        *(differs(F.col(f)).alias(f"d_{f}") for f in fields), (~differs(F.col(exact))).alias("all_attributes_identical"), (F.min(raw) == F.max(raw)).alias("raw_identical"),
        *(F.bool_and(F.coalesce(F.col(c), F.lit(False))).alias(f"all_{c}") for c in checks),
    ).where("members > 1")
    changed = F.array_compact(F.array(*(F.when(F.col(f"d_{f}"), F.lit(f)) for f in fields)))
    out = out.withColumn("differing", changed).withColumn("n_years", F.size("years"))
    category = F.when(F.col("n_ids") == 1, "A").when(F.col("n_years") == 1, "B").when(F.col("n_years") > 1, "C").otherwise("E")
    same = F.size("differing") == 0
    patterns = F.array_compact(F.array(category, F.when(~same, "D"), F.when(F.col("raw_identical"), "E_RAW_IDENTICAL").otherwise("E_RING_REORDERED")))
    status = F.when(F.col("n_years") <= 1, REPUBLISHED[0]).when((F.col("n_detections") == 1) & same, REPUBLISHED[1]).otherwise(REPUBLISHED[2])
    span = F.element_at("years", -1) - F.get("years", F.lit(0))
    return out.select(
        F.substring(digest, 1, 16).alias("group_id"), "members", "n_ids", F.array_join("years", ",").alias("years"), span.alias("span"),
        ((F.col("n_years") > 1) & (span == F.col("n_years") - 1)).alias("consecutive"), category.alias("category"), F.array_join(patterns, ",").alias("patterns"),
        F.array_join("differing", ",").alias("differing"), same.alias("substantially_identical"), "all_attributes_identical", *(f"all_{c}" for c in checks), status.alias("republication"),
    )


def group_summary(groups: DataFrame, first: int, last: int) -> DataFrame:
    """kind, value, n: groups by category, pattern, differing field, span, and year (every year of the period)."""
    told = F.array(*(F.struct(F.lit(k).alias("kind"), F.split(F.col(c).cast("string"), ",").alias("v")) for k, c in (("category", "category"), ("pattern", "patterns"), ("field", "differing"), ("span", "span"), ("year", "years"))))
    counts = groups.select(F.explode(told).alias("t")).select("t.kind", F.explode(F.filter("t.v", lambda x: x != "")).alias("value")).groupBy("kind", "value").agg(F.count("*").alias("n"))
    axis = groups.sparkSession.range(first, last + 1).select(F.lit("year").alias("kind"), F.col("id").cast("string").alias("value"))
    return axis.join(counts.where("kind = 'year'"), ["kind", "value"], "left").na.fill(0, ["n"]).unionByName(counts.where("kind <> 'year'"))


def selections(groups: DataFrame, rules: list[tuple[str, Column, list[Column], int | None]], limit: int) -> DataFrame:
    """group_id, place, reasons: rules (reason, condition, order, most) one after the other, each group once, the first limit.

    A top-k report: its limits are the feature. No rule sorts more than it gives: the first ``limit`` groups need at most
    ``limit * (k + 1)`` of the k-th rule, which are top-k queries; reasons without a cap are conditions of the groups found.
    """
    parts = []
    for k, (_, cond, order, most) in enumerate(rules):
        top = groups.where(cond).orderBy(*order).limit(min(most or limit * (k + 1), limit * (k + 1)))
        place = F.row_number().over(Window.orderBy(*order))
        parts.append(top.withColumn("at", place).select("group_id", F.lit(k).alias("rule"), "at"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    first = found.groupBy("group_id").agg(F.min(F.struct("rule", "at")).alias("first"), F.collect_set("rule").alias("by")).orderBy("first").limit(limit)
    first = first.withColumn("place", F.row_number().over(Window.orderBy("first")))
    whys = F.array_compact(F.array(*(F.when(F.array_contains("by", F.lit(k)) if most else cond, F.lit(name)) for k, (name, cond, _, most) in enumerate(rules))))
    return groups.join(first, "group_id").select("group_id", "place", F.array_join(whys, ",").alias("reasons"))
