"""Identity: identifier profiles, bijection, grouping of features into entities, ordinals, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, namespaced_id


def identifier_profile(rows: DataFrame, column: str) -> DataFrame:
    """One row: rows, missing, distinct values, values held by several rows, and rows too many."""
    counts = rows.groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    there = ~is_missing(F.col("v"))
    n = lambda value, cond: F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")
    return counts.agg(
        n(F.col("n"), F.lit(True)).alias("n_rows"), n(F.col("n"), ~there).alias("missing"), n(F.lit(1), there).alias("distinct_values"),
        n(F.lit(1), there & (F.col("n") > 1)).alias("duplicated_values"), n(F.col("n") - 1, there).alias("duplicate_excess"),
    )


def cross_year_repeats(rows: DataFrame, column: str, year: Column) -> DataFrame:
    """Values in two years or more: value, n_years, n_rows, first_year, last_year."""
    per = rows.where(~is_missing(F.col(column).cast("string"))).groupBy(F.col(column).alias("value"), year.alias("year")).agg(F.count("*").alias("n"))
    out = per.groupBy("value").agg(F.count("*").alias("n_years"), F.sum("n").alias("n_rows"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return out.where("n_years >= 2")


def bijection_breaks(rows: DataFrame, a: str, b: str) -> DataFrame:
    """side, value, partners: values of one identifier that meet several of the other; rows without either are left out."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
    one = lambda x, y: pairs.groupBy(F.lit(x).alias("side"), F.col(x).alias("value")).agg(F.count(y).alias("partners")).where("partners > 1")
    return one("a", "b").unionByName(one("b", "a"))


def differs(c: Column) -> Column:
    """Aggregate: whether a group holds several values, where null is one. Minima and maxima combine before the shuffle."""
    return (F.min(c) < F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))


#: Why a group of features is no single entity, and by which rule a feature got its entity.
NOT_ONE_TO_ONE, MANY_YEARS, EVENTS_DIFFER = "identifiers are not one-to-one", "several source years", "event attributes differ"
RULES = ("several_consistent_features", "one_to_one_identifiers", "fallback_ambiguous", "fallback_missing_identifier")


def grouping_decisions(rows: DataFrame, key: str, partner: str, year: str, fields: list[str]) -> DataFrame:
    """key, members, accepted, reasons, differing: a group is one entity if its identifiers pair one to one, it lies in one
    year and no event field differs (null is a value). Rows without key belong to no group.
    """
    blank = is_missing(F.col(partner).cast("string"))
    there = rows.where(~is_missing(F.col(key).cast("string")))
    other = F.when(~blank, F.col(partner))
    partners = there.where(~blank).groupBy(F.col(partner).alias("p")).agg((F.min(key) < F.max(key)).alias("shared"))
    groups = there.groupBy(key).agg(
        F.count("*").alias("members"), F.min(other).alias("p"), (F.min(other) < F.max(other)).alias("several"), differs(F.col(year)).alias("years"),
        *(differs(F.col(f)).alias(f"d_{f}") for f in fields),
    )
    out = groups.join(partners, "p", "left")
    one = F.col("p").isNotNull() & ~F.col("several") & ~F.col("shared")
    changed = F.array_compact(F.array(*(F.when(F.col(f"d_{f}"), F.lit(f)) for f in sorted(fields))))
    whys = F.array_compact(F.array(F.when(~F.coalesce(one, F.lit(False)), NOT_ONE_TO_ONE), F.when(F.col("years"), MANY_YEARS), F.when(F.size(changed) > 0, EVENTS_DIFFER)))
    return out.select(key, "members", (F.size(whys) == 0).alias("accepted"), whys.alias("reasons"), changed.alias("differing"))


def assignments(rows: DataFrame, decisions: DataFrame, key: str, locator: list[str]) -> DataFrame:
    """rows with fire_id, linkage_rule and ambiguous: of its group if that was accepted, else of its own by its locator.

    The left join keeps rows without key, which have no group; every locator gets exactly one entity.
    """
    own = F.concat_ws(":", F.lit("gva:source-feature"), *(F.col(c).cast("string") for c in locator))
    out = rows.join(decisions.select(key, "members", "accepted"), key, "left")
    good = F.coalesce("accepted", F.lit(False))
    rule = F.when(good & (F.col("members") > 1), RULES[0]).when(good, RULES[1]).when(F.col("accepted").isNotNull(), RULES[2]).otherwise(RULES[3])
    fire = F.when(good, namespaced_id("gva:fire:", F.col(key).cast("string"))).otherwise(own)
    return out.select(*rows.columns, fire.alias("fire_id"), rule.alias("linkage_rule"), (~good).alias("ambiguous"))


def discrepancies(decisions: DataFrame, key: str, kinds: dict[str, list[str]]) -> DataFrame:
    """kind, key: groups of several rows in which a field of that kind differs."""
    wide = decisions.where("members > 1")
    told = F.array_compact(F.array(*(F.when(F.arrays_overlap("differing", F.array(*(F.lit(f) for f in fields))), F.lit(kind)) for kind, fields in kinds.items())))
    return wide.select(F.explode(told).alias("kind"), key)


def joined_once(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The 1:1 join on keys, and its violations: problem, keys, n (repeated on a side, or without partner)."""
    again = lambda rows, side: rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"repeated {side}").alias("problem"), *keys, "n")
    alone = lambda a, b, side: a.join(b.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("n")).select(F.lit(f"only {side}").alias("problem"), *keys, "n")
    bad = again(left, "left").unionByName(again(right, "right")).unionByName(alone(left, right, "left")).unionByName(alone(right, left, "right"))
    return left.join(right, keys), bad


def occurrence_ordinals(rows: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Adds row_hash of the columns same, and ordinal: the place among equal rows in source order."""
    hashed = rows.withColumn("row_hash", F.substring(F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in same)), {"ignoreNullFields": "false"}), 256), 1, 20))
    return hashed.withColumn("ordinal", F.row_number().over(Window.partitionBy("row_hash").orderBy(*order)).cast("long"))


def representative(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def report_identity(rows: DataFrame, number: str, province: str, year: str, database: str, index: str) -> DataFrame:
    """Adds fire_id and identity_status: the report number where it has ten digits, begins with its year and province and has
    no second holder; else a digest of province, number, database id and the row's place in the source, which never collide.

    Repeated numbers are counted first and joined, so that the many rows without one are nobody's window.
    """
    c = F.col(number)
    repeated = rows.where(c.isNotNull()).groupBy(c.alias("__number")).agg(F.count("*").alias("__n")).where("__n > 1")
    out = rows.join(repeated, c == F.col("__number"), "left")
    fits = c.rlike(r"^\d{10}$") & (F.substring(c, 1, 4).try_cast("int") == F.col(year)) & (F.substring(c, 5, 2) == F.col(province))
    good = F.coalesce(fits, F.lit(False)) & F.col("__n").isNull()
    basis = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("None")) for x in (province, number, database, index))), 256)
    # fixed values: the name space and the names of the two cases
    fire = F.concat(F.lit("egif-record:"), F.when(good, c).otherwise(F.substring(basis, 1, 20)))
    return out.select(*rows.columns, fire.alias("fire_id"), F.when(good, "source_record_only").otherwise("ambiguous").alias("identity_status"))
