"""Vocabularies: resolving labels against a gazetteer in steps, and auditing what stays unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import alias, alias_parts, bilingual_signature, is_missing

#: How a label was resolved.
METHODS = ("official_alias", "official_bilingual_alias", "globally_unique_official_alias", "source_identifier_and_official_alias", "validated_source_identifier", "documented_historical_alias", "exact_official_bilingual_component")


def alias_table(names: DataFrame) -> DataFrame:
    """id, province, alias from names(id, province, name): the name and each of its parts around a slash."""
    parts = F.array_distinct(F.concat(F.array(alias(F.col("name"))), alias_parts(F.col("name"))))
    return names.select("id", F.coalesce("province", F.lit("")).alias("province"), F.explode(parts).alias("alias")).where("alias <> ''").distinct()


def _by(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias(name))


def resolve(raw: DataFrame, names: DataFrame, documented: DataFrame | None = None) -> DataFrame:
    """raw(raw, province, source_id) with id, method, status and candidates, from names(id, province, name).

    The first that finds a candidate decides: 1. alias within the province; 2. bilingual signature; 3. alias anywhere, if the
    province is unknown; 4. a known source id (of that province, if it is known); 5. documented(province, alias, id); 6. one
    part alone. A source id also picks among candidates of 1 to 3. Several candidates are ambiguous and go no further. The
    candidates of a label are as many as places share its name, so the lists are short.
    """
    aliases = alias_table(names)
    ids = names.select(F.col("id").alias("source_id"), F.coalesce("province", F.lit("")).alias("source_province")).distinct()
    signed = names.select(F.coalesce("province", F.lit("")).alias("p"), bilingual_signature(F.col("name")).alias("signature"), "id").where("signature is not null")
    rows = raw.withColumns({"alias": alias(F.col("raw")), "signature": bilingual_signature(F.col("raw")), "p": F.coalesce("province", F.lit(""))})
    parts = raw.select("raw", F.coalesce("province", F.lit("")).alias("province"), F.explode(F.array_distinct(alias_parts(F.col("raw")))).alias("alias")).distinct()
    by_part = _by(parts.join(aliases, ["province", "alias"]), ["raw", "province"], "by_part").withColumnRenamed("province", "p")
    out = rows.join(_by(aliases, ["province", "alias"], "by_alias").withColumnRenamed("province", "p"), ["p", "alias"], "left")
    out = out.join(_by(signed, ["p", "signature"], "by_signature"), ["p", "signature"], "left").join(_by(aliases, ["alias"], "by_any"), "alias", "left")
    out = out.join(by_part, ["raw", "p"], "left").join(ids, "source_id", "left")
    if documented is None:
        out = out.withColumn("by_document", F.lit(None).cast("string"))
    else:
        told = documented.select(F.coalesce("province", F.lit("")).alias("p"), alias(F.col("alias")).alias("alias"), F.col("id").alias("by_document"))
        out = out.join(told, ["p", "alias"], "left")
    unknown = F.col("province").isNull()
    found = F.coalesce("by_alias", "by_signature", F.when(unknown, F.col("by_any")))
    how = F.when(F.col("by_alias").isNotNull(), METHODS[0]).when(F.col("by_signature").isNotNull(), METHODS[1]).otherwise(METHODS[2])
    picked = F.array_contains(found, F.col("source_id"))
    own = F.col("source_province").isNotNull() & (unknown | (F.col("source_province") == F.col("p")))
    steps = [
        (picked, F.array("source_id"), F.lit(METHODS[3])), (found.isNotNull(), found, how), (own, F.array("source_id"), F.lit(METHODS[4])),
        (F.col("by_document").isNotNull(), F.array("by_document"), F.lit(METHODS[5])), (F.size("by_part") == 1, F.col("by_part"), F.lit(METHODS[6])),
    ]
    blank = is_missing(F.col("raw"))
    candidates, method = F.when(blank, F.array().cast("array<string>")), F.when(blank, None)
    for cond, value, name in steps:
        candidates, method = candidates.when(cond, value), method.when(cond, name)
    out = out.select(*raw.columns, candidates.otherwise(F.array().cast("array<string>")).alias("candidates"), method.alias("method"))
    n = F.size("candidates")
    status = F.when(is_missing(F.col("raw")), "missing").when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    one = F.when(n == 1, F.get("candidates", F.lit(0)))
    return out.select(*raw.columns, one.alias("id"), F.when(n == 1, F.col("method")).alias("method"), status.alias("status"), F.array_join("candidates", ",").alias("candidates"))


def candidate_details(raw: DataFrame, names: DataFrame, documented: DataFrame) -> DataFrame:
    """raw, province, id, methods: every candidate of a label with all the ways that lead to it, for review."""
    p = F.coalesce("province", F.lit("")).alias("province")
    labels = raw.select("raw", p, "source_id").distinct()
    parts = labels.select("raw", "province", F.explode(F.array_distinct(alias_parts(F.col("raw")))).alias("alias"))
    by_part = parts.join(alias_table(names), ["province", "alias"]).select("raw", "province", "id", F.lit("exact_official_component").alias("method"))
    told = documented.select(p, alias(F.col("alias")).alias("alias"), "id")
    by_document = labels.withColumn("alias", alias(F.col("raw"))).join(told, ["province", "alias"]).select("raw", "province", "id", F.lit(METHODS[5]).alias("method"))
    known = names.select(F.col("id").alias("source_id"), F.coalesce("province", F.lit("")).alias("own")).distinct()
    by_source = labels.join(known, "source_id").where("province = '' or province = own").select("raw", "province", F.col("source_id").alias("id"), F.lit(METHODS[4]).alias("method"))
    rows = by_part.unionByName(by_document).unionByName(by_source)
    return rows.groupBy("raw", "province", "id").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


def unresolved_audit(resolved: DataFrame) -> DataFrame:
    """raw, records, provinces, advice for labels without an id."""
    left = resolved.where("id is null")
    out = left.groupBy("raw").agg(F.count("*").alias("records"), F.count_distinct("province").alias("provinces"))
    return out.withColumn("advice", F.when(is_missing(F.col("raw")), "ignore").when(F.col("records") >= 10, "review_first").otherwise("review"))


def vocabulary_summary(resolved: DataFrame) -> DataFrame:
    """By province and in all (province null, total true): distinct labels, resolved and unresolved records."""
    return resolved.groupingSets([["province"], []], "province").agg(
        F.count_distinct("raw").alias("labels"), F.count("id").alias("resolved"), F.count_if(F.col("id").isNull()).alias("unresolved"), (F.grouping("province") == 1).alias("total")
    )
