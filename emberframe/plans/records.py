"""Queries on records: identity, resolution, candidate links, duplicate reports, historical reports. Each beside its SQL.

What the tables lack is told by arithmetic on keys, the same in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import duplicates, historical, identity, linking, vocab
from .catalog import POINTS, points, query, read

# --- identity of features: cv and mn are their two identifiers, y the source year

_FEATURES = """r AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey END AS cv,
  CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey // 10 WHEN l_orderkey % 11 = 0 AND l_linenumber = 2 THEN NULL ELSE -l_orderkey END AS mn, CASE WHEN l_orderkey % 3 = 0 THEN year(l_shipdate) ELSE 1999 END::INT AS y,
  CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag ELSE 'N' END AS flag, CASE WHEN l_orderkey % 4 = 0 THEN nullif(l_linestatus, 'O') ELSE 'x' END AS status FROM lineitem),
p AS (SELECT mn, count(DISTINCT cv) AS n FROM r WHERE cv IS NOT NULL AND mn IS NOT NULL GROUP BY mn),
g AS (SELECT cv, count(*) AS members, count(DISTINCT mn) AS nm, min(mn) AS mn, count(DISTINCT y) AS ny, count(DISTINCT coalesce(flag, '?')) AS nf, count(DISTINCT coalesce(status, '?')) AS ns FROM r WHERE cv IS NOT NULL GROUP BY cv),
d AS (SELECT cv, members, nf > 1 AS f, ns > 1 AS s, array_to_string(list_filter([CASE WHEN nm <> 1 OR coalesce(p.n, 0) <> 1 THEN 'identifiers are not one-to-one' END, CASE WHEN ny > 1 THEN 'several source years' END,
  CASE WHEN nf > 1 OR ns > 1 THEN 'event attributes differ' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g LEFT JOIN p USING (mn))"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    partner = F.when(k % 5 == 0, F.floor(k / 10)).when((k % 11 == 0) & (F.col("l_linenumber") == 2), None).otherwise(-k)
    return read(spark, d, "lineitem").select(
        k.alias("k"), F.col("l_linenumber").alias("line"), F.when(k % 7 != 0, k).alias("cv"), partner.alias("mn"), F.when(k % 3 == 0, F.year("l_shipdate")).otherwise(1999).alias("y"),
        F.when(k % 2 == 0, F.col("l_returnflag")).otherwise("N").alias("flag"), F.when(k % 4 == 0, F.nullif("l_linestatus", F.lit("O"))).otherwise("x").alias("status"),
    )


def _decisions(rows: DataFrame) -> DataFrame:
    return identity.grouping_decisions(rows, "cv", "mn", "y", ["flag", "status"])


@query(f"""WITH {_FEATURES} SELECT cv, members, reasons = '' AS accepted, reasons, concat_ws(',', CASE WHEN f THEN 'flag' END, CASE WHEN s THEN 'status' END) AS differing FROM d""")
def identity_grouping(spark: SparkSession, d: str) -> DataFrame:
    out = _decisions(_features(spark, d))
    return out.withColumns({"reasons": F.array_join("reasons", ","), "differing": F.array_join("differing", ",")})


@query(f"""WITH {_FEATURES} SELECT k, line, CASE WHEN reasons = '' THEN 'gva:fire:' || cv ELSE 'gva:source-feature:' || y || ':' || k || ':' || line END AS fire_id, coalesce(reasons <> '', true) AS ambiguous,
 CASE WHEN reasons = '' AND members > 1 THEN 'several_consistent_features' WHEN reasons = '' THEN 'one_to_one_identifiers' WHEN reasons IS NOT NULL THEN 'fallback_ambiguous' ELSE 'fallback_missing_identifier' END AS linkage_rule
 FROM r LEFT JOIN d USING (cv)""")
def identity_assignments(spark: SparkSession, d: str) -> DataFrame:
    rows = _features(spark, d)
    return identity.assignments(rows, _decisions(rows), "cv", ["y", "k", "line"]).select("k", "line", "fire_id", "ambiguous", "linkage_rule")


@query(f"""WITH {_FEATURES} SELECT 'surface' AS kind, cv FROM d WHERE f AND members > 1 UNION ALL SELECT 'date', cv FROM d WHERE s AND members > 1""")
def identity_discrepancies(spark: SparkSession, d: str) -> DataFrame:
    return identity.discrepancies(_decisions(_features(spark, d)), "cv", {"surface": ["flag"], "date": ["status"]})


_SIDES = """a AS (SELECT o_orderkey AS k, o_orderkey % 7 AS s FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT l_orderkey AS k, l_orderkey % 7 AS s, l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 9 <> 0)"""


@query(f"""WITH {_SIDES} SELECT 'repeated left' AS problem, k, s, count(*) AS n FROM a GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'repeated right', k, s, count(*) FROM b GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'only left', k, s, count(*) FROM a ANTI JOIN b USING (k, s) GROUP BY ALL UNION ALL SELECT 'only right', k, s, count(*) FROM b ANTI JOIN a USING (k, s) GROUP BY ALL""")
def one_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("l_orderkey"), F.col("o_orderkey")
    a = read(spark, d, "orders").where(o % 10 != 0).select(o.alias("k"), (o % 7).alias("s"))
    b = read(spark, d, "lineitem").where((F.col("l_linenumber") == 1) & (k % 9 != 0)).select(k.alias("k"), (k % 7).alias("s"), "l_partkey")
    return identity.joined_once(a, b, ["k", "s"])[1]


_NUMBERS = """n AS (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate)::INT AS y, lpad((o_orderkey % 50)::VARCHAR, 2, '0') AS p,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 100 = 10 THEN year(o_orderdate) || '100007' WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey WHEN o_orderkey % 5 = 1 THEN (year(o_orderdate) + 1) || lpad((o_orderkey % 50)::VARCHAR, 2, '0') || lpad((o_orderkey % 10000)::VARCHAR, 4, '0')
 ELSE year(o_orderdate) || lpad((o_orderkey % 50)::VARCHAR, 2, '0') || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') END AS number FROM orders),
i AS (SELECT *, coalesce(regexp_full_match(number, '\\d{10}') AND number[1:4] = y::VARCHAR AND number[5:6] = p AND count(*) OVER (PARTITION BY number) = 1, false) AS good FROM n)"""


def _reports(spark: SparkSession, d: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    p = F.lpad((k % 50).cast("string"), 2, "0")
    tail = F.concat(p, F.lpad((k % 10000).cast("string"), 4, "0"))
    number = F.when(k % 17 == 0, None).when(k % 100 == 10, F.concat(y, F.lit("100007"))).when(k % 5 == 0, F.concat(F.lit("x"), k)).when(k % 5 == 1, F.concat(y + 1, tail)).otherwise(F.concat(y, tail))
    rows = read(spark, d, "orders").select(k.alias("k"), F.col("o_custkey").alias("c"), y.alias("y"), p.alias("p"), number.alias("number"))
    return identity.report_identity(rows, "number", "p", "y", "c", "k")


@query(f"""WITH {_NUMBERS} SELECT k, 'egif-record:' || CASE WHEN good THEN number ELSE substr(sha256(p || '|' || coalesce(number, 'None') || '|' || c || '|' || k), 1, 20) END AS fire_id, CASE WHEN good THEN 'source_record_only' ELSE 'ambiguous' END AS identity_status FROM i""")
def identity_reports(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("k", "fire_id", "identity_status")


@query(f"""WITH {_NUMBERS}, v AS (SELECT number, count(*) AS n FROM n WHERE number IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM v) AS report_ids, (SELECT count(*) FROM v WHERE n > 1) AS repeated_ids, count(*) FILTER (WHERE NOT good) AS ambiguous, count(*) FILTER (WHERE good) AS single FROM i""")
def identity_report_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = _reports(spark, d)
    per = rows.groupBy("number").agg(F.count("*").alias("n"), F.count_if(F.col("identity_status") == "ambiguous").alias("a"))
    there = F.col("number").isNotNull()
    return per.agg(F.count_if(there).alias("report_ids"), F.count_if(there & (F.col("n") > 1)).alias("repeated_ids"), F.sum("a").alias("ambiguous"), F.sum(F.col("n") - F.col("a")).alias("single"))


# --- municipalities: nations by region, in several written forms

_NAMES = """names AS (SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey % 9 = 8 THEN n_name || ' / X' || n_name ELSE n_name END AS name, r_name AS province FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 't1', 'Twin', 'ASIA' UNION ALL SELECT 't2', 'TWIN', 'ASIA' UNION ALL SELECT 's', 'Straße de l''Or', 'EUROPE')"""
_FORMS = [  # (what is done to the name, whether the province is known, source id, method, status)
    ("plain", True, None, "official_alias", "resolved"), ("plain", False, None, "globally_unique_official_alias", "resolved"), ("swapped", True, None, "exact_official_bilingual_component", "resolved"),
    ("other", True, None, None, "unresolved"), ("other", False, "own", "validated_source_identifier", "resolved"), ("other", True, "own", "validated_source_identifier", "resolved"),
    ("plain", True, "own", "source_identifier_and_official_alias", "resolved"), ("blank", True, "own", None, "missing"), ("documented", True, None, "documented_historical_alias", "resolved"),
    ("other", True, "foreign", None, "unresolved"),
]


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, n, r = F.col("n_nationkey"), F.col("n_name"), F.col("r_name")
    names = named.select(k.cast("string").alias("id"), r.alias("province"), F.when(k % 9 == 8, F.concat(n, F.lit(" / X"), n)).otherwise(n).alias("name"))
    names = names.union(spark.sql("SELECT * FROM VALUES ('t1', 'ASIA', 'Twin'), ('t2', 'ASIA', 'TWIN'), ('s', 'EUROPE', 'Straße de l\\'Or') AS t(id, province, name)"))
    written = {"plain": F.lower(n), "swapped": F.concat(F.lit("Y"), n, F.lit("/"), n), "other": F.concat(F.lit("NOWHERE "), n), "blank": F.lit(" "), "documented": F.concat(F.lit("Old "), n)}
    source = {None: F.lit(None).cast("string"), "own": k.cast("string"), "foreign": F.when(r == "ASIA", "s").otherwise("t1")}
    each = [F.struct(F.lit(i).alias("form"), written[w].alias("raw"), (r if known else F.lit(None)).alias("province"), source[s].alias("source_id")) for i, (w, known, s, _, _) in enumerate(_FORMS)]
    raw = named.select(k.alias("k"), F.explode(F.array(*each)).alias("x")).select("k", "x.*")
    more = "SELECT 100 AS k, 0 AS form, 'Twin' AS raw, 'ASIA' AS province, CAST(NULL AS STRING) AS source_id UNION ALL SELECT 101, 0, 'twin', 'ASIA', 't2' UNION ALL SELECT 102, 0, 'STRASSE DE L OR', 'EUROPE', NULL UNION ALL SELECT 103, 0, 'Straße  de l´or', 'EUROPE', NULL"
    documented = named.select(r.alias("province"), F.concat(F.lit("old "), F.lower(n)).alias("alias"), k.cast("string").alias("id"))
    return raw.union(spark.sql(more)), names, documented


_RESOLVED = "n AS (SELECT n_nationkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey), f(form, w, known, method, status) AS (VALUES " + ", ".join(
    f"({i}, '{w}', {known}, {'NULL' if m is None else repr(m)}, '{s}')" for i, (w, known, _, m, s) in enumerate(_FORMS)
) + """), res AS (SELECT k, form, CASE w WHEN 'plain' THEN lower(n) WHEN 'swapped' THEN 'Y' || n || '/' || n WHEN 'other' THEN 'NOWHERE ' || n WHEN 'blank' THEN ' ' ELSE 'Old ' || n END AS raw, CASE WHEN known THEN r END AS province, CASE WHEN status = 'resolved' THEN k::VARCHAR END AS id, method, status, CASE WHEN status = 'resolved' THEN k::VARCHAR ELSE '' END AS candidates FROM n, f
 UNION ALL SELECT 100, 0, 'Twin', 'ASIA', NULL, NULL, 'ambiguous', 't1,t2' UNION ALL SELECT 101, 0, 'twin', 'ASIA', 't2', 'source_identifier_and_official_alias', 'resolved', 't2' UNION ALL SELECT 102, 0, 'STRASSE DE L OR', 'EUROPE', 's', 'official_alias', 'resolved', 's'
 UNION ALL SELECT 103, 0, 'Straße  de l´or', 'EUROPE', 's', 'official_alias', 'resolved', 's')"""


@query(f"WITH {_RESOLVED} SELECT k, form, id, method, status, candidates FROM res")
def municipality_resolve(spark: SparkSession, d: str) -> DataFrame:
    return vocab.resolve(*_raw(spark, d)).select("k", "form", "id", "method", "status", "candidates")


@query(f"WITH {_RESOLVED} SELECT raw, count(*) AS records, count(DISTINCT province) AS provinces, CASE WHEN trim(raw) = '' THEN 'ignore' WHEN count(*) >= 10 THEN 'review_first' ELSE 'review' END AS advice FROM res WHERE id IS NULL GROUP BY raw")
def unresolved_audit(spark: SparkSession, d: str) -> DataFrame:
    return vocab.unresolved_audit(vocab.resolve(*_raw(spark, d)))


@query(f"WITH {_RESOLVED} SELECT province, count(DISTINCT raw) AS labels, count(id) AS resolved, count(*) FILTER (WHERE id IS NULL) AS unresolved, grouping(province) = 1 AS total FROM res GROUP BY GROUPING SETS ((province), ())")
def vocabulary_summary(spark: SparkSession, d: str) -> DataFrame:
    return vocab.vocabulary_summary(vocab.resolve(*_raw(spark, d)))


@query(f"""WITH {_RESOLVED}, m AS (SELECT raw, coalesce(province, '') AS province, unnest(CASE WHEN k >= 100 THEN CASE WHEN k < 102 THEN ['t1', 't2'] ELSE ['s'] END WHEN form IN (0, 2, 6) THEN [k::VARCHAR] ELSE [] END) AS id, 'exact_official_component' AS method FROM res
 UNION ALL SELECT raw, province, k::VARCHAR, 'documented_historical_alias' FROM res WHERE form = 8 UNION ALL SELECT raw, coalesce(province, ''), CASE k WHEN 101 THEN 't2' ELSE k::VARCHAR END, 'validated_source_identifier' FROM res WHERE form IN (4, 5, 6, 7) OR k = 101)
SELECT raw, province, id, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods FROM m GROUP BY ALL""")
def candidate_details(spark: SparkSession, d: str) -> DataFrame:
    raw, names, documented = _raw(spark, d)
    return vocab.candidate_details(raw, names, documented)


# --- candidate links: events as points, suppliers as square perimeters of 6 km, in a plane of 100 km

_LINKS = """l AS (SELECT event_id AS record_id, (event_id * 7919 % 1000) * 100.0 AS x, (event_id * 104729 % 1000) * 100.0 AS y, ts::DATE AS day, CASE WHEN event_id % 3 = 0 THEN 'Town ' || user_id % 5 END AS m, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Castelló de la P' || event_id % 2 END AS p, value AS a FROM events WHERE event_type = 'purchase'),
r AS (SELECT s_suppkey AS effis_id, (s_suppkey * 271 % 900) * 100.0 AS x0, (s_suppkey * 613 % 900) * 100.0 AS y0, DATE '2024-01-01' + (s_suppkey * 7 % 45)::INT AS eday, 'TOWN-' || s_suppkey % 5 AS c, CASE s_suppkey % 3 WHEN 0 THEN 'Castelló/Castellón' WHEN 1 THEN 'València p1' END AS ep, s_acctbal AS ea FROM supplier),
j AS (SELECT *, abs(date_diff('day', day, eday)) AS days, sqrt(pow(greatest(x0 - x, 0, x - x0 - 6000), 2) + pow(greatest(y0 - y, 0, y - y0 - 6000), 2)) AS mt, coalesce(m, '') <> '' AND lower(m) = replace(lower(c), '-', ' ') AS mm,
 CASE WHEN p IS NULL OR ep IS NULL THEN NULL WHEN effis_id % 3 = 0 THEN true ELSE record_id % 2 = 1 END AS pm, CASE WHEN a > 0 AND ea > 0 THEN least(a, ea) / greatest(a, ea) END AS sim FROM l JOIN r ON abs(date_diff('day', day, eday)) <= 14),
s AS (SELECT *, least(100, CASE WHEN mt = 0 THEN 50 WHEN mt <= 1000 THEN 40 WHEN mt <= 5000 THEN 25 ELSE 10 END + CASE WHEN days = 0 THEN 30 WHEN days <= 1 THEN 25 WHEN days <= 3 THEN 18 WHEN days <= 7 THEN 10 ELSE 4 END + mm::INT * 15 + coalesce((sim >= 0.5)::INT, 0) * 5)::INT AS score,
 'candidate:2024:' || substr(sha256(record_id || '|' || effis_id), 1, 20) AS candidate_id FROM j WHERE mt <= 20000),
c AS (SELECT *, CASE WHEN score >= 75 THEN 'strong' WHEN score >= 50 THEN 'possible' ELSE 'weak' END AS strength FROM s)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, s = F.col("event_id"), F.col("s_suppkey")
    left = read(spark, d, "events").where("event_type = 'purchase'").select(
        e.alias("record_id"), (e * 7919 % 1000 * 100.0).alias("x"), (e * 104729 % 1000 * 100.0).alias("y"), F.to_date("ts").alias("day"), F.when(e % 3 == 0, F.concat(F.lit("Town "), F.col("user_id") % 5)).alias("municipality"),
        F.when(e % 4 != 0, F.concat(F.lit("Castelló de la P"), e % 2)).alias("province"), F.col("value").alias("area"),
    )
    x, y = s * 271 % 900 * 100.0, s * 613 % 900 * 100.0
    ring = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (6000, 0), (6000, 6000), (0, 6000), (0, 0))))
    right = read(spark, d, "supplier").select(
        s.alias("effis_id"), ring.alias("ring"), F.date_add(F.lit("2024-01-01").cast("date"), (s * 7 % 45).cast("int")).alias("effis_day"), F.concat(F.lit("TOWN-"), s % 5).alias("commune"),
        F.when(s % 3 == 0, "Castelló/Castellón").when(s % 3 == 1, "València p1").alias("effis_province"), F.col("s_acctbal").alias("effis_area"),
    )
    return left, right


@query(f"""WITH {_LINKS} SELECT candidate_id, record_id, effis_id, score, strength, days::INT AS days, round(mt, 3) AS metres, mm AS municipality_match, pm AS province_match, round(sim, 6) AS similarity,
 concat_ws(',', CASE WHEN mt = 0 THEN 'point inside perimeter' WHEN mt <= 1000 THEN 'at most 1 km' WHEN mt <= 5000 THEN 'at most 5 km' END, CASE WHEN days = 0 THEN 'same day' WHEN days <= 1 THEN 'at most one day' WHEN days <= 3 THEN 'at most three days' WHEN days <= 7 THEN 'at most seven days' END,
  CASE WHEN mm THEN 'labels agree' END, CASE WHEN pm THEN 'provinces share a name' END, CASE WHEN sim >= 0.5 THEN 'areas within a factor of two' END) AS reasons_for,
 concat_ws(',', CASE WHEN mt > 5000 THEN 'more than 5 km' END, CASE WHEN days > 7 THEN 'more than seven days' END, CASE WHEN NOT mm THEN 'labels differ' END, CASE WHEN NOT pm THEN 'provinces share no name' END, CASE WHEN sim < 0.2 THEN 'areas differ by more than a factor of five' END) AS reasons_against FROM c""")
def candidate_links(spark: SparkSession, d: str) -> DataFrame:
    out = linking.candidates(*_sides(spark, d), order=True)
    return out.select("candidate_id", "record_id", "effis_id", "score", "strength", "days", "metres", "municipality_match", "province_match", "similarity", F.array_join("reasons_for", ",").alias("reasons_for"), F.array_join("reasons_against", ",").alias("reasons_against"))


@query(f"""WITH {_LINKS} SELECT count(*) FILTER (WHERE strength = 'strong') AS strong, count(*) FILTER (WHERE strength = 'possible') AS possible, count(*) FILTER (WHERE strength = 'weak') AS weak, count(DISTINCT record_id) AS with_candidate, (SELECT count(*) FROM l) - count(DISTINCT record_id) AS without_candidate FROM c""")
def candidate_strengths(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return linking.strength_counts(linking.candidates(left, right), left, "record_id")


@query(f"""WITH {_LINKS}, e AS (SELECT 'record' AS side, record_id::VARCHAR AS id, * EXCLUDE (effis_id, record_id) FROM c WHERE strength <> 'weak' UNION ALL SELECT 'perimeter', effis_id::VARCHAR, * EXCLUDE (effis_id, record_id) FROM c WHERE strength <> 'weak')
SELECT side, id, count(*) AS n_links, max(score) AS best, string_agg(candidate_id, ',' ORDER BY score DESC, candidate_id) AS candidates FROM e GROUP BY ALL""")
def candidate_index(spark: SparkSession, d: str) -> DataFrame:
    return linking.visible_index(*_sides(spark, d))


@query(f"""WITH {_LINKS}, t AS (SELECT candidate_id AS id, 'named place in a month' AS why FROM c WHERE m = 'Town 3' AND month(day) = 1 UNION ALL SELECT record_id::VARCHAR, 'large and linked' FROM l WHERE a >= 150 AND record_id IN (SELECT record_id FROM c) UNION ALL SELECT record_id::VARCHAR, 'large and unlinked' FROM l WHERE a >= 60 AND record_id NOT IN (SELECT record_id FROM c))
SELECT why, id FROM t""")
def representative_cases(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    # a record's links are its own, so only those of the records asked for are found
    town = left.where("municipality = 'Town 3'").where(F.month("day") == 1)
    named = linking.candidates(town, right)
    large = left.where("area >= 60")
    links = linking.candidates(large, right)
    linked = linking.evidence(large.where("area >= 150"), links, ["record_id"])
    alone = linking.unlinked(left, links, "record_id", F.col("area") >= 60)
    told = lambda rows, c, why: rows.select(F.lit(why).alias("why"), F.col(c).cast("string").alias("id"))
    return told(named, "candidate_id", "named place in a month").union(told(linked, "record_id", "large and linked")).union(told(alone, "record_id", "large and unlinked"))


# --- the history of a point: perimeters that hold it, by entity, and points near it

_AT = (300.0, 400.0)


@query(f"""WITH {POINTS}, h AS (SELECT s_suppkey // 4 AS fire, s_suppkey % 10 = 0 AS reused FROM supplier WHERE {_AT[0]} BETWEEN s_suppkey * 271 % 900 AND s_suppkey * 271 % 900 + 200 AND {_AT[1]} BETWEEN s_suppkey * 613 % 900 AND s_suppkey * 613 % 900 + 200)
SELECT 'perimeters' AS kind, fire AS id, count(*)::DOUBLE AS value, bool_or(reused) AS reused FROM h GROUP BY fire UNION ALL SELECT 'nearby', point_id, round(sqrt(pow(px - {_AT[0]}, 2) + pow(py - {_AT[1]}, 2)), 6), NULL FROM points WHERE sqrt(pow(px - {_AT[0]}, 2) + pow(py - {_AT[1]}, 2)) <= 100""")
def point_history(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    x, y = (s * 271 % 900).cast("double"), (s * 613 % 900).cast("double")
    ring = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (200, 0), (200, 200), (0, 200), (0, 0))))
    at = [F.lit(v) for v in _AT]
    boxed = read(spark, d, "supplier").select(F.floor(s / 4).alias("id"), (s % 10 == 0).alias("reused"), ring.alias("ring"), x.alias("x"), y.alias("y"))
    near = boxed.where(at[0].between(F.col("x"), F.col("x") + 200) & at[1].between(F.col("y"), F.col("y") + 200)).where(G.covers(*at, F.col("ring")))
    held = near.groupBy("id").agg(F.count("*").cast("double").alias("value"), F.bool_or("reused").alias("reused")).select(F.lit("perimeters").alias("kind"), "id", "value", "reused")
    gap = F.sqrt(F.pow(F.col("px") - _AT[0], 2) + F.pow(F.col("py") - _AT[1], 2))
    close = points(spark, d).where(F.col("px").between(_AT[0] - 100, _AT[0] + 100) & (gap <= 100)).select(F.lit("nearby").alias("kind"), F.col("point_id").alias("id"), F.round(gap, 6).alias("value"), F.lit(None).cast("boolean").alias("reused"))
    return held.union(close).orderBy(F.col("kind").desc(), "value", "id")


# --- duplicate groups: orders of a customer's hundred, as features of one content

_DUPES = """f AS (SELECT sha256((o_custkey // 3)::VARCHAR) AS digest, o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE o_orderkey // 2 END AS cv, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'm' || o_orderkey // 2 END AS mn, year(o_orderdate)::INT AS y,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN DATE '1996-07-01' ELSE o_orderdate::DATE END AS det, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate::DATE - (o_orderkey % 3)::INT + 1 END AS ext,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE year(o_orderdate)::INT - (o_orderkey % 8 = 1)::INT END AS pre, CASE WHEN o_custkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS cause, CASE WHEN o_custkey % 5 = 0 THEN 1.0 ELSE o_totalprice END AS area, o_orderstatus AS raw FROM orders),
t AS (SELECT *, year(det) = y AS c1, pre = year(det) AS c2, pre = y AS c3, ext < det AS c4, md5(concat_ws('|', coalesce(mn, '-'), coalesce(cause, '-'))) AS exact FROM f)"""


def _dupes(spark: SparkSession, d: str) -> DataFrame:
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    fixed = c % 5 == 0
    rows = read(spark, d, "orders").select(
        F.sha2(F.floor(c / 3).cast("string"), 256).alias("digest"), k.alias("k"), F.when(c % 4 == 0, 1).otherwise(F.floor(k / 2)).alias("cv"), F.when(c % 4 != 0, F.concat(F.lit("m"), F.floor(k / 2))).alias("mn"), F.year(day).alias("y"),
        F.when(k % 13 == 0, None).when(fixed, F.lit("1996-07-01").cast("date")).otherwise(day).alias("det"), F.when(k % 6 != 0, F.date_add(F.date_sub(day, (k % 3).cast("int")), 1)).alias("ext"),
        F.when(k % 9 != 0, F.year(day) - (k % 8 == 1).cast("int")).alias("pre"), F.when(fixed, "x").otherwise(F.col("o_orderpriority")).alias("cause"), F.when(fixed, 1.0).otherwise(F.col("o_totalprice")).alias("area"), F.col("o_orderstatus").alias("raw"),
    )
    exact = F.md5(F.concat_ws("|", F.coalesce("mn", F.lit("-")), F.coalesce("cause", F.lit("-"))))
    return rows.withColumns(duplicates.tri_state(F.col("y"), F.col("det"), F.col("ext"), F.col("pre")) | {"exact": exact})


@query(f"WITH {_DUPES} SELECT k, c1 AS detection_in_year, c2 AS prefix_is_detection_year, c3 AS prefix_is_year, c4 AS extinct_before_detected FROM t")
def date_checks(spark: SparkSession, d: str) -> DataFrame:
    return _dupes(spark, d).select("k", "detection_in_year", "prefix_is_detection_year", "prefix_is_year", "extinct_before_detected")


_GROUPS = f"""{_DUPES}, g AS (SELECT digest, count(*) AS members, count(DISTINCT cv || '/' || coalesce(mn, '')) AS n_ids, list_sort(list(DISTINCT y)) AS ys, count(DISTINCT det) AS nd, count(DISTINCT coalesce(cause, '?')) > 1 AS d_cause, count(DISTINCT area) > 1 AS d_area, count(DISTINCT coalesce(det, DATE '1900-01-01')) > 1 AS d_det,
 count(DISTINCT exact) = 1 AS same_all, count(DISTINCT raw) = 1 AS same_raw, bool_and(coalesce(c1, false)) AS a1, bool_and(coalesce(c2, false)) AS a2, bool_and(coalesce(c3, false)) AS a3 FROM t GROUP BY digest HAVING count(*) > 1),
e AS (SELECT substr(digest, 1, 16) AS group_id, members, n_ids, array_to_string(ys, ',') AS years, ys[-1] - ys[1] AS span, len(ys) > 1 AND ys[-1] - ys[1] = len(ys) - 1 AS consecutive, CASE WHEN n_ids = 1 THEN 'A' WHEN len(ys) = 1 THEN 'B' ELSE 'C' END AS category,
 concat_ws(',', CASE WHEN d_cause THEN 'cause' END, CASE WHEN d_area THEN 'area' END, CASE WHEN d_det THEN 'det' END) AS differing, same_all AS all_attributes_identical, same_raw, a1 AS all_detection_in_year, a2 AS all_prefix_is_detection_year, a3 AS all_prefix_is_year, len(ys) AS ny, nd FROM g),
r AS (SELECT * EXCLUDE (same_raw, ny, nd), concat_ws(',', category, CASE WHEN differing <> '' THEN 'D' END, CASE WHEN same_raw THEN 'E_RAW_IDENTICAL' ELSE 'E_RING_REORDERED' END) AS patterns, differing = '' AS substantially_identical,
 CASE WHEN ny <= 1 THEN 'not_applicable_single_year' WHEN nd = 1 AND differing = '' THEN 'attribute_candidate_not_confirmed' ELSE 'not_supported_by_record_attributes' END AS republication FROM e)"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    checks = ["detection_in_year", "prefix_is_detection_year", "prefix_is_year"]
    return duplicates.group_report(_dupes(spark, d), "digest", ["cv", "mn"], "y", "det", checks, ["cause", "area", "det"], "exact", "raw")


@query(f"WITH {_GROUPS} SELECT * FROM r")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


@query(f"""WITH {_GROUPS}, x AS (SELECT 'category' AS kind, category AS value FROM r UNION ALL SELECT 'pattern', unnest(string_split(patterns, ',')) FROM r UNION ALL SELECT 'field', unnest(string_split(differing, ',')) FROM r WHERE differing <> '' UNION ALL SELECT 'span', span::VARCHAR FROM r UNION ALL SELECT 'year', unnest(string_split(years, ',')) FROM r)
SELECT kind, value, count(*) AS n FROM x WHERE kind <> 'year' GROUP BY ALL UNION ALL SELECT 'year', y::VARCHAR, count(value) FROM unnest(range(1993, 2005)) a(y) LEFT JOIN x ON kind = 'year' AND value = y::VARCHAR GROUP BY y""")
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.group_summary(_groups(spark, d), 1993, 2004)


@query(f"""WITH {_GROUPS}, q AS (SELECT group_id, 0 AS rule, row_number() OVER (ORDER BY group_id) AS pos FROM r WHERE category = 'A' UNION ALL SELECT group_id, 1, row_number() OVER (ORDER BY group_id) FROM r WHERE substantially_identical
 UNION ALL SELECT * FROM (SELECT group_id, 2, row_number() OVER (ORDER BY members DESC, group_id) AS p FROM r) WHERE p <= 8 UNION ALL SELECT * FROM (SELECT group_id, 3, row_number() OVER (ORDER BY span DESC, group_id) AS p FROM r) WHERE p <= 8
 UNION ALL SELECT * FROM (SELECT group_id, 4, row_number() OVER (ORDER BY n_ids DESC, group_id) AS p FROM r WHERE NOT all_prefix_is_year) WHERE p <= 8 UNION ALL SELECT * FROM (SELECT group_id, 5, row_number() OVER (ORDER BY members DESC, group_id) AS p FROM r WHERE category = 'B') WHERE p <= 8),
m AS (SELECT group_id, min((rule, pos)) AS first_at, list_sort(list(rule)) AS rules FROM q GROUP BY 1)
SELECT group_id, row_number() OVER (ORDER BY first_at)::INT AS place, array_to_string(list_transform(rules, lambda x: ['same identifiers', 'attributes coincide', 'largest', 'longest span', 'unfit prefixes', 'same year'][x + 1]), ',') AS reasons FROM m ORDER BY first_at LIMIT 20""")
def representative_groups(spark: SparkSession, d: str) -> DataFrame:
    """Six ordered selections, two without a cap and four of eight; unfit prefixes stand for invalid geometry."""
    c, by = F.col, [F.col("group_id")]
    rules = [
        ("same identifiers", c("category") == "A", by, None), ("attributes coincide", c("substantially_identical"), by, None), ("largest", F.lit(True), [c("members").desc(), *by], 8),
        ("longest span", F.lit(True), [c("span").desc(), *by], 8), ("unfit prefixes", ~c("all_prefix_is_year"), [c("n_ids").desc(), *by], 8), ("same year", c("category") == "B", [c("members").desc(), *by], 8),
    ]
    return duplicates.selections(_groups(spark, d), rules, 20)


# --- historical reports: orders, as texts of a form

_REPORTS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate)::INT - 22 + (o_orderkey % 15)::INT AS y, ['Alicante', 'Castellon', 'Valencia'][(o_orderkey % 3)::INT + 1] AS province, ['03', '12', '46'][(o_orderkey % 3)::INT + 1] AS code FROM orders),
h0 AS (SELECT k, province, code AS province_code, CASE WHEN k % 19 = 0 THEN NULL ELSE y || code || lpad((k % 10000)::VARCHAR, 4, '0') END AS source_record_id, CASE WHEN k % 4 = 0 AND k % 19 = 0 THEN NULL ELSE y END AS year,
 CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE k % 700 + 0.5 END::DECIMAL(18,4) AS wooded, CASE WHEN k % 4 = 1 THEN NULL ELSE k % 300 + 0.25 END::DECIMAL(18,4) AS nonwooded, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 50 END::DECIMAL(18,4) AS agricultural,
 (k % 7)::INT AS mc, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '500' ELSE (k % 4)::VARCHAR END AS cause_code, CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN 'no date' WHEN 2 THEN (y + 1) || '-03-01T10:00' ELSE y || '-06-15T10:00' END AS detection,
 CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN y || '-06-14' WHEN 2 THEN y || '-13-01' ELSE y || '-06-16 08:30:00' END AS extinction, CASE WHEN k % 10 = 3 THEN 'Paraje ' || k END AS paraje, CASE WHEN k % 14 = 0 THEN '7' END AS sheet, CASE WHEN k % 21 = 0 THEN ['1', '2'] WHEN k % 21 = 1 THEN ['4'] ELSE [] END AS coords FROM o),
h1 AS (SELECT *, CASE WHEN wooded IS NOT NULL AND nonwooded IS NOT NULL THEN wooded + nonwooded WHEN wooded IS NOT NULL THEN nullif(wooded, 0) ELSE nonwooded END AS forest, CASE WHEN mc BETWEEN 1 AND 4 THEN 'M' || province_code || mc END AS municipality FROM h0),
h AS (SELECT k, source_record_id, year, province, province_code, municipality, mc AS municipality_source_code, CASE WHEN mc > 0 THEN province_code || lpad(mc::VARCHAR, 3, '0') END AS municipality_codine, paraje, detection, extinction,
 CASE WHEN forest IS NOT NULL OR agricultural IS NOT NULL THEN coalesce(forest, 0) + coalesce(agricultural, 0) END::DOUBLE AS total_area, forest::DOUBLE AS forest_area, wooded::DOUBLE AS wooded_area, nonwooded::DOUBLE AS nonwooded_area, agricultural::DOUBLE AS agricultural_area,
 CASE cause_code WHEN '1' THEN 'lightning' WHEN '2' THEN 'negligence' WHEN '500' THEN 'not known' END AS cause, cause_code, CASE WHEN coalesce(cause_code, '0') IN ('0', '500') THEN 'unknown' ELSE 'reported' END AS cause_status, coalesce(forest >= 500, false) AS is_large,
 CASE WHEN len(coords) > 0 THEN 'raw_unvalidated' ELSE 'absent' END AS coordinate_status, sheet IS NOT NULL AS has_sheet_or_grid,
 CASE WHEN len(coords) > 0 THEN 'raw_coordinate_unvalidated' WHEN sheet IS NOT NULL THEN 'map_sheet_or_grid' WHEN municipality IS NOT NULL THEN 'municipality' WHEN paraje IS NOT NULL THEN 'textual' ELSE 'none' END AS location_quality,
 len(coords) > 0 OR sheet IS NOT NULL OR paraje IS NOT NULL OR mc <> 0 AS has_spatial_information,
 CASE WHEN year BETWEEN 1968 AND 1971 THEN 'historical_form_1' WHEN year BETWEEN 1972 AND 1979 THEN 'historical_form_2' WHEN year BETWEEN 1980 AND 1982 THEN 'historical_form_3' WHEN year BETWEEN 1983 AND 1988 THEN 'historical_form_4' WHEN year = 1989 THEN 'historical_form_5' WHEN year BETWEEN 1990 AND 1992 THEN 'historical_form_6' ELSE 'unknown' END AS form_model,
 CASE WHEN year IS NULL THEN 'unknown' WHEN year <= 1979 THEN 'selective' WHEN year <= 1991 THEN 'transitional' ELSE 'systematic_or_near_systematic' END AS coverage_status FROM h1)"""


def _report_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    y = F.year("o_orderdate") - 22 + (k % 15).cast("int")
    pick = lambda *v: F.get(F.array(*(F.lit(x) for x in v)), (k % 3).cast("int"))
    code, text = pick("03", "12", "46"), lambda c: c.cast("string")
    rows = read(spark, d, "orders").select(
        F.when(k % 19 == 0, " ").otherwise(F.concat(y, code, F.lpad(text(k % 10000), 4, "0"))).alias("number"), text(F.col("o_custkey")).alias("database_id"), F.when(k % 4 != 0, text(y)).when(k % 19 == 0, "").alias("year"),
        pick("Alicante", "Castellon", "Valencia").alias("province"), code.alias("province_code"), text(k % 7).alias("municipality_code"), F.when(k % 3 == 1, " 500").when(k % 3 == 2, text(k % 4)).alias("cause_code"),
        F.when(k % 6 == 1, "0").when(k % 6 != 0, F.concat(k % 700, F.lit(",5"))).alias("wooded"), F.when(k % 4 != 1, F.concat(k % 300, F.lit(".25"))).otherwise("n/a").alias("nonwooded"),
        F.when(k % 5 != 0, text(k % 50)).alias("agricultural"), F.lit(None).cast("string").alias("other"),
        F.when(k % 8 == 1, "no date").when(k % 8 == 2, F.concat(y + 1, F.lit("-03-01T10:00"))).when(k % 8 != 0, F.concat(y, F.lit("-06-15T10:00"))).alias("detection"),
        F.when(k % 5 == 1, F.concat(y, F.lit("-06-14"))).when(k % 5 == 2, F.concat(y, F.lit("-13-01"))).when(k % 5 != 0, F.concat(y, F.lit("-06-16 08:30:00"))).alias("extinction"),
        F.when(k % 10 == 3, F.concat(F.lit("Paraje "), k)).alias("place"), F.when(k % 14 == 0, "7").alias("sheet"), F.lit("").alias("grid"),
        F.when(k % 21 == 0, F.array(F.lit("1"), F.lit("2"))).when(k % 21 == 1, F.array(F.lit(" "), F.lit("4"))).when(k % 21 == 2, F.array(F.lit(""))).alias("coordinates"), text(k).alias("affected"),
    )
    towns = spark.sql("SELECT p || lpad(n, 3, '0') AS codine, 'M' || p || n AS municipality FROM VALUES ('03'), ('12'), ('46') AS a(p) LATERAL VIEW explode(array('1', '2', '3', '4')) AS n")
    causes = spark.sql("SELECT * FROM VALUES ('0', 'nothing'), ('1', 'lightning'), ('2', 'negligence'), ('500', 'not known') AS t(cause_code, cause)")
    return historical.normalised(rows, towns, causes)


_FIELDS = ["source_record_id", "year", "province", "province_code", "municipality", "municipality_source_code", "municipality_codine", "paraje", "detection", "extinction", "total_area", "forest_area", "wooded_area", "nonwooded_area", "agricultural_area", "cause", "cause_code", "cause_status", "is_large", "coordinate_status", "has_sheet_or_grid", "location_quality", "has_spatial_information", "form_model", "coverage_status"]


@query(f"WITH {_REPORTS} SELECT k::INT AS affected, {', '.join(_FIELDS)} FROM h")
def historical_records(spark: SparkSession, d: str) -> DataFrame:
    """affected holds the row's key here."""
    return _report_rows(spark, d).select("affected", *_FIELDS)


_METRIC_SQL = ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in historical.METRICS.items())


@query(f"WITH {_REPORTS} SELECT year, province, count(*) AS records, {_METRIC_SQL}, grouping(year) = 1 AS total FROM h GROUP BY GROUPING SETS ((year, province), ())")
def historical_metrics(spark: SparkSession, d: str) -> DataFrame:
    return historical.metrics(_report_rows(spark, d), ["year", "province"])


_ANOMALY_SQL = {
    "invalid_detection_date": "detection IS NOT NULL AND t IS NULL", "invalid_extinction_date": "extinction IS NOT NULL AND u IS NULL", "extinction_before_detection": "u < t", "detection_year_mismatch": "t IS NOT NULL AND year(t) IS DISTINCT FROM year",
    "source_report_id_year_or_province_mismatch": "regexp_full_match(source_record_id, '\\d{10}') AND (source_record_id[1:4] IS DISTINCT FROM year::VARCHAR OR source_record_id[5:6] <> province_code)", "source_province_mismatch": "k % 11 = 0",
    "unresolved_municipality_code": "municipality_source_code <> 0 AND municipality IS NULL", "negative_surface": "forest_area < 0", "zero_surface": "forest_area = 0", "surface_over_100000_ha": "forest_area > 100000", "source_export_repeated_scalar": "k % 23 = 0",
}


@query(f"WITH {_REPORTS}, a AS (SELECT *, TRY_CAST(replace(detection, 'T', ' ') AS TIMESTAMP) AS t, TRY_CAST(extinction AS TIMESTAMP) AS u FROM h) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {c}) AS n, count(*) FILTER (WHERE {c}) AS records FROM a" for k, c in _ANOMALY_SQL.items()))
def historical_anomalies(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import quality

    k = F.col("affected")
    rows = _report_rows(spark, d).withColumns({"source_province": F.when(k % 11 == 0, 99).otherwise(F.col("province_code").cast("int")), "repeated_scalars": (k % 23 == 0).cast("int")})
    return quality.anomalies(rows, "affected", historical.anomaly_rules())


@query(f"""WITH {_REPORTS}, p(province, pr, pw, pn, pf) AS (VALUES {', '.join(map(str, historical.PUBLISHED_1992))}), s AS (SELECT province, count(*) AS records, sum(coalesce(wooded_area, 0)) AS w, sum(coalesce(nonwooded_area, 0)) AS n, sum(coalesce(forest_area, 0)) AS f FROM h WHERE year = 1980 GROUP BY 1),
v AS (SELECT p.province, pr, coalesce(records, 0) AS records, round(coalesce(w, 0), 1) AS wooded, round(coalesce(n, 0), 1) AS nonwooded, round(coalesce(f, 0), 1) AS forest, pw::DOUBLE AS pw, pn::DOUBLE AS pn, pf::DOUBLE AS pf FROM p LEFT JOIN s USING (province))
SELECT province, records, records - pr AS more_records, wooded, nonwooded, forest, round(wooded - pw, 1) AS more_wooded, round(nonwooded - pn, 1) AS more_nonwooded, round(forest - pf, 1) AS more_forest FROM v""")
def publication_contrast(spark: SparkSession, d: str) -> DataFrame:
    """A year that the tables have, against the constants of 1992."""
    return historical.publication_contrast(_report_rows(spark, d), 1980)


@query(f"WITH {_REPORTS} SELECT y::INT AS year, count(k) AS n FROM unnest(range(1968, 1993)) a(y) LEFT JOIN h ON year = y GROUP BY y")
def historical_years(spark: SparkSession, d: str) -> DataFrame:
    return historical.zero_filled_years(_report_rows(spark, d), 1968, 1992)




_TEXTS = ["Castelló de la Plana", "Castelló/Castellón", "València", "Elx/Elche", "1º de Mayo", "Straße", "  ", "L'Alcúdia"]


@query("SELECT * FROM (VALUES ('Castelló de la Plana', 'castello de la plana', 'castello de la plana', NULL, true), ('Castelló/Castellón', 'castello castellon', 'castello castellon', 'castello|castellon', true), ('València', 'valencia', 'valencia', NULL, false), ('Elx/Elche', 'elx elche', 'elx elche', 'elche|elx', false), ('1º de Mayo', '1o de mayo', '1o de mayo', NULL, true), ('Straße', 'strae', 'strasse', NULL, false), ('  ', '', '', NULL, NULL), ('L''Alcúdia', 'l alcudia', 'l alcudia', NULL, false)) t(raw, label, alias, signature, meets)")
def label_forms(spark: SparkSession, d: str) -> DataFrame:
    """Hard labels; meets: whether they share a word with a bilingual name. Expected values are told from the rules."""
    rows = read(spark, d, "region").limit(1).select(F.explode(F.array(*(F.lit(t) for t in _TEXTS))).alias("raw"))
    r = F.col("raw")
    return rows.select("raw", S.label(r).alias("label"), S.alias(r).alias("alias"), S.bilingual_signature(r).alias("signature"), S.labels_meet(r, F.lit("Castello / de")).alias("meets"))


#: Known points: longitude and latitude of the central meridian, and of others by the standard series.
@query("SELECT * FROM (VALUES (-3.0::DOUBLE, 0.0::DOUBLE, 500000.0::DOUBLE, 0.0::DOUBLE), (-3.0, 40.0, 500000.0, 4427757.219)) t(lon, lat, x, y)")
def utm_known_points(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM VALUES (-3.0D, 0.0D), (-3.0D, 40.0D) AS t(lon, lat)")
    x, y = G.wgs84_to_utm(F.col("lon"), F.col("lat"))
    return rows.select("lon", "lat", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"WITH {POINTS} SELECT point_id, 400000 + px * 300 AS x, 4200000 + py * 300 AS y FROM points")
def utm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Plane coordinates to geographic ones and back, to the millimetre; known points are a query of their own."""
    rows = points(spark, d).select("point_id", (400000 + F.col("px") * 300).alias("x"), (4200000 + F.col("py") * 300).alias("y"))
    lon, lat = G.utm_to_wgs84(F.col("x"), F.col("y"))
    x, y = G.wgs84_to_utm(lon, lat)
    return rows.select("point_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))
