"""Queries over the driver's tables, one or more per group of operators, each beside the SQL that says the same.

Roles: orders with customer, nation and region are records (province: region, municipality: nation, cause: priority,
area: total price / 1000); lineitem rows are their geometries; points are integer arithmetic on keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import duplicates, history, identity, levels, linking, quality, spatial, views
from ..sources import readers, writers
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: read(spark, d, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("entity"), F.year("o_orderdate").alias("year"), F.col("r_name").alias("province"),
        F.col("n_name").alias("municipality"), F.col("o_orderpriority").alias("cause"), (F.col("o_totalprice") / 1000).alias("area"), (F.col("o_totalprice") >= 300000).alias("is_gif"),
        F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("day"),
    )


RECORDS = """records AS (SELECT o_orderstatus AS source, o_orderkey AS entity, year(o_orderdate)::INT AS year, r_name AS province, n_name AS municipality, o_orderpriority AS cause,
  o_totalprice / 1000 AS area, o_totalprice >= 300000 AS is_gif, o_custkey AS customer, o_orderdate AS day
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("point_id"), (k * 7919 % 1000).cast("double").alias("px"), (k * 104729 % 1000).cast("double").alias("py"), "c_nationkey")


POINTS = "points AS (SELECT c_custkey AS point_id, (c_custkey * 7919 % 1000)::DOUBLE AS px, (c_custkey * 104729 % 1000)::DOUBLE AS py, c_nationkey FROM customer)"


def box_ring(k: Column) -> Column:
    """A square of side 60 by a supplier's key, closed."""
    x, y = (k * 271 % 900).cast("double"), (k * 613 % 900).cast("double")
    return F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (60, 0), (60, 60), (0, 60), (0, 0))))


@query(f"""WITH {RECORDS}, y AS (SELECT unnest(range(1995, 2002))::INT AS year)
SELECT y.year, count(DISTINCT entity) FILTER (WHERE source = 'F') AS "F", count(DISTINCT entity) FILTER (WHERE source = 'O') AS "O", count(DISTINCT entity) FILTER (WHERE source = 'P') AS "P"
FROM y LEFT JOIN (SELECT * FROM records WHERE area >= 50 AND province IN ('ASIA', 'EUROPE')) r ON y.year = r.year GROUP BY y.year""")
def histogram_by_source(spark: SparkSession, d: str) -> DataFrame:
    return views.year_histogram(records(spark, d), views.Filters(provinces=["ASIA", "EUROPE"], min_area=50), 1995, 2001, ["F", "O", "P"])


@query(f"""WITH {RECORDS}, once AS (SELECT source, entity, count(*) n, max(area) area, bool_or(is_gif) gif FROM records WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS perimeters, count(*) AS entities, round(sum(area), 2) AS area, count(*) FILTER (WHERE gif) AS large FROM once GROUP BY source""")
def metric_cards(spark: SparkSession, d: str) -> DataFrame:
    return views.metric_cards(records(spark, d), views.Filters(years=(1996, 1999)))


@query(f"""WITH {RECORDS} SELECT source, entity, max(area) AS area FROM records WHERE cause = '1-URGENT' GROUP BY ALL ORDER BY area DESC, source, entity LIMIT 60""")
def top_entities(spark: SparkSession, d: str) -> DataFrame:
    return views.top_entities(records(spark, d), views.Filters(cause="1-URGENT"))


@query("SELECT c_nationkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey")
def option_list(spark: SparkSession, d: str) -> DataFrame:
    return views.options(read(spark, d, "customer"), "c_nationkey", "c_name", "c_custkey")


@query("""WITH c AS (SELECT nullif(l_orderkey, 1)::VARCHAR AS v, count(*) n FROM lineitem GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::BIGINT AS missing, count(v) AS distinct_values, count(*) FILTER (WHERE n > 1 AND v IS NOT NULL) AS duplicated_values,
 sum(n - 1) FILTER (WHERE v IS NOT NULL)::BIGINT AS duplicate_excess FROM c""")
def identifier_profile(spark: SparkSession, d: str) -> DataFrame:
    return identity.identifier_profile(read(spark, d, "lineitem").select(F.nullif("l_orderkey", F.lit(1)).alias("k")), "k")


@query("""WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem)
SELECT 'a' AS side, a::VARCHAR AS value, count(*) AS partners FROM p GROUP BY a HAVING count(*) > 1 UNION ALL SELECT 'b', b::VARCHAR, count(*) FROM p GROUP BY b HAVING count(*) > 1""")
def identifier_bijection(spark: SparkSession, d: str) -> DataFrame:
    return identity.bijection_breaks(read(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("""WITH p AS (SELECT o_custkey AS value, year(o_orderdate)::INT AS y, count(*) n FROM orders GROUP BY ALL)
SELECT value, count(*) AS n_years, sum(n)::BIGINT AS n_rows, min(y) AS first_year, max(y) AS last_year FROM p GROUP BY value HAVING count(*) >= 2""")
def cross_year_repeat(spark: SparkSession, d: str) -> DataFrame:
    return identity.cross_year_repeats(read(spark, d, "orders"), "o_custkey", F.year("o_orderdate"))


@query("SELECT page_id, 'fire:' || url_encode(url) AS fire_id FROM pages")
def fallback_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", S.namespaced_id("fire:", F.col("url")).alias("fire_id"))


@query("""SELECT substr(sha256(text), 1, 16) AS group_id, count(*) AS members, count(DISTINCT doc_id) AS identifiers, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def equivalent_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.equal_groups(read(spark, d, "documents"), F.col("text"), "doc_id")


@query("""WITH g AS (SELECT sha256(text) AS digest, count(*) AS members, count(DISTINCT source || '/' || lang) AS ids, count(DISTINCT doc_id % 3) AS years FROM documents GROUP BY 1)
SELECT digest, members, CASE WHEN ids = 1 THEN 'A' WHEN years = 1 THEN 'B' ELSE 'C' END AS category FROM g WHERE members > 1""")
def group_classification(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "source", "lang", (F.col("doc_id") % 3).alias("year"))
    return duplicates.classified(rows, "digest", ["source", "lang"], "year")


@query("""WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS year FROM orders) SELECT o_custkey, year, year - lag(year) OVER (PARTITION BY o_custkey ORDER BY year) AS gap FROM y""")
def year_gaps(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.year_gaps(read(spark, d, "orders"), "o_custkey", F.year("o_orderdate"))


@query("""SELECT o_custkey, count(DISTINCT year(o_orderdate))::INT AS n_years, (max(year(o_orderdate)) - min(year(o_orderdate)))::INT AS span,
 max(year(o_orderdate)) - min(year(o_orderdate)) = count(DISTINCT year(o_orderdate)) - 1 AS consecutive FROM orders GROUP BY 1""")
def time_pattern(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.time_pattern(read(spark, d, "orders"), "o_custkey", F.year("o_orderdate"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS ordinal, substr(sha256('["' || user_id || '","' || event_type || '"]'), 1, 20) AS row_hash FROM events""")
def occurrence_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return identity.occurrence_ordinals(read(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"]).select("event_id", "ordinal", "row_hash")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) > 1 AS multi FROM lineitem""")
def multi_geometry_role(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.count("*").over(Window.partitionBy("l_orderkey")) > 1).alias("multi"))


@query("""SELECT sha256('{"lang":"' || lang || '","text_hash":"' || md5(text) || '"}') AS fingerprint, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("lang", F.md5("text").alias("text_hash"))
    return rows.groupBy(F.sha2(S.canonical_json("text_hash", "lang"), 256).alias("fingerprint")).agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH r AS (SELECT year(o_orderdate)::INT AS g, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)
SELECT g AS "group", count(*) AS n, 'status' AS field, count(*) - count(status) AS missing FROM r GROUP BY g UNION ALL SELECT g, count(*), 'priority', count(*) - count(priority) FROM r GROUP BY g""")
def missing_values_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderdate", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return quality.missing_matrix(rows, F.year("o_orderdate"), ["status", "priority"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN o_orderdate::DATE::VARCHAR END AS day, o_orderkey % 5 = 4 AS failed FROM orders""")
def date_parse_audit(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.when(k % 5 == 4, "31/31/1999").when(k % 2 == 0, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, " yyyy-MM-dd "))
    rows = read(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", S.source_date(F.col("t")).cast("string").alias("day"), S.date_error(F.col("t")).isNotNull().alias("failed"))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS spanish, round(o_totalprice, 2) AS plain, CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice, 2) END AS comma FROM orders""")
def spanish_decimal(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    body = F.format_string("%d.%03d,%02d", F.floor(cents / 100000), F.floor(cents / 100) % 1000, cents % 100)
    rows = read(spark, d, "orders").select("o_orderkey", body.alias("a"), F.format_string("%d.%02d", F.floor(cents / 100), cents % 100).alias("b"), F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.format_string("%d,%02d", F.floor(cents / 100), cents % 100)).alias("c"))
    return rows.select("o_orderkey", S.spanish_decimal(F.col("a")).alias("spanish"), S.plain_number(F.col("b")).alias("plain"), S.comma_decimal(F.col("c")).alias("comma"))


@query("""SELECT (event_id % 27)::INT AS hour, count(*) AS n, count(*) FILTER (WHERE event_id % 27 > 23 OR event_id % 71 > 59) AS invalid FROM events GROUP BY 1""")
def clock_anomalies(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = read(spark, d, "events").select((e % 27).cast("int").alias("hour"), F.format_string("%d:%02d", e % 27, e % 71).alias("t"))
    return rows.groupBy("hour").agg(F.count("*").alias("n"), F.count_if(S.clock_invalid(F.col("t"))).alias("invalid"))


_LABEL_SQL = """trim(regexp_replace(lower(regexp_replace(replace(replace(replace(strip_accents(text), 'ª', 'a'), 'º', 'o'), '…', '...'), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"""


@query(f"SELECT doc_id, {_LABEL_SQL} AS label FROM documents")
def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Labels of whole texts; the letters that NFKD changes beyond accents are told one by one in the SQL."""
    return read(spark, d, "documents").select("doc_id", S.label(F.col("text")).alias("label"))


@query("""SELECT doc_id, trim(regexp_replace(lower(replace(replace(replace(replace(strip_accents(text), 'ß', 'ss'), 'ª', 'a'), 'º', 'o'), '…', '...')), '[^a-z0-9]+', ' ', 'g')) AS alias FROM documents""")
def alias_normalise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", S.alias(F.col("text")).alias("alias"))


@query("""SELECT n_name, year, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN year < 2000 THEN '1993-1999' ELSE '2000-2009' END AS block,
 CASE WHEN year - 25 <= 1971 THEN 'historical_form_1' WHEN year - 25 <= 1979 THEN 'historical_form_2' END AS model FROM nation, (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders)""")
def province_partition(spark: SparkSession, d: str) -> DataFrame:
    years = read(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    rows = read(spark, d, "nation").crossJoin(F.broadcast(years))  # a fixed table of nations and a few years
    return rows.select("n_name", "year", S.province_partition(F.col("n_name")).alias("slug"), S.temporal_block(F.col("year")).alias("block"), S.form_model(F.col("year") - 25).alias("model"))


_TOKENS = [
    (None, "null"), ("  ", "null"), ("True", "boolean"), ("false", "boolean"), ("TRUE", "string"), ("+12", "integer"), ("5,5", "string"), ("5.", "decimal"), ("-.5", "decimal"), (".", "string"),
    ("2024-01-05T10:00", "datetime"), ("2024-01-05 10:00:01+02:00", "datetime"), ("2024-02-30", "string"), ("2024-01-05T25:00", "string"), (" 2024-01-05 ", "datetime"), ("12a", "string"),
]


@query("WITH v(k, kind) AS (VALUES " + ", ".join(f"({i}, '{kind}')" for i, (_, kind) in enumerate(_TOKENS)) + f") SELECT kind, count(*) AS n FROM events JOIN v ON event_id % {len(_TOKENS)} = k GROUP BY 1")
def lexical_types(spark: SparkSession, d: str) -> DataFrame:
    token = F.get(F.array(*(F.lit(t).cast("string") for t, _ in _TOKENS)), (F.col("event_id") % len(_TOKENS)).cast("int"))
    return read(spark, d, "events").groupBy(S.lexical_type(token).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 6) AS least, round(max(l_extendedprice), 6) AS most, round(avg(l_extendedprice), 6) AS mean,
""" + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM lineitem GROUP BY 1")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return quality.distribution(read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("""SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS total, max(n_chars) AS largest, min(n_chars) AS smallest, quantile_cont(n_chars, 0.5) AS median FROM documents GROUP BY ALL""")
def partition_stats(spark: SparkSession, d: str) -> DataFrame:
    return levels.partition_sizes(read(spark, d, "documents"), ["source", "lang"], "n_chars")


@query(f"""WITH {RECORDS} SELECT year, province, count(*) AS n, count(*) FILTER (WHERE is_gif) AS large, count(*) FILTER (WHERE area < 10) AS small, grouping(year) = 1 AS total FROM records GROUP BY GROUPING SETS ((year, province), ())""")
def grouping_sets_metrics(spark: SparkSession, d: str) -> DataFrame:
    return history.counters(records(spark, d), ["year", "province"], {"large": F.col("is_gif"), "small": F.col("area") < 10})


@query(f"""WITH {RECORDS}, g AS (SELECT year, province, count(*) FILTER (WHERE area >= 200) AS by_first, count(*) FILTER (WHERE area * 1.01 >= 200) AS by_second FROM records GROUP BY ALL) SELECT * FROM g WHERE by_first <> by_second""")
def threshold_audit(spark: SparkSession, d: str) -> DataFrame:
    return history.threshold_audit(records(spark, d), ["year", "province"], F.col("area"), F.col("area") * 1.01, 200)


@query("""WITH h AS (SELECT 'price_too_high' AS rule, o_orderkey AS id FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'late', o_orderkey FROM orders WHERE o_orderdate >= '2001-07-01' UNION ALL SELECT 'odd_low', o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority = '5-LOW')
SELECT r.rule, count(id) AS n, count(DISTINCT id) AS records FROM (VALUES ('price_too_high'), ('late'), ('odd_low'), ('never')) r(rule) LEFT JOIN h USING (rule) GROUP BY 1""")
def anomaly_catalogue(spark: SparkSession, d: str) -> DataFrame:
    rules = {"price_too_high": F.col("o_totalprice") > 400000, "late": F.col("o_orderdate") >= "2001-07-01", "odd_low": (F.col("o_orderkey") % 2 == 1) & (F.col("o_orderpriority") == "5-LOW"), "never": F.col("o_totalprice") < 0}
    return quality.anomalies(read(spark, d, "orders"), "o_orderkey", rules)


@query(f"""WITH {RECORDS}, o AS (SELECT province, year, count(*) AS observed FROM records WHERE area >= 100 GROUP BY ALL), e AS (SELECT r_name AS province, y::INT AS year, (r_regionkey * 10 + y % 7)::BIGINT AS expected FROM region, unnest(range(1994, 2003)) t(y))
SELECT e.province, e.year, expected, coalesce(observed, 0) AS observed FROM e LEFT JOIN o USING (province, year) WHERE expected <> coalesce(observed, 0)""")
def expected_vs_observed(spark: SparkSession, d: str) -> DataFrame:
    axis = read(spark, d, "region").withColumn("year", F.explode(F.sequence(F.lit(1994), F.lit(2002))))
    expected = axis.select(F.col("r_name").alias("province"), "year", (F.col("r_regionkey") * 10 + F.col("year") % 7).cast("long").alias("expected"))
    observed = records(spark, d).where("area >= 100").groupBy("province", "year").agg(F.count("*").alias("observed"))
    return views.expected_against_observed(expected, observed, ["province", "year"])


@query("""SELECT event_id FROM events a WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND b.ts::DATE = a.ts::DATE)""")
def semi_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    return linking.evidence(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id", "day"]).select("event_id")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value")
    left = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), F.col("day").alias("a_day"), F.col("value").alias("a_value"))
    right = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("b"), F.col("day").alias("b_day"), F.col("value").alias("b_value"))
    return linking.within_days(left, right, ["user_id"], 2, "a_day", "b_day")


_PAIRS = """p AS (SELECT a.user_id, a.event_id AS a, b.event_id AS b, abs(date_diff('day', a.ts::DATE, b.ts::DATE)) AS days, a.value AS av, b.value AS bv
 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND abs(date_diff('day', a.ts::DATE, b.ts::DATE)) <= 2)"""


@query(f"WITH {_PAIRS} SELECT user_id, a, b FROM p")
def temporal_theta_join(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("user_id", "a", "b")


@query(f"""WITH {_PAIRS}, s AS (SELECT a, b, (a * 37 + b * 101) % 25000 AS m, days, CASE WHEN av > 0 AND bv > 0 THEN least(av, bv) / greatest(av, bv) END AS sim FROM p),
t AS (SELECT a, b, least(100, CASE WHEN m = 0 THEN 50 WHEN m <= 1000 THEN 40 WHEN m <= 5000 THEN 25 WHEN m <= 20000 THEN 10 ELSE 0 END + CASE WHEN days = 0 THEN 30 WHEN days <= 1 THEN 25 ELSE 18 END
 + CASE WHEN a % 2 = b % 2 THEN 15 ELSE 0 END + CASE WHEN sim >= 0.5 THEN 5 ELSE 0 END)::INT AS score FROM s)
SELECT a, b, score, CASE WHEN score >= 75 THEN 'strong' WHEN score >= 50 THEN 'possible' ELSE 'weak' END AS strength FROM t""")
def candidate_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d)
    score = linking.link_score((F.col("a") * 37 + F.col("b") * 101) % 25000, F.abs(F.datediff("a_day", "b_day")), F.col("a") % 2 == F.col("b") % 2, S.area_similarity(F.col("a_value"), F.col("b_value")))
    return rows.select("a", "b", score.alias("score")).withColumn("strength", linking.strength(F.col("score")))


@query(f"""WITH {_PAIRS} SELECT event_id FROM events e WHERE event_type = 'purchase' AND value >= 50 AND NOT EXISTS (SELECT 1 FROM p WHERE p.a = e.event_id)""")
def anti_large_unlinked(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("a"), "value")
    return linking.unlinked(e, _candidates(spark, d), "a", F.col("value") >= 50).select(F.col("a").alias("event_id"))


_HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - 39.5) / 2), 2) + cos(radians(39.5)) * cos(radians(lat)) * pow(sin(radians(lon - -0.5) / 2), 2))))"


@query(f"""WITH p AS (SELECT c_custkey, -0.5 + (c_custkey * 7919 % 1000 - 500) / 5000.0::DOUBLE AS lon, 39.5 + (c_custkey * 104729 % 1000 - 500) / 5000.0::DOUBLE AS lat FROM customer)
SELECT c_custkey, round({_HAVERSINE}, 3) AS distance FROM p WHERE {_HAVERSINE} <= 5000""")
def nearby_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k, (-0.5 + (k * 7919 % 1000 - 500) / 5000.0).alias("lon"), (39.5 + (k * 104729 % 1000 - 500) / 5000.0).alias("lat"))
    return spatial.within_radius(rows, -0.5, 39.5, 5000).select("c_custkey", F.round("distance", 3).alias("distance"))


@query(f"""WITH {POINTS} SELECT point_id, min(s_suppkey) AS code FROM points JOIN supplier ON px BETWEEN s_suppkey * 271 % 900 AND s_suppkey * 271 % 900 + 60 AND py BETWEEN s_suppkey * 613 % 900 AND s_suppkey * 613 % 900 + 60 GROUP BY 1""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    boxes = read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), box_ring(F.col("s_suppkey")).alias("ring"))
    return spatial.points_in_polygons(points(spark, d), boxes, 60.0)


@query("""SELECT p_partkey, ((p_size + 1) * (p_partkey % 7 + 1))::DOUBLE AS area, 4 AS vertices, (p_partkey % 100)::DOUBLE AS min_x, (p_partkey % 100 + p_size + 1)::DOUBLE AS max_x FROM part""")
def ring_area(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x, w, h = (k % 100).cast("double"), (F.col("p_size") + 1).cast("double"), (k % 7 + 1).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("x"), b.alias("y"))
    zero = F.lit(0.0)
    rows = read(spark, d, "part").select(k, F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h), corner(zero, zero)).alias("ring"))
    box = G.bounds(F.col("ring"))
    return rows.select("p_partkey", G.signed_area(F.col("ring")).alias("area"), G.vertex_count(F.array("ring")).alias("vertices"), box["min_x"].alias("min_x"), box["max_x"].alias("max_x"))


@query(f"""WITH {POINTS}, b AS (SELECT s_suppkey AS k, s_suppkey * 271 % 900 AS x, s_suppkey * 613 % 900 AS y FROM supplier WHERE s_suppkey = 1)
SELECT point_id, round(sqrt(pow(greatest(x - px, 0, px - x - 60), 2) + pow(greatest(y - py, 0, py - y - 60), 2)), 6) AS distance FROM points, b""")
def polygon_distance(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("point_id", F.round(G.polygon_distance(F.col("px"), F.col("py"), box_ring(F.lit(1))), 6).alias("distance"))


@query(f"""WITH {POINTS} SELECT point_id, round((px * 100 - 50000) / 20037508.342789244 * 180, 6) AS lon, round(degrees(2 * atan(exp((py * 1000 + 4000000) / 20037508.342789244 * pi())) - pi() / 2), 6) AS lat FROM points""")
def mercator(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = G.mercator_to_wgs84(F.col("px") * 100 - 50000, F.col("py") * 1000 + 4000000)
    return points(spark, d).select("point_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("""WITH t AS (SELECT p_partkey, list_transform(range(5), lambda i: (p_partkey * (i + 3) % 11)::VARCHAR) AS t FROM part), r AS (SELECT p_partkey, t, list_reverse(t) AS u FROM t)
SELECT p_partkey, list_min(list_concat(list_transform(range(5), lambda i: array_to_string(list_concat(t[i + 1:], t[:i]), ';')), list_transform(range(5), lambda i: array_to_string(list_concat(u[i + 1:], u[:i]), ';')))) AS signature FROM r""")
def ring_signature(spark: SparkSession, d: str) -> DataFrame:
    ring = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.col("p_partkey") * (i + 3) % 11).cast("string"))
    rows = read(spark, d, "part").select("p_partkey", ring.alias("t"))
    return rows.select("p_partkey", G.small_ring_signature(F.concat("t", F.slice("t", 1, 1))).alias("signature"))


@query("""SELECT o_orderpriority AS cause, CASE o_orderpriority WHEN '1-URGENT' THEN '100' WHEN '2-HIGH' THEN '400' WHEN '3-MEDIUM' THEN '500' END AS code,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'known' ELSE 'unknown' END AS status, count(*) AS n FROM orders GROUP BY ALL""")
def cause_map(spark: SparkSession, d: str) -> DataFrame:
    table = F.create_map(*(F.lit(x) for x in ("1-URGENT", "100", "2-HIGH", "400", "3-MEDIUM", "500")))
    rows = read(spark, d, "orders").select(F.col("o_orderpriority").alias("cause"), F.try_element_at(table, F.col("o_orderpriority")).alias("code"))
    return rows.groupBy("cause", "code", S.cause_status(F.col("code")).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT 'missing' AS side, k FROM (SELECT o_orderkey AS k FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'unexpected', k FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)""")
def id_set_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.set_difference(read(spark, d, "orders").select(F.col("o_orderkey").alias("k")), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")))


@query(f"""WITH {POINTS} SELECT n_regionkey, n_nationkey, min(px) AS min_x, min(py) AS min_y, max(px) AS max_x, max(py) AS max_y, count(*) AS n, grouping(n_regionkey, n_nationkey)::BIGINT AS level
FROM points JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def bounds_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnsRenamed({"px": "x", "py": "y"})
    return views.bounds_rollup(rows, ["n_regionkey", "n_nationkey"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT *, max(contains(lower(line), 'license')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l)
SELECT doc_id, i::INT AS i, md5(line) AS line FROM m WHERE near = 1""")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the term are dropped first; a text's lines stay in one row, so nothing is shuffled."""
    texts = read(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    rows = texts.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    hits = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.contains(F.lower(F.get("lines", i)), F.lit("license")))
    near = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(i - 2, F.lit(0)), F.least(i + 2, F.size("lines") - 1)))))
    out = rows.withColumn("i", F.explode(near))
    return out.select("doc_id", "i", F.md5(F.get("lines", F.col("i"))).alias("line"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"'))::INT AS links, nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset FROM pages""")
def html_fields(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(h, F.lit('<a href="([^"]*)"'), F.lit(1))).alias("links"), F.nullif(F.regexp_extract(h, '<meta charset="([^"]*)"', 1), F.lit("")).alias("charset"))


@query("""WITH p AS (SELECT event_id, event_type, unnest(json_keys(props)) AS path, props FROM events) SELECT path, event_type, count(DISTINCT event_id) AS records, 'integer' AS types FROM p WHERE json_extract_string(props, '$."' || path || '"') IS NOT NULL GROUP BY ALL""")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    paths = history.leaf_paths(events, "event_id", "props").join(events.select("event_id", "event_type"), "event_id")
    return history.schema_matrix(paths, "event_type", "event_id")


@query("""SELECT month(ts)::INT AS "group", count(*) AS n, count(DISTINCT user_id || '/' || event_type) AS visible, min(ts) AS first_day, max(ts) AS last_day, round(sum(value), 4) AS area FROM events GROUP BY 1""")
def coverage_entry(spark: SparkSession, d: str) -> DataFrame:
    return history.coverage(read(spark, d, "events"), F.month("ts"), ["user_id", "event_type"], "ts", "value")


@query("""SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[?&#]page=([^&#]*)', 1), '') AS INT) AS page, nullif(regexp_extract(url, '[?&#]ref=([^&#]*)', 1), '') AS ref, nullif(regexp_extract(url, '[?&#]utm_source=([^&#]*)', 1), '') AS utm FROM pages""")
def permalink_parse(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", S.bounded_int(S.url_parameter(u, "page"), 0, 1000).alias("page"), S.url_parameter(u, "ref").alias("ref"), S.url_parameter(u, "utm_source").alias("utm"))


@query(f"""WITH {RECORDS} SELECT CASE WHEN customer % 21 <= 8 THEN 'overview' WHEN customer % 21 <= 10 THEN 'regional' ELSE 'local' END AS level, count(*) AS n FROM records WHERE year BETWEEN 1997 AND 2000 AND province IN ('ASIA', 'AFRICA') GROUP BY 1""")
def level_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).where(views.Filters(provinces=["ASIA", "AFRICA"], years=(1997, 2000)).all())
    return rows.groupBy(S.zoom_level(F.col("customer") % 21).alias("level")).agg(F.count("*").alias("n"))


@query(f"""WITH {RECORDS}, c AS (SELECT year, source, count(DISTINCT entity) AS n FROM records GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY year) AS total FROM c)
SELECT year, source, n, round(n / total, 6) AS share, round(100 * total / max(total) OVER (), 6) AS height FROM t""")
def bar_shares(spark: SparkSession, d: str) -> DataFrame:
    return views.bar_shares(records(spark, d).groupBy("year", "source").agg(F.count_distinct("entity").alias("n")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber::VARCHAR, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE rn = 1""")
def representative_row(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("l_linenumber").cast("string"), *(F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))]
    return identity.representative(read(spark, d, "lineitem"), "l_orderkey", order).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return windows.windowed_counts(read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT doc_id, sum(quality)::BIGINT AS quality, bool_or(toxic = 1) AS flagged, max(n_chars) AS n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id""")
def reuse_index(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("doc_id").agg(F.sum("quality").alias("quality"), F.bool_or(F.col("toxic") == 1).alias("flagged"), F.max("n_chars").alias("n_chars"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id""")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("""SELECT 'F' AS level, count(*) AS n, count(DISTINCT o_custkey) AS ids, (SELECT count(DISTINCT o_custkey) FROM orders) - count(DISTINCT o_custkey) AS lacking FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'O', count(*), count(DISTINCT o_custkey), (SELECT count(DISTINCT o_custkey) FROM orders) - count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'P', count(*), count(DISTINCT o_custkey), (SELECT count(DISTINCT o_custkey) FROM orders) - count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P'""")
def level_agreement(spark: SparkSession, d: str) -> DataFrame:
    return quality.stages_agree(read(spark, d, "orders").select(F.col("o_orderstatus").alias("level"), "o_custkey"), "level", "o_custkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey % 5 END::DOUBLE + 0 AS wooded, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 4.0::DOUBLE ELSE s_suppkey % 5 + 4.0::DOUBLE END AS forest FROM supplier""")
def area_algebra(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    wooded = F.when(k % 3 == 0, 0.0).otherwise((k % 5).cast("double"))
    other = F.when((k % 3 == 0) & (k % 2 == 0), None).otherwise(4.0)
    return read(spark, d, "supplier").select(k, wooded.alias("wooded"), S.forest_area(wooded, other).alias("forest"))


@query()
def simplify_levels(spark: SparkSession, d: str) -> DataFrame:
    """Rings by part key at several tolerances: vertices, area error and Hausdorff distance."""
    k = F.col("p_partkey")
    at = lambda i: i * 0.4
    ring = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.array((10 + (k * i % 5) * 0.1) * F.cos(-at(i)), (10 + (k * i % 5) * 0.1) * F.sin(-at(i))))
    rows = read(spark, d, "part").select(k.alias("ident"), F.array(F.concat(ring, F.slice(ring, 1, 1))).alias("rings"))
    out = levels.sweep(rows, [0.0, 0.1, 0.5, 1.0])
    return out.groupBy("tolerance").agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.round(F.max("area_error"), 9).alias("worst_area"), F.round(F.max("hausdorff"), 9).alias("worst_distance"))


@query("WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS records, sum(n)::BIGINT AS entries, max(n)::INT AS most FROM n")
def xml_repeated_child(spark: SparkSession, d: str) -> DataFrame:
    """Reports as XML with repeated children, read back."""
    line = F.format_string("<monte><parte>%d</parte><valor>%s</valor></monte>", F.col("l_partkey"), F.col("l_quantity").cast("string"))
    reports = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("<Pif>"), F.array_join(F.array_sort(F.collect_list(line)), ""), F.lit("</Pif>")).alias("xml"))
    parsed = reports.select(F.from_xml("xml", F.lit("monte array<struct<parte:bigint,valor:double>>")).alias("r")).select("r.monte")
    return history.repeated_children(parsed, "monte")


@query("""SELECT source AS provenance, count(*) AS n, count(DISTINCT lang) = 1 AS agrees FROM documents GROUP BY 1""")
def provenance_catalog(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    got = writers.provenance(docs, "source", "lang").drop("lang")
    return got.join(docs.groupBy("source").agg(F.count("*").alias("n")), "source").withColumnRenamed("source", "provenance")


@query("""WITH y AS (SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_orderstatus) AS layers FROM orders WHERE year(o_orderdate) <> 1998 GROUP BY 1), a AS (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) FROM y) + 1))::INT AS year)
SELECT a.year, coalesce(layers, 0) AS layers, CASE WHEN layers IS NULL THEN 'gap' WHEN layers > 1 THEN 'repeated' END AS problem FROM a LEFT JOIN y USING (year)""")
def annual_layers(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").where(F.year("o_orderdate") != 1998).select(F.col("o_orderstatus").alias("layer_id"), F.concat(F.lit("Incendios "), F.year("o_orderdate")).alias("name")).distinct()
    return readers.annual_layers(rows)


from . import audits as _audits  # noqa: E402, F401  (the queries of both join these)
from . import records as _records  # noqa: E402, F401
