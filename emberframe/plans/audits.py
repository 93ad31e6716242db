"""Queries on profiles, shapes, schemas, validation and scalar rules. Each beside its SQL.

Rules of single values are tested on lists of hard cases, whose expected results are told from the rules, not computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..functions import shapes
from ..operators import history, linking, profiles, quality, validation, views
from ..sources import readers, writers
from .catalog import POINTS, RECORDS, points, query, read, records


def told(v: object) -> str:
    """A value as a literal of DuckDB."""
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if v is None or isinstance(v, bool):
        return "NULL" if v is None else str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(names: str, cases: list[tuple]) -> str:
    """The cases as DuckDB SQL."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(told(v) for v in c) + ")" for c in cases) + f") t({names})"


def cases_of(spark: SparkSession, schema: str, cases: list[tuple]) -> DataFrame:
    """A short list as a literal relation."""
    names = [c.split()[0] for c in schema.split(", ")]
    args = {f"v{i}_{k}": v for i, c in enumerate(cases) for k, v in enumerate(c)}
    rows = ", ".join("(" + ", ".join(f":v{i}_{k}" for k in range(len(c))) + ")" for i, c in enumerate(cases))
    out = spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(names)})", args=args)
    return out.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))


# --- dates, numbers, identifiers

_DATES = [(1, "3/4/2001", "2001-04-03", "2001-04-03", None, None), (2, " 2001-4-3 ", "2001-04-03", None, "2001-04-03", None), (3, "31/02/2001", None, None, None, "unparsed date: 31/02/2001"), (4, "", None, None, None, None), (5, None, None, None, None, None), (6, "2001-04-03T10:00:00Z", None, None, "2001-04-03", "unparsed date: 2001-04-03T10:00:00Z")]


@query(values("k, source_date, spanish_date, perimeter_date, error", [(k, a, b, c, e) for k, _, a, b, c, e in _DATES]))
def date_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return cases_of(spark, "k int, t string", [c[:2] for c in _DATES]).select(
        "k", S.source_date(t).cast("string").alias("source_date"), S.spanish_date(t).cast("string").alias("spanish_date"), S.perimeter_date(F.trim(t)).cast("string").alias("perimeter_date"), S.date_error(t).alias("error"),
    )


@query("SELECT event_id, epoch_ms(date_trunc('second', ts)) // 1000 AS at FROM events")
def instants(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return read(spark, d, "events").select("event_id", F.unix_timestamp(S.instant(t)).alias("at"))


_NAMES = [(1, "Alacant/Alicante", "alicante", "alicante", "alacant-alicante"), (2, "CASTELLÓ", "castellon", "castellon", "castello"), (3, "València", "valencia", "valencia", "valencia"), (4, "Teruel", None, None, "teruel"), (5, "", None, None, "unknown"), (6, None, None, None, "unknown"), (7, "Vall de Alicante", "alicante", "valencia", "vall-de-alicante")]


@query(values("k, key, canonical, slug", [(k, a, b, c) for k, _, a, b, c in _NAMES]))
def province_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return cases_of(spark, "k int, t string", [c[:2] for c in _NAMES]).select("k", S.province_key(t).alias("key"), S.canonical_province(t).alias("canonical"), S.slug(t).alias("slug"))


@query("""SELECT event_id, 'x:' || substr(sha256(event_type || '|' || CASE WHEN user_id % 3 = 0 THEN 'None' ELSE user_id::VARCHAR END), 1, 12) AS hashed, 'int:' || user_id AS as_int, 'str:{"v":"' || user_id || '"}' AS as_text,
 'gva:geometry:' || url_encode(event_type || ' /' || user_id) AS named, replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM events""")
def identifier_forms(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    return read(spark, d, "events").select(
        "event_id", S.hash_id("x:", 12, F.col("event_type"), F.when(u % 3 != 0, u)).alias("hashed"), S.typed_key(u, "int").alias("as_int"), S.typed_key(u.cast("string"), "str").alias("as_text"),
        S.namespaced_id("gva:geometry:", F.concat("event_type", F.lit(" /"), u)).alias("named"), S.html_escaped(F.col("props")).alias("escaped"),
    )


_RAMP = [(1990, "#000000"), (1995, "#0a1428"), (2000, "#0a1428"), (1985, "#000000"), (1992, "#040810")]


@query(values("year, colour", _RAMP))
def year_colours(spark: SparkSession, d: str) -> DataFrame:
    return cases_of(spark, "year int", [c[:1] for c in _RAMP]).select("year", S.year_ramp(F.col("year"), 1990, 1995, (0, 0, 0), (10, 20, 40)).alias("colour"))


_GIF = [(1, "icv", 500.0, 0.0, True), (2, "icv", 499.9, 900.0, False), (3, "icv", None, 900.0, False), (4, "sigif", 900.0, 499.0, False), (5, "sigif", None, 500.0, True), (6, "effis", 900.0, 900.0, False), (7, "sigif", 1.0, None, False)]


@query(values("k, is_gif", [(c[0], c[4]) for c in _GIF]))
def large_fires(spark: SparkSession, d: str) -> DataFrame:
    return cases_of(spark, "k int, source string, forest double, total double", [c[:4] for c in _GIF]).select("k", S.gif(F.col("source"), F.col("forest"), F.col("total")).alias("is_gif"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'c:' || o_custkey ELSE 'raw:' || o_orderstatus || ':' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') END AS key, coalesce(o_totalprice >= 200000, false) AS large FROM orders""")
def municipality_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    key = views.municipality_key(F.when(c % 3 == 0, F.concat(F.lit("c:"), c)), F.col("o_orderstatus"), S.slug(F.col("o_orderpriority")))
    return read(spark, d, "orders").select("o_orderkey", key.alias("key"), (F.col("o_totalprice") >= 200000).alias("large"))


# --- shapes

_S = [[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]]
_HOLE = [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]
_U = [[0, 0], [0, 10], [3, 10], [3, 2], [7, 2], [7, 10], [10, 10], [10, 0], [0, 0]]
_SHAPES: list[tuple[str, list, str]] = [  # name, rings, validity
    ("square", [_S], "valid"), ("holed", [_S, _HOLE], "valid"), ("concave", [_U], "valid"), ("bow tie", [[[0, 0], [4, 4], [4, 0], [0, 2], [0, 0]]], "self_intersection"), ("open", [[[0, 0], [0, 9], [9, 9], [9, 0]]], "unclosed"),
    ("flat", [[[0, 0], [1, 1], [2, 2], [0, 0]]], "zero_area"), ("short", [[[0, 0], [1, 1]]], "too_few_positions"), ("hole alone", [_HOLE], "no_shell"), ("far hole", [_S, [[20, 20], [24, 20], [24, 24], [20, 24], [20, 20]]], "orphan_hole"),
    ("crossing hole", [_S, [[8, 8], [12, 8], [12, 12], [8, 12], [8, 8]]], "hole_crosses_ring"), ("two", [_S, [[5, 5], [5, 15], [15, 15], [15, 5], [5, 5]]], "overlapping_shells"), ("nested", [_S, [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]], "nested_shells"),
    ("spike", [[[0, 0], [0, 10], [0, 15], [0, 10], [10, 10], [10, 0], [0, 0]]], "self_intersection"), ("none", [], "empty"), ("repeat", [[[0, 0], [0, 0], [0, 10], [10, 10], [10, 0], [0, 0]]], "valid"),
]


def _shapes(spark: SparkSession) -> DataFrame:
    ring = lambda r: "array(" + ", ".join(f"array({float(x)}D, {float(y)}D)" for x, y in r) + ")"
    rows = ", ".join(f"('{n}', CAST(array({', '.join(ring(r) for r in rings)}) AS array<array<array<double>>>))" for n, rings, _ in _SHAPES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, rings)")


@query(values("name, reason", [(n, v) for n, _, v in _SHAPES]))
def shape_validity(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark).select("name", shapes.validity_reason("rings").alias("reason"))


@query("SELECT * FROM (VALUES ('valid', 4), ('self_intersection', 2), ('unclosed', 1), ('zero_area', 1), ('too_few_positions', 1), ('no_shell', 1), ('orphan_hole', 1), ('hole_crosses_ring', 1), ('overlapping_shells', 1), ('nested_shells', 1), ('empty', 1)) t(reason, n)")
def topology_audit(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark).groupBy(shapes.validity_reason("rings").alias("reason")).agg(F.count("*").alias("n"))


@query(values("name, owners", [("square", "-1"), ("holed", "-1,0"), ("hole alone", "-2"), ("far hole", "-1,-2"), ("two", "-1,-1")]))
def hole_owners(spark: SparkSession, d: str) -> DataFrame:
    rows = _shapes(spark).where(F.col("name").isin("square", "holed", "hole alone", "far hole", "two"))
    return rows.select("name", F.array_join(F.transform(shapes.hole_owners("rings"), lambda x: x.cast("string")), ",").alias("owners"))


_RECORDS = [("square", 5, 4, True, 0, "clockwise"), ("open", 4, 4, False, 0, "clockwise"), ("hole alone", 5, 4, True, 0, "counterclockwise"), ("repeat", 6, 4, True, 1, "clockwise"), ("flat", 4, 3, True, 0, "none"), ("short", 2, 2, False, 0, "none")]


@query(values("name, positions, distinct_vertices, closed, repeats, orientation", _RECORDS))
def ring_records(spark: SparkSession, d: str) -> DataFrame:
    rows = _shapes(spark).where(F.col("name").isin([r[0] for r in _RECORDS]))
    return rows.select("name", G.ring_record(G.xy_ring(F.get("rings", F.lit(0)))).alias("r")).select("name", "r.*")


@query("SELECT * FROM (VALUES (15::BIGINT, 19::BIGINT, 17::BIGINT, 2::BIGINT, 1::BIGINT)) t(shapes, rings, closed, open, repeats)")
def structure_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counters over all rings; shapes without rings count as shapes."""
    rings = _shapes(spark).select("name", F.explode_outer("rings").alias("ring"))
    r = F.when(F.col("ring").isNotNull(), G.ring_record(G.xy_ring(F.col("ring"))))
    rows = rings.select("name", r.alias("r"))
    return rows.agg(F.count_distinct("name").alias("shapes"), F.count("r").alias("rings"), F.count_if(F.col("r.closed")).alias("closed"), F.count_if(~F.col("r.closed")).alias("open"), F.sum(F.coalesce("r.repeats", F.lit(0))).alias("repeats"))


@query(values("name, x, y", [("square", 5.0, 5.0), ("concave", 1.5, 5.0), ("hole alone", 3.0, 3.0)]))
def representative_points(spark: SparkSession, d: str) -> DataFrame:
    rows = _shapes(spark).where(F.col("name").isin("square", "concave", "hole alone"))
    return rows.select("name", G.representative_point(G.xy_ring(F.get("rings", F.lit(0)))).alias("p")).select("name", "p.x", "p.y")


_THIN = "array(array(array(0D, 0D), array(0D, 1e-7D), array(1e-7D, 1e-7D), array(1e-7D, 0D), array(0D, 0D)))"
_DUST = "array(array(array(0D, 0D), array(0D, 1e-12D), array(1e-12D, 1e-12D), array(1e-12D, 0D), array(0D, 0D)))"


@query(values("name, decimals, x", [("plain", 6, 1.234568), ("thin", 9, 1e-7), ("dust", None, 1e-12)]))
def adaptive_rounding(spark: SparkSession, d: str) -> DataFrame:
    """x: of the third position."""
    plain = "array(array(array(0D, 0D), array(0D, 1D), array(1.2345678D, 1D), array(1D, 0D), array(0D, 0D)))"
    rows = spark.sql(f"SELECT * FROM VALUES ('plain', {plain}), ('thin', {_THIN}), ('dust', {_DUST}) AS t(name, rings)")
    return rows.select("name", shapes.rounded("rings").alias("r")).select("name", "r.decimals", F.col("r.rings")[0][2][0].alias("x"))


@query(f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey * 271 % 900 AS x, s_suppkey * 613 % 900 AS y FROM supplier) SELECT k, x <= 260 AND x + 60 >= 200 AND y <= 260 AND y + 60 >= 200 AS meets FROM s""")
def polygons_that_meet(spark: SparkSession, d: str) -> DataFrame:
    """Squares against one fixed square; touching counts."""
    s = F.col("s_suppkey")
    x, y = (s * 271 % 900).cast("double"), (s * 613 % 900).cast("double")
    corner = lambda a, b: F.array(a, b)
    ring = F.array(*(corner(x + a, y + b) for a, b in ((0, 0), (60, 0), (60, 60), (0, 60), (0, 0))))
    fixed = F.array(*(F.array(F.lit(200.0 + a), F.lit(200.0 + b)) for a, b in ((0, 0), (60, 0), (60, 60), (0, 60), (0, 0))))
    return read(spark, d, "supplier").select(s.alias("k"), shapes.polygons_meet(ring, fixed).alias("meets"))


@query(f"""WITH {POINTS}, s AS (SELECT s_suppkey AS k, (s_suppkey * 271 % 900)::DOUBLE AS x, (s_suppkey * 613 % 900)::DOUBLE AS y FROM supplier) SELECT point_id, k, round(sqrt(pow(px - x, 2) + pow(py - y, 2)), 6) AS distance FROM points JOIN s ON sqrt(pow(px - x, 2) + pow(py - y, 2)) <= 80""")
def near_points(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    right = read(spark, d, "supplier").select(s.alias("k"), (s * 271 % 900).cast("double").alias("rx"), (s * 613 % 900).cast("double").alias("ry"))
    left = points(spark, d).withColumnsRenamed({"px": "x", "py": "y"})
    gap = F.sqrt(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2))
    return linking.near_points(left, right, 80.0, gap, 80.0, 6).select("point_id", "k", "distance")


# --- schemas of nested records

_NESTED = """'{"a":{"k":' || event_id || ',"t":"' || event_type || '"},"l":[{"x":1},{"x":null},{"y":{"z":true}}],"id":' || event_id || '}'"""


def _nested(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"a":{"k":'), "event_id", F.lit(',"t":"'), "event_type", F.lit('"},"l":[{"x":1},{"x":null},{"y":{"z":true}}],"id":'), "event_id", F.lit("}"))
    return read(spark, d, "events").select("event_id", "event_type", text.alias("j"))


@query("""SELECT event_type, path, n * k AS leaves, n * m AS with_value, n AS records, kind AS types FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), (VALUES ('a.k', 1, 1, 'integer'), ('a.t', 1, 1, 'string'), ('l.x', 2, 1, 'integer'), ('l.y.z', 1, 1, 'boolean'), ('id', 1, 1, 'integer')) v(path, k, m, kind)""")
def deep_json_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = _nested(spark, d)
    leaves = history.deep_paths(rows, "event_id", "j").join(rows.select("event_id", "event_type"), "event_id")
    out = leaves.groupBy("event_type", "path").agg(F.count("*").alias("leaves"), F.count("value").alias("with_value"), F.count_distinct("event_id").alias("records"), F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), S.lexical_type(F.col("value"))))).alias("types"))
    return out.withColumn("types", F.array_join("types", ","))


@query("""SELECT sha256('{"a":{"t":"' || event_type || '"},"l":[{"x":1},{"x":null},{"y":{"z":true}}]}') AS fingerprint, count(*) AS n FROM events GROUP BY event_type""")
def identity_free_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).groupBy(F.sha2(history.without_keys(["id", "k"])("j"), 256).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS first, CASE WHEN event_id % 3 = 0 THEN event_type END AS t FROM events""")
def nested_first(spark: SparkSession, d: str) -> DataFrame:
    """A path through lists takes their first elements; empty lists and missing members give null."""
    e = F.col("event_id")
    j = F.when(e % 3 == 0, F.concat(F.lit('{"m":[{"n":['), e, F.lit(',9],"t":"'), "event_type", F.lit('"}]}'))).when(e % 3 == 1, '{"m":[]}').otherwise("{}")
    m = F.get(F.from_json(j, "m array<struct<n:array<bigint>,t:string>>")["m"], F.lit(0))
    return read(spark, d, "events").select("event_id", F.get(m["n"], F.lit(0)).alias("first"), m["t"].alias("t"))


@query("""WITH e AS (SELECT event_type, value::INT AS v, min(event_id) AS pos FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY pos) AS n FROM e) SELECT event_type, string_agg(v::VARCHAR, ',' ORDER BY pos) AS examples FROM r WHERE n <= 3 GROUP BY 1""")
def first_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_type", "event_id", F.rint("value").cast("int").alias("v"))
    return validation.first_examples(rows, ["event_type"], "v", "event_id")


# --- profiles

_CATALOG = [("icv", True, 1993, 2024), ("sigif", True, 2025, 2026), ("effis", False, 2025, 2026)]


def _sources(spark: SparkSession) -> DataFrame:
    return cases_of(spark, "source string, publishable boolean, year_min int, year_max int", _CATALOG)


@query("SELECT * FROM (VALUES ('effis', 'not publishable'), ('other', 'unknown source')) t(source, problem)")
def profile_guard(spark: SparkSession, d: str) -> DataFrame:
    return profiles.blocked(_sources(spark), ["icv", "effis", "other"], "public")


@query("SELECT 1993 AS year_min, 2026 AS year_max, 'icv,sigif' AS sources, 2025 AS default_year")
def profile_composition(spark: SparkSession, d: str) -> DataFrame:
    return profiles.composition(_sources(spark), ["icv", "sigif"], 2025)


_KINDS = ["icv_web", "sigif_points", "effis_perimeters", "link_candidates_visible"]


@query("SELECT n_nationkey, ['icv_web', 'sigif_points', 'effis_perimeters', 'link_candidates_visible'][n_nationkey % 4 + 1] AS kind FROM nation WHERE n_nationkey % 4 IN (0, 1)")
def profile_assets(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*(F.lit(k) for k in _KINDS)), (F.col("n_nationkey") % 4).cast("int"))
    return profiles.assets_of(read(spark, d, "nation").select("n_nationkey", kind.alias("kind")), ["icv", "sigif"])


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS sigif_records, max(o_totalprice) AS coverage_complete FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1")
def profile_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("sigif_records"), F.min("o_custkey").alias("effis_features"), F.max("o_totalprice").alias("coverage_complete"))
    return profiles.covering(rows.select(*profiles.coverage_columns(rows.columns, ["sigif"])), 1996, 1999)


@query("SELECT event_id, event_type = 'error' AND ts::DATE > DATE '2024-01-20' AS late FROM events")
def late_satellite(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("event_type") == "error", "effis").otherwise("sigif")
    return read(spark, d, "events").select("event_id", profiles.late_satellite(F.to_date("ts"), source, "2024-01-20").alias("late"))


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'icv' WHEN 'O' THEN 'sigif' ELSE 'effis' END AS source, CASE o_orderstatus WHEN 'P' THEN 'g' || o_orderkey ELSE o_orderkey::VARCHAR END AS entity, CASE o_orderstatus WHEN 'O' THEN o_orderkey::VARCHAR ELSE 'g' || o_orderkey END AS geometry, year(o_orderdate)::INT AS year,
 CASE WHEN o_orderkey % 3 = 0 THEN 'N' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'R' || o_custkey ELSE 'M' || o_custkey END AS municipality, 'P' || o_custkey % 3 AS province, CASE WHEN o_orderstatus <> 'P' THEN 'at ' || o_custkey END AS place_name,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderstatus <> 'P' THEN 'old' END AS cause, o_orderdate::DATE AS day, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 1 END AS end_date, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice / 100 END AS area,
 o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 AND o_totalprice / 100 >= 500 AS is_gif FROM orders""")
def record_view(spark: SparkSession, d: str) -> DataFrame:
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    area = F.when(k % 7 != 0, F.col("o_totalprice") / 100)
    o = read(spark, d, "orders").select(
        F.col("o_orderstatus").alias("s"), k.cast("string").alias("entity"), F.concat(F.lit("g"), k).alias("geometry"), F.year(day).alias("year"), F.when(k % 3 == 0, F.concat(F.lit("N"), c)).otherwise("").alias("municipality_name"),
        F.when(k % 3 == 1, F.concat(F.lit("R"), c)).alias("municipality_raw"), F.concat(F.lit("M"), c).alias("municipality"), F.concat(F.lit("P"), c % 3).alias("province"), F.concat(F.lit("at "), c).alias("place_name"),
        F.when(k % 2 == 0, F.col("o_orderpriority")).alias("cause_label"), F.lit(None).cast("string").alias("cause_raw"), F.lit("old").alias("cause"), day.alias("day"), day.alias("start_date"), F.date_add(day, 1).alias("end_date"), F.date_add(day, 1).alias("final_date"),
        area.alias("forest_area"), area.alias("reported_area"), area.alias("mapped_area"),
    )
    part = lambda s: o.where(F.col("s") == s)
    return profiles.record_view(part("F"), part("O"), part("P"))


# --- validation and sets

@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'no status' END, CASE WHEN o_totalprice > 300000 THEN 'too dear' END) AS errors, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE '' END AS warnings, NOT (o_orderkey % 4 = 0 OR o_totalprice > 300000) AS accepted FROM orders""")
def judged_features(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
    out = validation.judged(rows, {"no status": F.col("o_orderstatus").isNull(), "too dear": F.col("o_totalprice") > 300000}, {"low": F.col("o_orderpriority") == "5-LOW"})
    return out.select("o_orderkey", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "accepted")


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE sha256(coalesce(text, '') || 'x') END AS stored, sha256(coalesce(text, '')) AS found FROM documents WHERE doc_id % 9 = 0 OR doc_id % 10 = 0")
def checksum_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Digests of whole texts; every tenth is stored wrongly, every ninth not at all."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    rows = read(spark, d, "documents").select("doc_id", t.alias("t"), F.when(k % 9 != 0, F.sha2(F.when(k % 10 == 0, F.concat(t, F.lit("x"))).otherwise(t), 256)).alias("stored"))
    return validation.checksum_breaks(rows, "doc_id", F.col("t"), "stored")


@query("SELECT r_name, y::INT AS year FROM region, unnest(range(1994, 2004)) t(y) WHERE (r_name, y) NOT IN (SELECT r_name, year(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
def missing_partitions(spark: SparkSession, d: str) -> DataFrame:
    expected = read(spark, d, "region").select("r_name", F.explode(F.sequence(F.lit(1994), F.lit(2003))).alias("year"))
    return validation.missing_partitions(records(spark, d).select(F.col("province").alias("r_name"), "year"), expected, ["r_name", "year"])


@query(r"""SELECT page_id, 'url' AS "column" FROM pages WHERE regexp_matches(url, '[?&]utm_') UNION ALL SELECT page_id, 'html' FROM pages WHERE regexp_matches(html, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')""")
def public_text_leaks(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pages")
    return validation.leaks(rows, "page_id", ["url"], r"[?&]utm_").union(validation.leaks(rows, "page_id", ["html"], r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_orderkey::VARCHAR AS t, l_suppkey AS layer FROM lineitem GROUP BY ALL) SELECT layer, k, row_number() OVER (PARTITION BY layer ORDER BY k) AS by_number, row_number() OVER (PARTITION BY layer ORDER BY t) AS by_text FROM r""")
def numeric_and_text_order(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("layer"), F.col("l_orderkey").alias("k")).distinct()
    place = lambda c: F.row_number().over(Window.partitionBy("layer").orderBy(c)).cast("long")
    return rows.select("layer", "k", place(F.col("k")).alias("by_number"), place(F.col("k").cast("string")).alias("by_text"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents), f AS (SELECT doc_id, line, min(i) AS i FROM l GROUP BY ALL) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS lines FROM f GROUP BY 1""")
def ordered_distinct_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return read(spark, d, "documents").select("doc_id", F.md5(F.array_join(validation.ordered_distinct(lines), "\n")).alias("lines"))


@query("SELECT year, count(*) AS n, count(flag) AS with_flag, count(priority) AS with_priority FROM (SELECT year(o_orderdate)::INT AS year, o_orderstatus AS flag, NULL AS priority FROM orders WHERE year(o_orderdate) < 1998 UNION ALL SELECT year(o_orderdate), NULL, o_orderpriority FROM orders WHERE year(o_orderdate) >= 1998) GROUP BY year")
def annual_union(spark: SparkSession, d: str) -> DataFrame:
    """Layers whose columns vary by year, united by name."""
    o = read(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    old, new = o.where("year < 1998").select("year", F.col("o_orderstatus").alias("flag")), o.where("year >= 1998").select("year", F.col("o_orderpriority").alias("priority"))
    return old.unionByName(new, allowMissingColumns=True).groupBy("year").agg(F.count("*").alias("n"), F.count("flag").alias("with_flag"), F.count("priority").alias("with_priority"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AS complete FROM orders GROUP BY 1")
def superset_check(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return held.select("o_custkey", validation.superset(F.col("s"), ["F", "O"]).alias("complete"))


@query("""WITH v AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1) SELECT o_custkey, v[1] AS least, round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 6) AS middle, v[len(v) // 2 + 1] AS upper_middle, v[-1] AS most, round(list_avg(v), 6) AS mean FROM v""")
def repetitions(spark: SparkSession, d: str) -> DataFrame:
    return validation.repetitions(read(spark, d, "orders"), "o_custkey", "o_totalprice")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 8 = 0) AS missing, round(100.0 * count(*) FILTER (WHERE o_orderkey % 8 = 0) / count(*), 4) AS percent FROM orders""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return quality.completeness(read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderstatus")).otherwise(" ").alias("c")), "c")


@query("""WITH i AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id // 2 END AS k FROM events) SELECT problem, n AS "count" FROM (SELECT 'missing id' AS problem, count(*) - count(k) AS n FROM i UNION ALL SELECT 'repeated id', count(k) - count(DISTINCT k) FROM i UNION ALL SELECT 'row count', 1) WHERE n > 0""")
def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return quality.unique_ids(read(spark, d, "events").select(F.when(e % 10 != 0, F.floor(e / 2)).alias("k")), "k", 7)


@query("""SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'unexpected' WHEN doc_id % 5 = 0 THEN 'size' WHEN doc_id % 3 = 0 THEN 'checksum' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0""")
def file_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Texts stand for files; what each lacks goes by its number."""
    k = F.col("doc_id")
    rows = read(spark, d, "documents").select(k, F.concat(F.lit("d"), k).alias("name"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    files = rows.where(k % 7 != 0).drop("doc_id")
    manifest = rows.where((k % 11 != 0) | (k % 7 == 0)).select("name", F.when(k % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(k % 3 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    return quality.reconcile(manifest, files)


@query("""SELECT coalesce(a.y, b.y)::INT AS year, a.n AS first, b.n AS second, CASE WHEN a.n IS NULL THEN 'only second' WHEN b.n IS NULL THEN 'only first' WHEN a.n <> b.n THEN 'differ' END AS problem
 FROM (SELECT year(o_orderdate) AS y, count(DISTINCT o_orderstatus) AS n FROM orders WHERE year(o_orderdate) > 1995 GROUP BY 1) a FULL JOIN (SELECT year(l_shipdate) AS y, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1) b ON a.y = b.y""")
def layer_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two inventories of yearly layers against each other."""
    a = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_orderstatus").alias("first")).where("year > 1995")
    b = read(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count_distinct("l_linestatus").alias("second"))
    bad = F.when(F.col("first").isNull(), "only second").when(F.col("second").isNull(), "only first").when(F.col("first") != F.col("second"), "differ")
    return a.join(b, "year", "full").select("year", "first", "second", bad.alias("problem"))


@query("""SELECT n_regionkey AS layer_id, sha256('[' || string_agg('{"name":"' || n_name || '","type":"t' || n_nationkey % 3 || '"}', ',' ORDER BY n_nationkey) || ']') AS schema_sha256 FROM nation GROUP BY 1""")
def schema_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "nation").select(F.col("n_regionkey").alias("layer_id"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"), F.concat(F.lit("t"), F.col("n_nationkey") % 3).alias("type"))
    return readers.schema_fingerprint(rows)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey IN (1, 2) AND 1990 + n_nationkey + 4 >= 2000 AND 1990 + n_nationkey <= 2005")
def assets_for_view(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    assets = read(spark, d, "nation").select(k, F.when(k % 2 == 0, "local").otherwise("overview").alias("level"), F.col("n_regionkey").cast("string").alias("province"), (k + 1990).alias("block_start"), (k + 1994).alias("block_end"))
    return views.assets_for(assets, "local", ["1", "2"], 2000, 2005).select("n_nationkey")


@query("""WITH c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS again, value > 300 AS far FROM events) SELECT count(*) AS n, count(*) FILTER (WHERE again) AS repeated, count(*) FILTER (WHERE far) AS far FROM c""")
def row_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """How many rows repeat an earlier one, lie out of range, and in all: counted by group first, no window needed."""
    per = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 300).alias("far"))
    return per.agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("far").alias("far"))


@query(f"""WITH {RECORDS}, r AS (SELECT year + (entity % 3 * 10)::INT AS year, trim(regexp_replace(lower(province), '[^a-z0-9]+', '-', 'g'), '-') AS p, entity, area FROM records),
b AS (SELECT *, CASE WHEN year < 2000 THEN '1993-1999' ELSE (year // 10 * 10) || '-' || least(year // 10 * 10 + 9, 2024) END AS b FROM r)
SELECT s AS strategy, CASE s WHEN 'all' THEN 'all' WHEN 'year' THEN year::VARCHAR WHEN 'temporal_blocks' THEN b WHEN 'province' THEN p ELSE p || '/' || b END AS partition, count(*) AS n, min(entity) AS first
FROM b, unnest(['all', 'year', 'temporal_blocks', 'province', 'province_temporal_blocks']) u(s) GROUP BY 1, 2""")
def partition_strategies(spark: SparkSession, d: str) -> DataFrame:
    """What each strategy puts into each file."""
    rows = records(spark, d).select((F.col("year") + (F.col("entity") % 3 * 10).cast("int")).alias("year"), "province", "entity")
    return writers.by_strategy(rows).groupBy("strategy", "partition").agg(F.count("*").alias("n"), F.min("entity").alias("first"))


@query("""SELECT o_orderkey, '{"a":[{"p":"' || o_orderstatus || '","q":null},null],"m":{"k1":{"x":1,"y":' || o_custkey || '},"k2":null},"z":{"b":' || o_orderkey || ',"c":"' || o_orderpriority || '"}}' AS json FROM orders""")
def canonical_nested(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON whose keys are in name order at every depth, whatever the order of the columns."""
    rows = read(spark, d, "orders").select(
        F.struct(F.col("o_orderpriority").alias("c"), F.col("o_orderkey").alias("b")).alias("z"),
        F.array(F.struct(F.lit(None).cast("string").alias("q"), F.col("o_orderstatus").alias("p")), F.lit(None)).alias("a"),
        F.create_map(F.lit("k2"), F.lit(None), F.lit("k1"), F.struct(F.col("o_custkey").alias("y"), F.lit(1).alias("x"))).alias("m"),
    )
    return rows.select(F.col("z.b").alias("o_orderkey"), S.canonical_rows(rows).alias("json"))
