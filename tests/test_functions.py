"""Scalar and shape functions on small cases of their own."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.functions import scalars as S
from emberframe.functions import shapes
from emberframe.operators import vocab
from emberframe.sources import readers, writers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(("value", "want"), [("1.000,5", 1000.5), ("0,0068", 0.0068), ("", None), ("x", None), (None, None)])
def test_spanish_decimal(spark, value, want):
    assert one(spark, value, S.spanish_decimal) == want


@pytest.mark.parametrize(("value", "want"), [("0:71", True), ("14:59", False), ("24:00", True), ("9:05", False), ("", False), ("noon", True)])
def test_clock(spark, value, want):
    assert one(spark, value, S.clock_invalid) is want


@pytest.mark.parametrize(("value", "want"), [("Castelló", "castello"), ("Castellón/Castelló", "castellon"), ("Alacant", "alacant"), ("València", "valencia"), ("", "unknown"), (None, "unknown")])
def test_province_partition(spark, value, want):
    assert one(spark, value, S.province_partition) == want


def test_labels(spark):
    assert one(spark, "Col·legi  d'Elx", S.label) == "collegi d elx"
    assert one(spark, "Col·legi", S.alias) == "col legi"
    assert one(spark, "3/1/2025", lambda c: S.source_date(c).cast("string")) == "2025-01-03"
    assert one(spark, "1/1/25", lambda c: S.source_date(c).cast("string")) is None


def test_block_and_forest(spark):
    rows = spark.createDataFrame([(1993, 0.0, None), (2025, None, 0.0), (2030, 37.0, 363.0)], "y int, a double, b double")
    got = rows.select(S.temporal_block(F.col("y")), S.forest_area(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("1993-1999", None), ("2020-2024", 0.0), ("2030-2024", 400.0)]


def test_ring_signature():
    ring = [[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]]
    moved = [[1, 1], [1, 0], [0, 0], [0, 1], [1, 1]]
    assert shapes.ring_signature(ring) == shapes.ring_signature(moved) == shapes.ring_signature(ring[::-1])
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = list(rng.integers(0, 3, rng.integers(1, 9)))
        at = shapes.least_rotation(t)
        assert t[at:] + t[:at] == min(t[i:] + t[:i] for i in range(len(t)))


def test_validity():
    shell, hole = [[0, 0], [0, 9], [9, 9], [9, 0], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    assert shapes.reason([shell, hole]) == "valid"
    assert shapes.assigned([shell, hole]) == [-1, 0]
    assert shapes.reason([hole]) == "no_shell"
    assert shapes.reason([[[0, 0], [4, 4], [4, 0], [0, 2], [0, 0]]]) == "self_intersection"
    assert shapes.reason([[[0, 0], [1, 1]]]) == "too_few_positions"
    assert shapes.reason([[[0, 0], [0, 9], [9, 9], [9, 0]]]) == "unclosed"
    assert shapes.reason([[[0, 0], [1, 1], [2, 2], [0, 0]]]) == "zero_area"


def test_invalid_shapes():
    shell = [[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]]
    moved = lambda ring, dx, dy=0: [[x + dx, y + dy] for x, y in ring]
    hole = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    assert shapes.reason([shell, hole(2, 4)]) == "valid" and shapes.reason([shell, moved(shell, 20)]) == "valid"
    assert shapes.reason([shell, hole(8, 12)]) == "hole_crosses_ring"
    assert shapes.reason([shell, moved(shell, 5, 5)]) == "overlapping_shells"
    assert shapes.reason([shell, [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]]) == "nested_shells"
    assert shapes.reason([shell, hole(2, 8), [[4, 4], [4, 6], [6, 6], [6, 4], [4, 4]]]) == "valid"
    assert shapes.reason([[[0, 0], [0, 10], [0, 15], [0, 10], [10, 10], [10, 0], [0, 0]]]) == "self_intersection"
    assert shapes.reason([[[0, 0], [0, 10], [5, 0], [10, 10], [10, 0], [0, 0]]]) == "self_intersection"
    assert shapes.reason([[[0, 0], [0, 0], [0, 10], [10, 10], [10, 0], [0, 0]]]) == "valid"


def test_simplify_keeps_ends():
    ring = np.array([[np.cos(-a), np.sin(-a)] for a in np.linspace(0, 2 * np.pi, 100)])
    ring[-1] = ring[0]
    out = shapes.simplified(ring, 0.01)
    assert (out[0] == out[-1]).all() and 4 <= len(out) < 100
    assert shapes.hausdorff(ring, ring) == 0


def test_resolve(spark):
    names = spark.createDataFrame([("03065", "alicante", "Elx/Elche"), ("03139", "alicante", "la Vila Joiosa/Villajoyosa"), ("46001", "valencia", "Ademuz")], "id string, province string, name string")
    raw = spark.createDataFrame(
        [("Elx", "alicante", None), ("ELCHE", "alicante", None), ("Elche/Elx", "alicante", None), ("Elx", "valencia", None), ("Ademuz", None, None), ("x", "alicante", "03065"), ("", "alicante", None), (None, None, None)],
        "raw string, province string, source_id string",
    )
    got = {(r.raw, r.province): (r.id, r.method or r.status) for r in vocab.resolve(raw, names).collect()}
    assert got["Elx", "alicante"] == got["ELCHE", "alicante"] == ("03065", "official_alias")
    assert got["Elche/Elx", "alicante"] == ("03065", "official_bilingual_alias")
    assert got["Elx", "valencia"] == (None, "unresolved")
    assert got["Ademuz", None] == ("46001", "globally_unique_official_alias")
    assert got["x", "alicante"] == ("03065", "validated_source_identifier")
    assert got["", "alicante"] == (None, "missing")
    assert got[None, None] == (None, "missing")


def test_html_table(spark, tmp_path):
    (tmp_path / "a.html").write_text("<table><tr><td>no</td></tr></table><table id='t'><tr></tr><tr><th>Dia</th><th>B</th></tr><tr><td> 1 \n x</td><td>2</td></tr></table>")
    got = readers.html_table(spark, str(tmp_path / "a.html"), "t", ["Día", "B"]).collect()
    assert [(r["row_ix"], r["Día"], r["B"]) for r in got] == [(1, "1 x", "2")]
    with pytest.raises(ValueError, match="ragged"):
        readers.html_rows("<table id='t'><tr><td>a</td></tr><tr><td>1</td><td>2</td></tr></table>", "t", ["a"])
    with pytest.raises(ValueError, match="no rows"):
        readers.html_rows("<table id='t'><tr><td>a</td></tr></table>", "t", ["a"])
    with pytest.raises(ValueError, match="header"):
        readers.html_rows("<p>", "t", ["a"])


def test_snapshots_and_manifest(spark, tmp_path):
    path = str(tmp_path / "s")
    for k in (1, 2):
        writers.snapshot(spark.range(k), path, f"s{k}", f"2026-01-0{k}")
    assert writers.latest(spark, path).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        writers.snapshot(spark.range(1), path, "s1", "2026-02-01")
    (tmp_path / "f.txt").write_text("abc")
    row = readers.file_manifest(spark, str(tmp_path / "f.txt")).first()
    assert (row["bytes"], row["sha256"][:8]) == (3, "ba7816bf")


def test_strategies_are_written(spark, tmp_path):
    path = str(tmp_path / "level")
    stale = spark.createDataFrame([(1994, "Elx", 9)], "year int, province string, id int")
    rows = spark.createDataFrame([(1994, "Castelló", 3), (1999, "València", 1), (2026, "Castellón", 2)], "year int, province string, id int")
    for some in (stale, rows):
        writers.write_strategies(some, path, ["id"])
    for kind in ("json", "parquet"):
        got = {(r.strategy, str(r.partition)): r.n for r in spark.read.format(kind).load(f"{path}/{kind}").groupBy("strategy", "partition").count().withColumnRenamed("count", "n").collect()}
        assert got["all", "all"] == 3 and got["year", "2026"] == 1 and got["temporal_blocks", "1993-1999"] == 2
        assert got["province", "castellon"] == got["province", "castello"] == 1
        assert sum(n for (s, _), n in got.items() if s == "province_temporal_blocks") == 3
        assert not any("elx" in p for _, p in got)


def test_file_metrics(spark):
    text = "abc\n" * 500
    row = writers.file_metrics(spark.createDataFrame([("f", text)], "name string, content string")).first()
    assert (row["bytes"], row["gzip_bytes"]) == (2000, len(gzip.compress(text.encode(), 9, mtime=0)))
