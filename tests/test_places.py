"""Joins of points look at a place once, however many points share it."""

from pyspark.sql import functions as F

from emberframe.operators import linking, spatial

SQUARE = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]


def test_points_in_polygons(spark, monkeypatch):
    """60 points at 3 places and 40 equal squares with a smaller one: 2 + 1 pairs are tested, the least code is found."""
    points = spark.range(60).selectExpr("id as point_id", "double(id % 3 * 5) as px", "double(id % 3 * 5) as py")
    rings = spark.createDataFrame([(k, SQUARE) for k in range(7, 47)] + [(3, [(x / 2, y / 2) for x, y in SQUARE])], "code long, ring array<struct<x double, y double>>")
    tested, real = spark.sparkContext.accumulator(0), spatial.polygon_distances

    @F.udf("double")
    def passed(d):
        tested.add(1)
        return d

    monkeypatch.setattr(spatial, "polygon_distances", lambda *c: passed(real(*c)))
    got = {r.point_id: r.code for r in spatial.points_in_polygons(points, rings, 10.0).collect()}
    assert got == {i: (3, 7)[i % 3] for i in range(60) if i % 3 < 2}
    assert tested.value == 3


def test_near_points(spark):
    """100 points of one place near 50 of another: one distance for 5000 pairs."""
    left = spark.range(100).selectExpr("id", "0D as x", "0D as y")
    right = spark.range(50).selectExpr("id as k", "3D as rx", "4D as ry")
    found = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def gap(x, y, rx, ry):
        found.add(1)
        return ((x - rx) ** 2 + (y - ry) ** 2) ** 0.5

    got = linking.near_points(left, right, 5.0, gap("x", "y", "rx", "ry"), 10.0).collect()
    assert len({(r.id, r.k) for r in got}) == len(got) == 5000 and {r.distance for r in got} == {5.0}
    assert found.value < 10


def test_near_points_are_made_in_many_tasks(spark):
    """Tables of one file each, whose pairs are many more than their rows; null places have no pair."""
    left = spark.range(2000).selectExpr("id", "if(id = 7, null, double(id % 100)) as x", "0D as y").coalesce(1)
    right = spark.range(300).selectExpr("id as k", "double(id % 100) as rx", "if(id = 5, null, 0D) as ry", "string(id) as name").coalesce(1)
    gap = F.abs(F.col("x") - F.col("rx")) + F.abs(F.col("y") - F.col("ry"))
    got = linking.near_points(left, right, 1.0, gap, 2.0).withColumn("task", F.spark_partition_id()).collect()
    want = {(i, k) for i in range(2000) for k in range(300) if abs(i % 100 - k % 100) <= 1 and i != 7 and k != 5}
    assert len(got) == len(want) and {(r.id, r.k) for r in got} == want and all(r.name == str(r.k) and r.distance == abs(r.x - r.rx) for r in got)
    assert len({r.task for r in got}) > 8
    places = linking.near_points(left, right.select("rx", "ry"), 1.0, gap, 2.0)
    assert places.columns == ["x", "y", "id", "rx", "ry", "distance"] and places.count() == len(want)
