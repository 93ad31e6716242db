"""Spatial joins by grid cells with an exact test after."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.shapes import polygon_distances


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """points(point_id, px, py) x polygons(code, ring) -> point_id, code: the smallest code that covers the point.

    A polygon goes to the cells its box meets, a point to its own cell: an equi join, not a nested loop. Points of one place
    are looked up once, and of equal rings only the one of the smallest code; the test runs over batches.
    """
    alike = polygons.withColumn("key", F.sha2(F.to_json("ring"), 256)).groupBy("key").agg(F.min_by("ring", "code").alias("ring"), F.min("code").alias("code"))
    boxed = alike.withColumn("box", G.bounds(F.col("ring")))
    step = lambda a, b: F.sequence(F.floor(F.col(f"box.{a}") / cell), F.floor(F.col(f"box.{b}") / cell))
    cells = boxed.select("code", "box", F.explode(step("min_x", "max_x")).alias("cx"))
    cells = cells.withColumn("cy", F.explode(step("min_y", "max_y")))
    placed = points.select("px", "py").distinct().withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    in_box = F.col("px").between(F.col("box.min_x"), F.col("box.max_x")) & F.col("py").between(F.col("box.min_y"), F.col("box.max_y"))
    # rings are fetched only for points in their box
    near = placed.join(cells, ["cx", "cy"]).where(in_box).select("px", "py", "code")
    hits = near.join(alike.select("code", "ring"), "code").where(polygon_distances("px", "py", "ring") == 0)
    found = hits.groupBy("px", "py").agg(F.min("code").alias("code"))
    return points.join(found, ["px", "py"]).groupBy("point_id").agg(F.min("code").alias("code"))


def within_radius(points: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """points(lon, lat) at most metres away, by a box that the scan can push down, then the great circle."""
    dlat = metres / 111000.0
    near = points.where(F.col("lat").between(lat - dlat, lat + dlat))
    if abs(lat) + dlat < 89:  # nearer to a pole every longitude may be in reach; the date line is not crossed by the box
        dlon = dlat / math.cos(math.radians(abs(lat) + dlat))
        if -180 <= lon - dlon and lon + dlon <= 180:
            near = near.where(F.col("lon").between(lon - dlon, lon + dlon))
    return near.withColumn("distance", G.haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))).where(F.col("distance") <= metres)
