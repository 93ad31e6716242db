"""Multi-resolution products: tolerance sweeps, guarded levels, recommendations, partition sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.shapes import hausdorff_distance, simplify_rings
from .quality import quantiles


def _area(rings: str):  # noqa: ANN202
    return F.aggregate(F.transform(rings, lambda r: F.abs(G.signed_area(G.xy_ring(r)))), F.lit(0.0), lambda s, x: s + x)


def sweep(shapes: DataFrame, tolerances: list[float]) -> DataFrame:
    """ident, tolerance, vertices before and after, relative area error, Hausdorff distance. The tolerances are a short list.

    Equal rings are simplified once, in tasks whose number is not left to the size of the table, as Python has much work a row.
    """
    keyed = shapes.withColumn("key", F.sha2(F.to_json("rings"), 256))
    tasks = 4 * shapes.sparkSession.sparkContext.defaultParallelism
    alike = keyed.groupBy("key").agg(F.any_value("rings").alias("rings"))
    each = alike.withColumn("tolerance", F.explode(F.array(*(F.lit(float(t)) for t in tolerances)))).repartition(tasks)
    done = each.withColumn("simple", simplify_rings("rings", "tolerance"))
    done = done.withColumns({"area": _area("rings"), "simple_area": _area("simple"), "hausdorff": hausdorff_distance("rings", "simple")})
    found = done.select("key", "tolerance", G.vertex_count(F.col("rings")).alias("before"), G.vertex_count(F.col("simple")).alias("after"), F.try_divide(F.abs(F.col("simple_area") - F.col("area")), F.col("area")).alias("area_error"), "hausdorff", "simple", "rings")
    return keyed.select("ident", "key").join(found, F.lit(True) & keyed["key"].eqNullSafe(found["key"])).drop("key")


def level(shapes: DataFrame, tolerance: float, most_error: float) -> DataFrame:
    """ident, rings, guarded: simplified unless that changes the area too much."""
    got = sweep(shapes, [tolerance])
    keep = F.coalesce(F.col("area_error"), F.lit(1.0)) > most_error
    return got.select("ident", F.when(keep, F.col("rings")).otherwise(F.col("simple")).alias("rings"), keep.alias("guarded"))


def recommended(metrics: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """level, tolerance, vertices; a wanted tolerance that was not measured is an error in the row."""
    dim = metrics.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"(:l{i}, {float(t)}D)" for i, t in enumerate(wanted.values())) + " AS t(level, tolerance)", args={f"l{i}": k for i, k in enumerate(wanted)})
    sums = metrics.groupBy("tolerance").agg(F.sum("after").alias("vertices"))
    return dim.join(sums, "tolerance", "left").withColumn("problem", F.when(F.col("vertices").isNull(), "tolerance not measured"))


def partition_sizes(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count("*").alias("files"), F.sum(size).alias("total"), F.max(size).alias("largest"), F.min(size).alias("smallest"))
    middle = quantiles(rows.select(*by, F.col(size).cast("double").alias("value")), by, [0.5])
    same = F.lit(True)
    for c in by:
        same &= out[c].eqNullSafe(middle[c])
    return out.join(middle, same, "left").select(*(out[c] for c in by), "files", "total", "largest", "smallest", F.col("q0").alias("median"))
