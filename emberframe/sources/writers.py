"""Writers: partitioned products, feature collections, audit CSV, snapshots with a pointer."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The ways in which a level is cut into files.
STRATEGIES = ["all", "year", "temporal_blocks", "province", "province_temporal_blocks"]


def partitioned(rows: DataFrame, path: str, by: list[str], order: list[str], kind: str = "parquet") -> None:
    """One sorted run per partition value; stale partitions are replaced. Rows of one value may take several files."""
    spread = rows.repartition(*by).sortWithinPartitions(*by, *order)
    spread.write.mode("overwrite").partitionBy(*by).format(kind).save(path)


def by_strategy(rows: DataFrame, strategies: list[str] = STRATEGIES) -> DataFrame:
    """rows(year, province, ..) once per strategy, with strategy and partition: the name of the file that holds the row."""
    block, province = S.temporal_block(F.col("year")), S.province_partition(F.col("province"))
    keys = {
        "all": F.lit("all"), "year": F.col("year").cast("string"), "temporal_blocks": block, "province": province,
        "province_temporal_blocks": F.concat_ws("/", province, block),
    }
    cuts = F.array(*(F.struct(F.lit(s).alias("strategy"), keys[s].alias("partition")) for s in strategies))
    return rows.select("*", F.inline(cuts))


def write_strategies(rows: DataFrame, path: str, order: list[str], kinds: tuple[str, ...] = ("json", "parquet"), strategies: list[str] = STRATEGIES) -> None:
    """rows(year, province, ..) below path/<format>, by strategy and partition, sorted by order; stale files go first."""
    cut = by_strategy(rows, strategies)
    for kind in kinds:
        partitioned(cut, f"{path}/{kind}", ["strategy", "partition"], order, kind)


def feature(ident: Column, properties: Column, kind: Column, coordinates: Column) -> Column:
    """A GeoJSON feature as text; coordinates are JSON already."""
    return F.concat(
        F.lit('{"type":"Feature","id":'), F.to_json(F.array(ident)).substr(F.lit(2), F.length(F.to_json(F.array(ident))) - 2),
        F.lit(',"properties":'), F.to_json(properties, {"ignoreNullFields": "false"}), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"),
    )


def feature_collections(rows: DataFrame, by: list[str], one: str) -> DataFrame:
    """by, content: one collection per partition of features in column one; partitions are chosen to fit a file."""
    body = F.array_join(F.array_sort(F.collect_list(one)), ",")
    return rows.groupBy(*by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("content"))


def compact_features(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """by, content: a field list and positional arrays."""
    values = F.to_json(F.array(*(F.col(f).cast("string") for f in fields)), {"ignoreNullFields": "false"})
    head = '{"fields":[' + ",".join(f'"{f}"' for f in fields) + '],"rows":['
    return rows.groupBy(*by).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(values)), ","), F.lit("]}")).alias("content"))


def audit_csv(rows: DataFrame, path: str) -> None:
    """Arrays of texts joined by |, other nested values as JSON."""
    flat = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        flat.append((F.array_join(c, "|") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c).alias(name))
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)


def snapshot(rows: DataFrame, path: str, snapshot_id: str, updated_at: str) -> None:
    """An immutable snapshot: an existing one is never replaced. The newest in the log is the current one."""
    spark = rows.sparkSession
    rows.write.mode("errorifexists").parquet(f"{path}/snapshot_id={snapshot_id}")
    spark.createDataFrame([(snapshot_id, updated_at)], "snapshot_id string, updated_at string").coalesce(1).write.mode("append").json(f"{path}/_log")


def latest(spark, path: str) -> DataFrame:  # noqa: ANN001
    log = spark.read.schema("snapshot_id string, updated_at string").json(f"{path}/_log")
    newest = log.agg(F.max_by("snapshot_id", "updated_at")).first()[0]
    return spark.read.parquet(f"{path}/snapshot_id={newest}")


def file_metrics(files: DataFrame) -> DataFrame:
    """name, bytes, gzip_bytes (level 9, no time stamp), sha256 of files(name, content) held as text."""

    @F.pandas_udf("long")
    def packed(content: pd.Series) -> pd.Series:
        return content.map(lambda text: len(gzip.compress(text.encode(), 9, mtime=0)))

    return files.select("name", F.octet_length("content").alias("bytes"), packed("content").alias("gzip_bytes"), F.sha2("content", 256).alias("sha256"))


def provenance(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, agrees: one row per provenance."""
    return rows.groupBy(key).agg(F.min(value).alias(value), (F.count_distinct(F.struct(value)) == 1).alias("agrees"))
