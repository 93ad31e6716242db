"""Hierarchical reports: leaf paths, sparse schema matrix, counts with totals, threshold audits, repeated children."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import lexical_type


def leaf_paths(rows: DataFrame, ident: str, json: str) -> DataFrame:
    """ident, path, value for the top-level members of JSON objects; nested ones keep their JSON as value."""
    parsed = rows.select(ident, F.from_json(json, "map<string,string>").alias("m"))
    return parsed.select(ident, F.explode("m").alias("path", "value"))


LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def _leaves(value, path: str = "") -> Iterator[tuple[str, str | None]]:  # noqa: ANN001
    """Objects add their keys to the path, lists do not; a number or a truth value is told as JSON writes it."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{k}" if at else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(at, x) for x in reversed(v)]
        else:
            yield at, v if v is None or isinstance(v, str) else json.dumps(v)


@F.pandas_udf(LEAVES)
def json_leaves(texts: pd.Series) -> pd.Series:
    """(path, value) of every leaf of a JSON text, in source order; what is no JSON has none."""

    def of(t: str | None) -> list[tuple]:
        try:
            return [] if t is None else list(_leaves(json.loads(t)))
        except ValueError:
            return []

    return texts.map(of)


def without_keys(keys: list[str]) -> Callable:
    """A function of a JSON text: canonical (keys sorted) and without these keys, at any depth; null if it is no JSON."""
    drop = set(keys)

    def strip(v):  # noqa: ANN001, ANN202
        if isinstance(v, dict):
            return {k: strip(x) for k, x in v.items() if k not in drop}
        return [strip(x) for x in v] if isinstance(v, list) else v

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(strip(json.loads(t)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return _scalar(one)


def _scalar(one: Callable) -> Callable:
    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return of


def deep_paths(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, path, value for every leaf of JSON texts, at any depth."""
    return rows.select(ident, F.explode(json_leaves(F.col(text))).alias("leaf")).select(ident, "leaf.path", "leaf.value")


def schema_matrix(paths: DataFrame, group: str, ident: str) -> DataFrame:
    """path, group, records with a value, types seen."""
    out = paths.where("value is not null").groupBy("path", group).agg(F.count_distinct(ident).alias("records"), F.array_sort(F.collect_set(lexical_type(F.col("value")))).alias("types"))
    return out.select("path", group, "records", F.array_join("types", ",").alias("types"))


def counters(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Counts of flags by keys and in all, in one pass."""
    out = rows.groupingSets([[F.col(k) for k in keys], []], *keys)
    return out.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()), (F.grouping(keys[0]) == 1).alias("total"))


def threshold_audit(rows: DataFrame, keys: list[str], a: Column, b: Column, limit: float) -> DataFrame:
    """Groups in which two area definitions give different numbers of large rows."""
    out = rows.groupBy(*keys).agg(F.count_if(a >= limit).alias("by_first"), F.count_if(b >= limit).alias("by_second"))
    return out.where("by_first <> by_second")


def repeated_children(rows: DataFrame, children: str) -> DataFrame:
    """Records with a child, entries, most per record."""
    n = F.coalesce(F.size(children), F.lit(0))
    return rows.agg(F.count_if(n > 0).alias("records"), F.sum(n).alias("entries"), F.max(n).alias("most"))


def coverage(rows: DataFrame, by: Column, visible: list[str], day: str, area: str) -> DataFrame:
    """group, n, distinct visible rows, first and last day, area with null as 0."""
    return rows.groupBy(by.alias("group")).agg(
        F.count("*").alias("n"), F.count_distinct(F.struct(*visible)).alias("visible"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.round(F.sum(F.coalesce(area, F.lit(0.0))), 4).alias("area")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package
