"""Readers: feature sets, JSON lines, GeoJSON, HTML tables, zipped XML reports, dictionaries, manifests."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_SET = "geometryType string, spatialReference map<string,string>, features array<struct<attributes:map<string,string>,geometry:struct<rings:array<array<array<double>>>>>>"
GEOJSON = "type string, features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
#: Most bytes an archive may unpack to.
UNPACKED = 500 << 20


def feature_sets(spark: SparkSession, path: str) -> DataFrame:
    """file, attributes, rings of polygon feature sets; other geometry types are an error."""
    files = spark.read.schema(FEATURE_SET).json(path, multiLine=True, mode="FAILFAST")
    files = files.withColumn("file", F.col("_metadata.file_path"))
    checked = F.when(F.col("geometryType") == "esriGeometryPolygon", F.col("features")).otherwise(F.raise_error(F.concat(F.lit("no polygons: "), "file")))
    return files.select("file", F.explode(checked).alias("f")).select("file", "f.attributes", "f.geometry.rings")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; a bad line stops the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that are no record of the schema, with their file."""
    rows = spark.read.schema(f"{schema}, _bad string").json(path, columnNameOfCorruptRecord="_bad")
    return rows.select("*", F.col("_metadata.file_path").alias("file")).where("_bad is not null").select("file", "_bad")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, properties, type and coordinates (as JSON text) of features."""
    rows = spark.read.schema(GEOJSON).json(path, multiLine=True, mode="FAILFAST")
    return rows.select(F.explode("features").alias("f")).select("f.id", "f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


class _Table(HTMLParser):
    """The cells of the table with an id, white space collapsed."""

    def __init__(self, ident: str) -> None:
        super().__init__()
        self.ident, self.depth, self.rows, self.cell = ident, 0, [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table" and (self.depth or dict(attrs).get("id") == self.ident):
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
        elif self.depth and tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "table" and self.depth:
            self.depth -= 1


def html_rows(raw: str, ident: str, header: list[str]) -> list[list[str]]:
    """The rows below the header, without empty ones; a missing table, another header, no row or a ragged one is an error."""
    parser = _Table(ident)
    parser.feed(raw)
    ascii_of = lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()
    plain = lambda row: [re.sub(r"[^a-z0-9]+", " ", ascii_of(x)).strip() for x in row]
    found = [r for r in parser.rows if r]
    if not found or plain(found[0]) != plain(header):
        raise ValueError(f"table {ident}: the header differs")
    if not found[1:]:
        raise ValueError(f"table {ident}: no rows")
    if any(len(r) != len(header) for r in found[1:]):
        raise ValueError(f"table {ident}: a ragged row")
    return found[1:]


def html_table(spark: SparkSession, path: str, ident: str, header: list[str]) -> DataFrame:
    """file, row_ix (from 1) and the columns of header, all text, in source order."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["file"], batch["value"], strict=True):
                got = html_rows(raw, ident, header)
                yield pd.DataFrame([(name, i, *r) for i, r in enumerate(got, 1)], columns=["file", "row_ix", *header])

    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    schema = ", ".join(["file string", "row_ix long", *(f"`{h}` string" for h in header)])
    return pages.mapInPandas(rows, schema)


def zipped_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """file and xml of each row_tag element in zipped XML files; damaged or too large archives are an error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = re.compile(rf"<{row_tag}[\s>].*?</{row_tag}\s*>", re.S)
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if (bad := z.testzip()) or sum(i.file_size for i in z.infolist()) > UNPACKED:
                        raise ValueError(f"{name}: {bad or 'too large'}")
                    for entry in z.namelist():
                        found = cut.findall(z.read(entry).decode("utf-8"))
                        if found:
                            yield pd.DataFrame({"file": f"{name}/{entry}", "xml": found})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, xml string")


def dictionary(spark: SparkSession, path: str, resource: str, labels: list[str]) -> DataFrame:
    """code, label of SPARQL results: the last part of the URI, the first label that is not empty."""
    schema = "results struct<bindings:array<map<string,map<string,string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results.bindings").alias("b"))
    uri = F.rtrim(F.col("b")[resource]["value"], F.lit("/"))
    return rows.select(F.element_at(F.split(uri, "/"), -1).alias("code"), F.coalesce(*(F.nullif(F.col("b")[k]["value"], F.lit("")) for k in labels)).alias("label"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def annual_layers(layers: DataFrame) -> DataFrame:
    """year, layers, problem for layers(layer_id, name): one named layer per year, gaps and repeats told."""
    # fixed value: how the source titles a year's layer
    named = layers.select("layer_id", F.regexp_extract("name", r"^Incendios\s+((?:19|20)\d{2})\b", 1).try_cast("int").alias("year")).where("year is not null")
    counts = named.groupBy("year").agg(F.count("*").alias("layers"))
    axis = counts.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    out = axis.join(counts, "year", "left").na.fill(0, ["layers"])
    return out.withColumn("problem", F.when(F.col("layers") == 0, "gap").when(F.col("layers") > 1, "repeated"))


def schema_fingerprint(fields: DataFrame) -> DataFrame:
    """layer_id, sha256 of its ordered (name, type) pairs from fields(layer_id, place, name, type)."""
    got = fields.groupBy("layer_id").agg(F.array_sort(F.collect_list(F.struct("place", "name", "type"))).alias("fs"))
    return got.select("layer_id", F.sha2(F.to_json(F.transform("fs", lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type")))), 256).alias("schema_sha256"))
