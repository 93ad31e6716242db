"""WARC: reading records, and resolving not-modified revisits.

A revisit record of the server-not-modified profile (without a profile: of status 304) has no body. It is resolved to the latest earlier full response of the same canonical url
(an as-of join), if its validators agree: an ETag decides, by weak comparison; without one Last-Modified must be equal;
with neither there is nothing to check and the revisit counts as unchecked. Revisits of other profiles (identical
payloads, found by their digest and not by the server) are no not-modified answers: their result is ``other_profile``. The headers of the resolved response are
those stored, with the fields that a 304 may update taken from the revisit.

The as-of join is two-level, so that a url with a third of all records is never one task's work: time is cut into
blocks; the last response of each (url, block) is aggregated; a running last over a url's blocks gives what each block
starts with; inside a block records are ordered by time. Only those inner orderings hold records.

Defined results: a revisit without an earlier response is ``unresolved``; one whose validators differ is ``mismatch``;
both have no response. Records of the same time are ordered responses first, then by record id. Null urls or times never
match. A revisit without status and profile counts as not modified. Null headers are an empty map; fields of any length
are kept whole. Repeated rows are records of their own. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value

#: Header fields that a 304 response may update (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
RECORD = "file string, record_id string, kind string, profile string, url string, time timestamp, status int, headers map<string,string>, body binary"
#: Fixed value: how the profile of a not-modified revisit ends (WARC 1.0 and 1.1).
NOT_MODIFIED = "/revisit/server-not-modified"


def _head(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """First line, fields and rest of a header block; field names in lower case, repeated fields joined."""
    top, _, rest = block.partition(b"\r\n\r\n")
    first, *lines = top.split(b"\r\n")
    fields: dict[str, str] = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name = name.strip().lower()
        fields[name] = f"{fields[name]}, {value.strip()}" if name in fields else value.strip()
    return first, fields, rest


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC stream, one at a time; a truncated last record ends the stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        top = b""
        while (line := stream.readline()) not in (b"\r\n", b""):
            top += line
        _, fields, _ = _head(b"WARC\r\n" + top)
        size = int(fields.get("content-length", "0") or 0)
        body = stream.read(size)
        if len(body) < size:
            return
        yield fields, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files (plain or gzip), a file to a task.

    Spark reads a file as one value, so that it opens whatever Spark can open; a file is thus at most 2 GB (the usual size is
    1 GB) and is in a task's memory whole, decompressed a record at a time.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                for fields, body in parse_records(stream):
                    if (kind := fields.get("warc-type")) not in ("response", "revisit"):
                        continue
                    first, headers, payload = _head(body)
                    status = first.split(b" ")[1:2]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": [name], "record_id": [fields.get("warc-record-id")], "kind": [kind], "profile": pa.array([fields.get("warc-profile", "").strip("<>") or None], pa.string()), "url": [fields.get("warc-target-uri", "").strip("<>") or None],
                            "time": pa.array([fields.get("warc-date")], pa.string()), "status": pa.array([int(status[0]) if status and status[0].isdigit() else None], pa.int32()),
                            "headers": pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), "body": pa.array([payload], pa.binary()),
                        }
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(rows, RECORD.replace("time timestamp", "time string"))
    return out.withColumn("time", F.try_to_timestamp("time"))


def canonical(rows: DataFrame) -> DataFrame:
    """Adds canonical_url to rows(url): scheme dropped, host lower-cased without www. and default port, no fragment,
    parameters sorted without tracking ones, no slash at the end."""
    rest = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract("rest", r"^[^/?]*", 0)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract("rest", r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract("rest", r"\?(.*)$", 1), "&", -1)
    kept = F.sort_array(F.filter(query, lambda p: (p != "") & ~p.rlike(r"^(?:utm_[a-z]+|ref|fbclid|gclid)=")))
    parts = rows.withColumn("rest", rest).select(*rows.columns, host.alias("host"), path.alias("path"), F.array_join(kept, "&").alias("query"))
    tail = F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise("")
    return parts.select(*rows.columns, F.when(F.col("host") != "", F.concat("host", "path", tail)).alias("canonical_url"))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def validated(old: Column, new: Column) -> Column:
    """ok, mismatch or unchecked, from the headers of a response and of a revisit."""
    by_tag = F.when(_weak(old["etag"]) == _weak(new["etag"]), "ok").otherwise("mismatch")
    by_date = F.when(old["last-modified"] == new["last-modified"], "ok").otherwise("mismatch")
    return F.when(new["etag"].isNotNull(), by_tag).when(new["last-modified"].isNotNull(), by_date).otherwise("unchecked")


def merged(old: Column, new: Column) -> Column:
    """The stored headers, updated by the fields of the revisit that may update them."""
    fresh = F.map_filter(new, lambda k, v: k.isin(PERMITTED))
    stale = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return F.map_concat(stale, fresh)


def resolve(records: DataFrame, block: str = "day") -> DataFrame:
    """One row per revisit of records(record_id, kind, url, time, status, headers, and profile if there is one).

    Returns record_id, canonical_url, time, response_id, response_time, result, headers. block: the unit of time of a block,
    to be chosen so that a url's records in one block fit a task.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    profile = F.col("profile") if "profile" in records.columns else F.lit(None).cast("string")
    asks = F.coalesce(profile.endswith(NOT_MODIFIED), F.coalesce("status", F.lit(304)) == 304)
    rows = records.select("record_id", "kind", "url", "time", "status", F.coalesce("headers", empty).alias("headers"), asks.alias("asks"))
    rows = canonical(rows).drop("url")
    rows = rows.withColumn("block", F.date_trunc(block, "time"))
    full = (F.col("kind") == "response") & (F.coalesce("status", F.lit(200)) == 200) & F.col("time").isNotNull()
    response = F.struct("time", "record_id", "headers")
    rows = rows.withColumn("found", F.when(full, response))
    lasts = rows.where(full).groupBy("canonical_url", "block").agg(F.max_by("found", F.struct("time", "record_id")).alias("last"))
    asked = rows.where(F.col("kind") == "revisit").select("canonical_url", "block").distinct()
    blocks = asked.join(lasts, ["canonical_url", "block"], "full")
    before = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("from_before", F.last("last", ignorenulls=True).over(before)).select("canonical_url", "block", "from_before")
    within = Window.partitionBy("canonical_url", "block").orderBy("time", F.col("kind") == "revisit", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("here", F.last("found", ignorenulls=True).over(within)).where(F.col("kind") == "revisit")
    out = inner.join(starts, ["canonical_url", "block"], "left")
    hit = F.coalesce("here", "from_before")
    hit = F.when(F.col("asks") & F.col("canonical_url").isNotNull() & F.col("time").isNotNull(), hit)
    out = out.select("record_id", "canonical_url", "time", "headers", "asks", hit.alias("hit"))
    check = F.when(~F.col("asks"), "other_profile").when(F.col("hit").isNull(), "unresolved").otherwise(validated(F.col("hit.headers"), F.col("headers")))
    out = out.withColumn("result", F.when(check == "ok", "resolved").otherwise(check))
    good = F.col("result").isin("resolved", "unchecked")
    return out.select(
        "record_id", "canonical_url", "time",
        F.when(good, F.col("hit.record_id")).alias("response_id"), F.when(good, F.col("hit.time")).alias("response_time"), "result",
        F.when(good, merged(F.col("hit.headers"), F.col("headers"))).alias("headers"),
    )


by_value(__name__)
