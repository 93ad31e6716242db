"""Substring dedup: repeated windows of words are found by difference-cover anchors.

A set D of residues is a difference cover modulo v if every difference is one of two members. Short windows of
``length - v + 1`` words are hashed only where position mod v is in D. If two long windows (``length`` words) are equal,
some offset below v puts both at cover positions, so they share an aligned anchor. Hence:

1. Anchors: only anchor hashes that occur twice anywhere can lie in a repeated window (distributed count of hashes).
2. Extension: around such anchors all long windows are hashed with 96 bits over their whole word sequence, and the first
   of each (smallest doc_id, then smallest start) is found; every later one is marked and its words are removed.

Windows are judged on the input, not on what is left. Nothing is paired: both steps are counts over hashes. Each batch
of documents combines its own repeats first, so a passage that a third of all documents share sends one row per batch.
Hashes travel packed, by hash bucket, and a large bucket is ordered in parts, so that a task holds a bucket packed and one
part of it open; nothing is broadcast and nothing of the documents reaches the driver.

Defined results: a null text has no words. Texts of fewer than ``length`` words stay whole. Rows that repeat a doc_id
with the same text are one document and are treated alike; a row without doc_id can't be ordered, stays whole and
removes nothing. A doc_id stands for one text: further texts of the same id are taken as parts of that document. An
empty table gives no rows. Further columns pass through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, partitions
from .words import U64, Hasher, mixed, tokenised, windows

LENGTH = 20
#: A difference cover modulo 13 (a perfect difference set).
PERIOD, COVER = 13, (0, 1, 3, 9)
PACKED = "p int, kind int, data binary"
FOUND = "doc_id long, data binary"
MANY = 400_000
#: Places of one bucket that are ordered at once; a bucket of more is gone through several times, a part of its keys each.
AT_ONCE = 2_000_000


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length: sorted ids as differences, so that they compress."""
    head = np.array([len(columns[0])], np.int64).tobytes()
    return head + zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _length(data: bytes) -> int:
    return int(np.frombuffer(data[:8], np.int64)[0])


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n = _length(data)
    raw, at, out = zstandard.decompress(data[8:]), 0, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0))


def _first_of(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row is the first of its key (in the order of doc and start), and whether its key has more than one place."""
    order = np.lexsort((start, doc, *keys))
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    new[1:] = ~same
    group = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][group]
    at_head = (doc[order] == doc[head]) & (start[order] == start[head])
    away = np.add.reduceat(~at_head, np.flatnonzero(new)) if len(order) else np.empty(0, int)
    first, many = np.empty(len(order), bool), np.empty(len(order), bool)
    first[order], many[order] = at_head, away[group] > 0
    return first, many


def _by_document(doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(doc_id, sorted starts) of each document."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(doc)], strict=True):
        yield int(doc[a]), start[a:b].astype(np.uint32).tobytes()


def _sent(buckets: int, keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray, all_repeats: bool) -> Iterator[dict]:
    """Rows for the buckets: of each key the first place in this batch, and straight on what is known to repeat here.

    all_repeats: each place of a repeated key counts; else each but the first. The first of a key that repeats here is
    sent with a mark, as no other batch need hold the key for it to count.
    """
    first, many = _first_of(keys, doc, start)
    known = many & ~first
    for doc_id, places in _by_document(doc[known], start[known]):
        yield {"p": doc_id % buckets, "kind": 1, "data": np.int64(doc_id).tobytes() + places}
    doc, start, many = doc[first], start[first], many[first] & all_repeats
    keys = [k[first] for k in keys]
    bucket = (keys[0] % U64(buckets)).astype(np.int64)
    order = np.lexsort((start, doc, bucket))
    bucket, doc, start, many, keys = bucket[order], doc[order], start[order], many[order], [k[order] for k in keys]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)], strict=True):
        if b > a:
            k = [(x[a:b] // U64(buckets)) if i == 0 else x[a:b] for i, x in enumerate(keys)]
            rest = [(k[0] & U64(0xFFFFFFFF)).astype(np.uint32), (k[0] >> U64(32)).astype(np.uint16)]
            if len(keys) > 1:  # 96 bits: what 48 leave out, and 32 of another hash
                rest += [(k[0] >> U64(48)).astype(np.uint16), (k[1] & U64(0xFFFFFFFF)).astype(np.uint32)]
            yield {"p": int(bucket[a]), "kind": 0, "data": _pack(*rest, _deltas(doc[a:b]), start[a:b].astype(np.uint32), many[a:b])}


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row["data"]) + 100
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_PACKED = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])


def _gathered(docs: Iterator[tuple[int, list[np.ndarray], np.ndarray]], buckets: int, all_repeats: bool) -> Iterator[dict]:
    """docs: doc_id, key columns, starts. Sends them in lots of about MANY rows."""
    lots: list = []
    size = 0
    for doc_id, keys, start in docs:
        lots.append((keys, np.full(len(start), doc_id, np.int64), start))
        size += len(start)
        if size >= MANY:
            yield from _sent(buckets, *_joined(lots), all_repeats)
            lots, size = [], 0
    if size:
        yield from _sent(buckets, *_joined(lots), all_repeats)


def _joined(lots: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    keys = [np.concatenate(x) for x in zip(*(keys for keys, _, _ in lots), strict=True)]
    return keys, np.concatenate([d for _, d, _ in lots]), np.concatenate([s for _, _, s in lots])


def _anchors(buckets: int, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [Hasher(1)]
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        size = length - PERIOD + 1

        def docs() -> Iterator:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                for k, (h,) in tokenised(texts, hashers):
                    if len(h) >= length:
                        at = np.flatnonzero(cover[np.arange(len(h) - size + 1) % PERIOD])
                        yield ids[k], [windows(h, size)[at]], at

        yield from _batched(_gathered(docs(), buckets, True), _PACKED)

    return run


def _extended(buckets: int, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [Hasher(2), Hasher(3)]
        size = length - PERIOD + 1

        def docs() -> Iterator:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [zstandard.decompress(z) for z in batch.column(1).to_pylist()]
                found = batch.column(2).to_pylist()
                for k, hs in tokenised(texts, hashers):
                    n = len(hs[0]) - length + 1
                    if n <= 0:
                        continue
                    # a long window holds the anchors that start up to length - size behind its own start
                    at = np.frombuffer(b"".join(found[k]), np.uint32).astype(np.int64)
                    step = np.zeros(len(hs[0]) + 2, np.int32)
                    np.add.at(step, np.maximum(at - (length - size), 0), 1)
                    np.add.at(step, at + 1, -1)
                    start = np.flatnonzero(np.cumsum(step)[:n] > 0)
                    if len(start):
                        yield ids[k], [windows(h, length)[start] for h in hs], start

        yield from _batched(_gathered(docs(), buckets, False), _PACKED)

    return run


def _settled(two: bool) -> Callable:
    """One bucket at a time: which of the places sent belong to keys with more than one place (two: and are not the first)."""
    kinds = [np.uint32, np.uint16, *([np.uint16, np.uint32] if two else []), np.int64, np.uint32, np.bool_]

    def part(blocks: list[bytes], i: int, parts: int) -> Iterator[list[np.ndarray]]:
        for b in blocks:
            columns = _opened(b, kinds)
            here = columns[0] % np.uint32(parts) == i
            yield columns if parts == 1 else [c[here] for c in columns]

    def found(blocks: list[bytes]) -> Iterator[dict]:
        parts = -(-sum(_length(b) for b in blocks) // AT_ONCE)
        for i in range(parts):
            columns = [np.concatenate(c) for c in zip(*part(blocks, i, parts), strict=True)]
            *keys, doc, start, marked = columns
            first, many = _first_of(keys, doc, start)
            take = (many & ~first) if two else (many | marked)
            for doc_id, places in _by_document(doc[take], start[take].astype(np.int64)):
                yield {"doc_id": doc_id, "data": places}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, blocks = None, []
        for batch in batches:
            for p, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 1:
                    yield {"doc_id": int(np.frombuffer(data[:8], np.int64)[0]), "data": data[8:]}
                    continue
                if p != now and blocks:
                    yield from found(blocks)
                    blocks = []
                now = p
                blocks.append(data)
        if blocks:
            yield from found(blocks)

    return lambda batches: _batched(rows(batches), _FOUND)


def _opened(data: bytes, kinds: list[type]) -> list[np.ndarray]:
    columns = _unpack(data, *kinds)
    columns[-3] = np.cumsum(columns[-3])
    return columns


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack.compress(t) for t in texts], pa.binary())], names=["row_id", "doc_id", "z"])


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row_id (an id or null), doc_id, z (the text, packed), starts: packed lists of the starts of windows to remove."""
    if length < PERIOD:
        raise ValueError(f"length must be {PERIOD} or more")
    buckets = 4 * partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sent = rows.where("doc_id is not null").mapInArrow(_anchors(buckets, length), PACKED)
    shared = sent.repartition("p").sortWithinPartitions("p").mapInArrow(_settled(False), FOUND)
    shared = shared.groupBy("doc_id").agg(F.collect_list("data").alias("anchors"))
    packed = rows.select(F.col("doc_id").alias("row_id"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text")
    packed = packed.mapInArrow(_compressed, "row_id long, doc_id long, z binary")
    asked = packed.where("row_id is not null").join(shared, "doc_id").select("doc_id", "z", "anchors")
    sent = asked.mapInArrow(_extended(buckets, length), PACKED)
    later = sent.repartition("p").sortWithinPartitions("p").mapInArrow(_settled(True), FOUND)
    later = later.groupBy("doc_id").agg(F.collect_list("data").alias("starts"))
    return packed.join(later.withColumnRenamed("doc_id", "row_id"), "row_id", "left")


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, list]]:
    """For each batch its ids and (number of words, kept words joined by one space)."""
    for batch in batches:
        out = []
        for z, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = zstandard.decompress(z).split()
            n = len(words)
            if starts:
                step = np.zeros(n + length + 1, np.int32)
                at = np.frombuffer(b"".join(starts), np.uint32).astype(np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + length, -1)
                stays = np.flatnonzero(np.cumsum(step)[:n] == 0)
                words = [words[i] for i in stays]
            out.append((n, len(words), b" ".join(words)))
        yield batch.column(0), out


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _kept(batches, length):
            columns = [ids, pa.array([n for n, _, _ in rows], pa.int64()), pa.array([n - m for n, m, _ in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for _, _, t in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated(docs, length).select("row_id", "z", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with text replaced by its kept words, joined by one space, where something is removed; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _kept(batches, length):
            yield pa.RecordBatch.from_arrays([ids, pa.array([t.decode() for _, _, t in rows], pa.string())], names=["k_id", "k_text"])

    changed = repeated(docs, length).where("starts is not null").select("row_id", "z", "starts").mapInArrow(run, "k_id long, k_text string").dropDuplicates(["k_id"])
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    out = docs.toDF(*names).join(changed, F.col("doc_id") == F.col("k_id"), "left")
    return out.withColumn("text", F.coalesce("k_text", "text")).select(*names).toDF(*docs.columns)


by_value(__name__)
