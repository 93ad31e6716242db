"""MinHash near-dedup: many universal hash minima with banding, signature verification, exact confirmation, components.

A document's set holds its distinct runs of ``shingle`` words (A-Z lower-cased); with fewer words the whole sequence is
its one member; without words the set is empty and linked with nothing. Two documents are linked if
100 * |intersection| >= percent * |union|. Every link is confirmed on the full sets; sets of 64-bit hashes of whole
shingles (keyed SipHash of every word) stand for the sets. Minima are those of a*x + b modulo 2^32 (a odd).

Documents with the same set are one class; only its smallest id goes on. Within a bucket nothing is paired in full:

1. Coarse bands (32 of 4 minima). Each member of a bucket is paired with the smallest id of it. Pairs whose signatures
   (256 minima, 8 bits of each) agree enough are confirmed on the full sets; confirmed links form components by
   alternating large-star and small-star.
2. Fine bands (100 of 8 further minima), only for members of coarse buckets that still hold several components: coarse
   buckets also gather documents that share a passage, fine ones hardly any below a similarity of 0.5.
3. Fine buckets with several components are the rest. There members of different components are compared by signature,
   in tiles; components that may be linked are tied into clusters. Within a cluster members of different components whose
   signatures agree enough are compared by their full sets, in tiles; only links that connect components are given out.

So every pair that shares a fine bucket is linked, known to be connected, or rejected on its signature or full sets; no
bucket or partner is capped and no list of pairs is written. The largest component of a bucket or cluster is never
compared with itself: with k other members, a bucket of m rows sends m * ceil(k / TILE) + k * ceil(m / TILE) rows, which
is in proportion to m as long as few members are unconnected. Tiles are bounded in rows and bytes and dealt by key and
tile. What grows faster is only a group of very many documents that are pairwise similar at about 0.6 to 0.8 and yet not
connected: these pairs have to be compared. Every intermediate table is removed when its successor is written.

At a similarity of 0.8, for independent hash functions, a pair is missed by the coarse bands with a probability of 4.8e-8,
by the fine ones with 1.0e-8 and by the test of signatures with 1.5e-10: 5.8e-8 in all.

Defined results: a null text has an empty set. A row without doc_id has no component and is kept. Rows that repeat a
doc_id with the same text are one node; if a doc_id has several texts, each row goes by its own text, and of sets whose
smallest id is the same only that of the smallest digest is compared, the others follow it. An empty table gives no
rows. Further columns pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, by_value, hot_join, narrowed, released, written
from .components import components
from .words import U64, Hasher, mixed, series, tokenised, windows

SHINGLE, PERCENT = 5, 80
MINIMA, ROWS, BANDS = 256, 4, 32
FINE_ROWS, FINE_BANDS = 8, 100
#: A tile holds two blocks of about so many members and so many bytes of sets each.
TILE, TILE_BYTES = 4096, 8 << 20
#: Pairs whose signatures agree in less than this part are not tested on their full sets (different minima agree in their
#: 8 bits once in 256 times).
AGREE = 0.63
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SIGNED = "row_id long, doc_id long, n_shingles long, digest binary, agree binary, bands array<long>"
FULL = "id long, n_shingles long, agree binary, items binary, fine array<long>"


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a word sequence."""
    if len(h) == 0:
        return h
    if len(h) < size:
        return windows(h, len(h)) ^ U64(len(h))
    return np.unique(windows(h, size))


class _Minima:
    """The first n minima of a family of universal hash functions."""

    def __init__(self, n: int = MINIMA, seed: int = 11) -> None:
        self.n = n
        self.a = (series(seed, n) >> U64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (series(seed + 1, n) >> U64(32)).astype(np.uint32)

    def of(self, items: np.ndarray) -> np.ndarray:
        x = (items >> U64(32)).astype(np.uint32)
        out = np.full(self.n, 0xFFFFFFFF, np.uint32)
        step = (1 << 19) // self.n
        for k in range(0, len(x), step):
            part = np.multiply.outer(x[k : k + step], self.a)
            part += self.b
            np.minimum(out, part.min(axis=0), out=out)
        return out


def bands_of(minima: np.ndarray, size: int = ROWS, n: int = BANDS) -> np.ndarray:
    """One 64-bit value for each band."""
    rows = minima[: n * size].reshape(n, size).astype(U64)
    out = mixed(np.arange(1, n + 1, dtype=U64))
    for k in range(size):
        out = mixed(out ^ rows[:, k])
    return out


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(b) for b in parts)]).astype(np.int32)), flat)


def _sets(batch: pa.RecordBatch, text_at: int, hashers: list[Hasher], size: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = [t.translate(_LOWER) for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
    for k, (h,) in tokenised(texts, hashers):
        yield k, shingle_set(h, size)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row_id (an id or null), doc_id, n_shingles, digest of the set, agree (8 bits of each minimum), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, minima = [Hasher(5)], _Minima()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n, digest, agree, bands = [], [], [], []
                for _, items in _sets(batch, 1, hashers, shingle):
                    m = minima.of(items)
                    n.append(len(items))
                    digest.append(_digest(items))
                    agree.append(m.astype(np.uint8).tobytes())
                    bands.append(bands_of(m) if len(items) else np.empty(0, U64))
                ids = batch.column(0)
                columns = [ids, ids.fill_null(-1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(agree, pa.binary()), _lists(bands)]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", "n_shingles", "digest", "agree", "bands"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SIGNED)


def _full(docs: DataFrame, asked: DataFrame, shingle: int, fine: bool) -> DataFrame:
    """id, n_shingles, agree, items (the full set as packed sorted hashes), fine (the fine bands, if wanted) of asked.

    asked(doc_id, digest, n_shingles, agree): each doc_id once; rows of the same id with another set are left out. An inner
    join, as a semi join would be pushed below the narrowing.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, minima = [Hasher(5)], _Minima(FINE_ROWS * FINE_BANDS, 21)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                digests, keep, items, bands = batch.column(2).to_pylist(), [], [], []
                for k, x in _sets(batch, 1, hashers, shingle):
                    if _digest(x) == digests[k]:
                        keep.append(k)
                        items.append(x.tobytes())
                        bands.append(bands_of(minima.of(x), FINE_ROWS, FINE_BANDS) if fine else np.empty(0, U64))
                kept = [batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 3, 4)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(items, pa.binary()), _lists(bands)], names=["id", "n_shingles", "agree", "items", "fine"])

    texts = narrowed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", asked.select("doc_id"))
    rows = texts.join(asked, "doc_id").select("doc_id", "text", "digest", "n_shingles", "agree")
    return rows.mapInArrow(hashed, FULL).dropDuplicates(["id"])


def _from_hubs(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """pairs(u, v) with the columns of left(u, ..); u may be paired with very many."""
    return hot_join(pairs, left, "u", pairs.groupBy("u").agg(F.count("*").alias("n_rows")), F.xxhash64("v"))


def _confirmed(docs: DataFrame, near: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) of documents that are linked, by their full sets; a table."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    asked = near.join(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "doc_id")
    items = written(_full(docs, asked, shingle, False).select("id", "items"), "minhash-sets")
    left = items.select(F.col("id").alias("u"), F.col("items").alias("x"))
    right = items.select(F.col("id").alias("v"), F.col("items").alias("y"))
    full = _from_hubs(pairs, left).join(right, "v").select("u", "v", "x", "y")
    out = written(full.mapInArrow(linked, "u long, v long"), "minhash-links")
    released(items)
    return out


def _agreeing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""
    left = nodes.select(F.col("doc_id").alias("u"), F.col("n_shingles").alias("nu"), F.col("agree").alias("au"))
    right = nodes.select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("nv"), F.col("agree").alias("av"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, MINIMA) for i in (2, 3))
            ok = (a == b).mean(axis=1) >= AGREE
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok))

    fit = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    return _from_hubs(pairs, left).join(right, "v").where(fit).select("u", "v", "au", "av").mapInArrow(run, "u long, v long")


class _Groups:
    """Union-find over the components in a tile."""

    def __init__(self, labels: np.ndarray) -> None:
        self.names, self.own = np.unique(labels, return_inverse=True)
        self.root = np.arange(len(self.names))

    def of(self) -> np.ndarray:
        """The current group of each member."""
        return self.root[self.own]

    def merge(self, i: int, j: int) -> None:
        a, b = self.root[self.own[i]], self.root[self.own[j]]
        self.root[self.root == b] = a


def _tiled(members: DataFrame, key: str, solve: Callable[[dict, np.ndarray, np.ndarray], Iterator[tuple[int, int]]]) -> DataFrame:
    """u, v: what solve gives for each tile of members(key, doc_id, component, ..) with the same key; a table.

    The members outside the largest component of a key are dealt to blocks, and so are those inside it. A tile holds two
    blocks, or one, not both of the largest component; every two members that are not both in it meet in one tile. solve
    gets the columns of a tile, and the places of its left and right block (the same ones for one block).
    """
    size = F.octet_length("items") if "items" in members.columns else F.lit(0)
    sums = members.groupBy(key, "component").agg(F.count("*").alias("m"), F.sum(size).alias("size"))
    most = F.max(F.struct("m", F.col("component").alias("c"), "size")).alias("most")
    sums = sums.groupBy(key).agg(most, F.sum("m").alias("m"), F.sum("size").alias("size"))
    blocks = lambda m, size: F.greatest(F.ceil(m / TILE), F.ceil(size / TILE_BYTES)).cast("int")
    sums = sums.select(
        key, F.col("most.c").alias("large"), blocks(F.col("most.m"), F.col("most.size")).alias("inner"),
        blocks(F.col("m") - F.col("most.m"), F.col("size") - F.col("most.size")).alias("outer"),
    ).where("outer > 0")
    # one row per key on this side, so it can be repeated for salts: a key with a third of all members is no one task's work
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = salted.join(sums, [key, "salt"]).withColumn("within", F.col("component") == F.col("large"))
    h = F.xxhash64("doc_id")
    rows = rows.withColumn("own", F.when(F.col("within"), F.col("outer") + F.pmod(h, "inner")).otherwise(F.pmod(h, "outer")).cast("int"))
    last = F.when(F.col("within"), F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    names = [key, "low", "high", "own", *(c for c in members.columns if c != key)]

    def tile(group: list[tuple]) -> Iterator[tuple[int, int]]:
        columns = dict(zip(names, zip(*group, strict=True), strict=True))
        own, low, high = np.array(columns["own"]), columns["low"][0], columns["high"][0]
        yield from solve(columns, np.flatnonzero(own == low), np.flatnonzero(own == high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        found: set = set()

        def out() -> pa.RecordBatch:
            both = sorted(found)
            return pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in both], pa.int64()), "v": pa.array([p[1] for p in both], pa.int64())})

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                for row in zip(*(c.to_pylist() for c in whole.slice(at, 1000).columns), strict=True):
                    if row[:3] != now:
                        if len(group) > 1:
                            found.update(tile(group))
                        if len(found) > 100_000:
                            yield out()
                            found = set()
                        now, group = row[:3], []
                    group.append(row)
        if len(group) > 1:
            found.update(tile(group))
        yield out()

    dealt = rows.select(*names).repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")
    return written(dealt.mapInArrow(run, "u long, v long").distinct(), f"minhash-{key}-ties")


def _alike(columns: dict, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Given a member and others, those whose sizes and signatures allow a link."""
    n = np.array(columns["n_shingles"])
    sig = np.frombuffer(b"".join(columns["agree"]), np.uint8).reshape(-1, MINIMA)

    def of(i: int, js: np.ndarray) -> np.ndarray:
        js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
        return js[(sig[js] == sig[i]).mean(axis=1) >= AGREE] if len(js) else js

    return of


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """u, v: ties between components that share a bucket and may be linked, as few as connect them.

    members(bucket, doc_id, component, n_shingles, agree).
    """

    def solve(columns: dict, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        ids, groups, alike = columns["doc_id"], _Groups(np.array(columns["component"])), _alike(columns, percent)
        for i in left:
            while True:
                group = groups.of()
                js = alike(i, right[group[right] != group[i]])
                if not len(js):
                    break
                for g in np.unique(group[js], return_index=True)[1]:
                    groups.merge(i, js[g])
                    yield ids[i], ids[js[g]]

    return _tiled(members, "bucket", solve)


def _linked(members: DataFrame, percent: int) -> DataFrame:
    """u, v: confirmed links between components in a cluster, as few as connect what is linked.

    members(cluster, doc_id, component, n_shingles, agree, items).
    """

    def solve(columns: dict, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        ids, groups, alike = columns["doc_id"], _Groups(np.array(columns["component"])), _alike(columns, percent)
        sets = [np.frombuffer(x, U64) for x in columns["items"]]
        for i in left:
            group = groups.of()
            js = alike(i, right[group[right] != group[i]])
            for at in range(0, len(js), 256):
                some = js[at : at + 256]
                sizes = np.array([len(sets[j]) for j in some])
                every = np.concatenate([sets[j] for j in some])
                place = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
                both = np.add.reduceat(sets[i][place] == every, np.r_[0, np.cumsum(sizes)[:-1]])
                for j in some[100 * both >= percent * (sizes + len(sets[i]) - both)]:
                    if groups.of()[j] != groups.of()[i]:
                        groups.merge(i, j)
                        yield ids[i], ids[j]

    return _tiled(members, "cluster", solve)


def _several(members: DataFrame, key: str) -> DataFrame:
    """The keys that hold members of more than one component, and n_rows."""
    ends = F.min("component").alias("a"), F.max("component").alias("b")
    return members.groupBy(key).agg(*ends, F.count("*").alias("n_rows")).where("a < b").select(key, "n_rows")


def _settled(rest: DataFrame, links: DataFrame, member: DataFrame, ties: DataFrame, percent: int) -> DataFrame:
    """The final components, once every candidate between components that are tied is confirmed or rejected.

    Components and ties make clusters; links can only lie within one. A document is in one cluster, so its set is sent
    once per tile, and candidates are confirmed where they are found instead of being listed.
    rest(doc_id, n_shingles, agree, items, component).
    """
    tied = components(links.select("u", "v").union(ties))
    clusters = tied.withColumnsRenamed({"node": "doc_id", "component": "cluster"})
    more = _linked(rest.join(clusters, "doc_id").select("cluster", "doc_id", "component", "n_shingles", "agree", "items"), percent)
    released(tied)
    if more.isEmpty():
        released(more)
        return member
    released(member)
    out = components(links.union(more))
    released(more)
    return out


def _members(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, component: of all nodes that are linked with another; a table. nodes(doc_id, digest, n_shingles, agree, bands)."""
    held = nodes.select("doc_id", F.explode("bands").alias("bucket"))
    hubs = written(held.groupBy("bucket").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("last"), F.count("*").alias("n_rows")).where("u < last").drop("last"), "minhash-hubs")
    # almost all buckets hold one document: what follows reads only the others
    some = narrowed(held, "bucket", hubs.select("bucket"))
    shared = written(hot_join(some, hubs.select("bucket", "u"), "bucket", hubs, F.xxhash64("doc_id")), "minhash-shared")
    released(hubs)
    asked = shared.select("doc_id").distinct()
    near = written(narrowed(nodes.drop("bands"), "doc_id", asked).join(asked, "doc_id"), "minhash-near")
    released(nodes)
    pairs = shared.where("u <> doc_id").select("u", F.col("doc_id").alias("v")).distinct()
    pairs = written(_agreeing(pairs, near, percent), "minhash-pairs")
    links = _confirmed(docs, near, pairs, shingle, percent)
    released(pairs)
    member = components(links)
    # members of coarse buckets that still hold several components
    placed = shared.join(member, shared.doc_id == member.node, "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    several = _several(placed, "bucket")
    unclear = hot_join(placed, several.select("bucket"), "bucket", several, F.xxhash64("doc_id")).select("doc_id", "component").distinct()
    unclear = written(unclear, "minhash-unclear")
    released(shared)
    if unclear.isEmpty():
        released(near, unclear, links)
        return member
    rest = _full(docs, near.join(unclear.select("doc_id"), "doc_id"), shingle, True)
    rest = written(rest.withColumnRenamed("id", "doc_id").join(unclear, "doc_id"), "minhash-rest")
    released(near, unclear)
    held = rest.select("doc_id", "component", F.explode("fine").alias("bucket"))
    several = written(_several(held, "bucket"), "minhash-fine")
    some = narrowed(held, "bucket", several.select("bucket"))
    fine = hot_join(some, several.select("bucket"), "bucket", several, F.xxhash64("doc_id")).join(rest.select("doc_id", "n_shingles", "agree"), "doc_id")
    ties = _candidates(fine.select("bucket", "doc_id", "component", "n_shingles", "agree"), percent)
    released(several)
    if not ties.isEmpty():
        member = _settled(rest, links, member, ties, percent)
    released(rest, ties, links)
    return member


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    signed = written(signatures(docs, shingle), "minhash-signatures")
    known = signed.where("row_id is not null and n_shingles > 0")
    rows = written(signed.select("row_id", "n_shingles", "digest"), "minhash-rows")
    # documents of one digest have the same set, so the same signature
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")), "minhash-classes")
    firsts = (F.first(c).alias(c) for c in ("n_shingles", "agree", "bands"))
    nodes = written(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *firsts), "minhash-nodes")
    released(signed)
    # a doc_id that stands for several sets is one node, that of the smallest digest
    twice = classes.groupBy("rep").agg(F.min("digest").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    if not twice.isEmpty():
        further = classes.join(twice, "rep").where("digest <> least").select("digest")
        before, nodes = nodes, written(nodes.join(further, "digest", "left_anti"), "minhash-nodes")
        released(before)
    member = _members(docs, nodes, shingle, percent)
    found = classes.join(member, classes.rep == member.node, "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # rows come from a table, so their numbers are the same in a task that is done again
    out = hot_join(rows, found, "digest", classes.select("digest", "n_rows"), F.monotonically_increasing_id(), "left")
    alone = F.col("n_shingles") == 0
    component = F.when(F.col("row_id").isNotNull(), F.when(alone, F.col("row_id")).otherwise(F.col("component")))
    out = out.select(F.col("row_id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: one document of each component, with all columns."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    names = [c if c == "doc_id" else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*names)
    return rows.join(gone, rows.doc_id == gone.gone_id, "left_anti").toDF(*docs.columns)


by_value(__name__)
