"""Byte-level BPE encoding and decoding by tree reduction.

A text is split by the vocabulary's pattern; pieces are encoded one by one. Within a piece tokens form a monoid under
"encode the joined bytes": short pieces are leaves, merged lowest rank first; longer ones are halved, the halves encoded
by recursion, and neighbours joined. A join re-encodes a window around the boundary, the last k tokens on the left and
the first k on the right, and keeps all tokens outside it if they provably stay: a token sequence is the encoding of its
bytes if and only if each two neighbours are the encoding of their joined bytes (every merge that could cross two tokens
depends on those two alone). Only the two seams of the window can break this; if one does, k doubles, up to the halves.
Decoding concatenates bytes up the same tree, halves before wholes.

Workers load the rank file from ``path``; it must be readable on every executor. Encoded pieces are kept in a cache of
bounded size.

Defined results: a null text is empty: no tokens, the digest of no bytes. Rows that repeat are encoded alike; an empty
table gives no rows. Bytes that are not UTF-8 can't occur in strings. Texts of any length are encoded whole, pieces in
runs of bounded number. Further columns pass through ``encode``; a column token_ids of docs is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value

LEAF, CACHED, LONGEST_CACHED = 32, 400_000, 64
#: Texts up to so many characters are split at once, longer ones in runs of so many pieces. NONE is above every rank.
WHOLE, RUN, NONE = 1 << 20, 50_000, 1 << 62


class BytePair:
    """A vocabulary of ranks with the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.ids: dict[str, tuple[int, ...]] = {}
        self.told: dict[str, str] = {}
        self.by_text = {str(i): t for t, i in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePair:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def leaf(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, the first of equals, until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NONE)
        return [self.ranks[p] for p in parts]

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b are the encoding of their joined bytes."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHED:
                self.fits.clear()
            known = self.fits[a, b] = self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        k = 2
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.merged(b"".join(self.tokens[t] for t in left[a:] + right[:b]))
            if (a == 0 or self.stays(left[a - 1], window[0])) and (b == len(right) or self.stays(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def merged(self, piece: bytes) -> list[int]:
        """As leaf, with a heap of pairs over a linked list: for windows of any length."""
        if len(piece) <= 4 * LEAF:
            return self.leaf(piece)
        n, ranks = len(piece), self.ranks
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged since
            part[i], part[j] = part[i] + part[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    both = part[k] + part[after[k]]
                    if (r := ranks.get(both)) is not None:
                        heapq.heappush(heap, (r, k, len(both)))
        return [ranks[p] for p in part if p is not None]

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of a piece."""
        raw = text.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(self.tree(raw))

    def piece_told(self, text: str) -> str:
        """The ids of a piece as decimal text, with a space after each."""
        return "".join([f"{i} " for i in self.piece(text)])

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in lists of bounded length."""
        if len(text) <= WHOLE and not self.pattern.groups:
            yield self.pattern.findall(text)
            return
        run = []
        for m in self.pattern.finditer(text):
            run.append(m[0])
            if len(run) >= RUN:
                yield run
                run = []
        yield run

    def _coded(self, text: str, known: dict, code: Callable) -> Iterator[list]:
        """code of each piece of a text, in lists of bounded length, by a cache of bounded size."""
        for pieces in self._pieces(text):
            found = list(map(known.get, pieces))
            if None in found:
                for k, x in enumerate(found):
                    if x is None:
                        piece = pieces[k]
                        found[k] = known.get(piece) or code(piece)
                        if len(piece) <= LONGEST_CACHED:
                            if len(known) >= CACHED:
                                known.clear()
                            known[piece] = found[k]
            yield found

    def encode(self, text: str) -> list[int]:
        return [i for run in self._coded(text, self.ids, self.piece) for ids in run for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up a tree of halves."""
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of their decimal text, digest of the bytes decoded from that text."""
        n, coded, back, first = 0, hashlib.sha256(), hashlib.sha256(), True
        for run in self._coded(text, self.told, self.piece_told):
            told = "".join(run)
            if not told:
                continue
            ids = told.split()
            n += len(ids)
            coded.update(("" if first else " ").encode() + told[:-1].encode())
            back.update(self.decode_told(ids))
            first = False
        return n, coded.hexdigest(), back.hexdigest()

    def decode_told(self, told: list[str]) -> bytes:
        """As decode, for ids as decimal texts."""
        if len(told) <= 65536:
            return b"".join(map(self.by_text.__getitem__, told))
        half = len(told) // 2
        return self.decode_told(told[:half]) + self.decode_told(told[half:])


_LOADED: dict[tuple[str, str], BytePair] = {}


def vocabulary(path: str, pattern: str) -> BytePair:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePair.load(path, pattern)
    return _LOADED[path, pattern]


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePair.load(path, pattern)
        for batch in batches:
            rows = [bpe.digests(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with a further column token_ids, in place of one of that name."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        bpe = vocabulary(path, pattern)
        return texts.map(lambda t: bpe.encode(t or ""))

    return docs.withColumn("token_ids", ids_of(F.coalesce("text", F.lit(""))))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """tokens (with token_ids) with a further column decoded, in place of one of that name: the bytes as a text."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        bpe = vocabulary(path, pattern)
        return ids.map(lambda x: bpe.decode([] if x is None else list(x)).decode("utf-8", "replace"))

    return tokens.withColumn("decoded", text_of("token_ids"))


by_value(__name__)
