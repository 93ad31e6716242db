"""Words of many texts at once as 64-bit hashes, and hashes of runs of words.

A word is a maximal run of bytes other than white space (bytes.split() parts at exactly the six characters of the word
rule). Its hash is SipHash of its bytes under a key that the seed gives: a keyed function without algebra in its input, so
unequal words of any length or pattern agree with a probability of 2^-64. Runs of words are hashed by joining halves; each
join ends in a bijection that is not linear, so patterns of equal words in a run can't cancel out either.

Texts are split in pieces of about PIECE bytes, cut at white space, so memory stays bounded for texts of any length (a
single longer word is one piece).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pandas.util import hash_array

from .common import by_value

PIECE = 1 << 20
U64 = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which close values fall far apart (the splitmix64 finalizer)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def series(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    start = np.full(1, seed, U64) * U64(0x632BE59BD9B4E019)
    return mixed((np.arange(1, n + 1, dtype=U64) + start) * U64(0x9E3779B97F4A7C15))


class Hasher:
    """Hashes words; hashers of different seeds are independent."""

    def __init__(self, seed: int) -> None:
        self.key = f"{int(series(seed, 1)[0]):016x}"

    def words(self, words: np.ndarray) -> np.ndarray:
        """Hashes of an array of bytes objects."""
        return hash_array(words, hash_key=self.key, categorize=False) if len(words) else np.empty(0, U64)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def hashed(texts: list[bytes], hashers: list[Hasher]) -> tuple[list[int], list[np.ndarray]]:
    """The number of words of each text, and the hashes of all their words by each hasher."""
    counts: list[int] = []
    out: list[list[np.ndarray]] = [[] for _ in hashers]
    held: list[bytes] = []

    def flush() -> None:
        words = np.empty(len(held), object)
        words[:] = held
        for h, to in zip(hashers, out, strict=True):
            to.append(h.words(words))
        held.clear()

    for text in texts:
        n = 0
        for piece in [text] if len(text) <= PIECE else _pieces(text):
            words = piece.split()
            n += len(words)
            held.extend(words)
            if len(held) > PIECE // 4:
                flush()
        counts.append(n)
    if held:
        flush()
    return counts, [np.concatenate(x) if x else np.empty(0, U64) for x in out]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * U64(0x9E3779B97F4A7C15) + b)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size consecutive values, by start: runs of powers of two joined by the bits of size."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out, done, power, width = None, 0, mixed(h + U64(1)), 1
    while True:
        if size & width:
            part = power[done : done + n]
            out = part if out is None else _joined(out, part)
            done += width
        if done == size:
            return out
        power = _joined(power[: len(power) - width], power[width:])
        width *= 2


def bundles(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes together, one text at least."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= most):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def tokenised(texts: list[bytes], hashers: list[Hasher]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each text its index and the hashes of its words by each hasher."""
    for a, b in bundles(texts):
        counts, hashes = hashed(texts[a:b], hashers)
        low = 0
        for k, n in enumerate(counts):
            yield a + k, [h[low : low + n] for h in hashes]
            low += n


by_value(__name__)
