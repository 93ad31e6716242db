"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

Features: runs of 1 to 3 characters of the lower-cased text, white space runs as one space, hashed into BUCKETS. A text's
vector is the mean of the embeddings of all its features; a linear layer and a softmax give a probability per language.
Training takes a bounded sample: about ``per_language`` labelled rows of each language, chosen by a hash of doc_id (the
bound; counts of labels cover all rows and reach the driver as one number a language). Their features are counted on the executors, so what reaches the driver is at
most BUCKETS counts a row. A fifth of the sample is held back to calibrate: a temperature that fits the probabilities,
and a threshold under which a prediction is rejected so that at most ``tolerated`` of the held-back rows are accepted and
wrong, at least MIN_SCORE.

As averaging and both layers are linear, prediction folds embeddings and output layer into one table of BUCKETS rows,
of fixed size; it goes to the workers with the task. Every whole text is read, in pieces of bounded length.

Defined results: null text and text without a letter: ``und``, score 0, rejected. Languages never seen are never given.
Without any training row every text is ``und``. Rows with a null label are predicted and never learned from. Repeated
rows get equal results; an empty table gives no rows. ``identify`` keeps further columns; those of docs that are named as
one of its results (lang_pred, score, rejected) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value

BUCKETS, WIDTH, ORDERS = 1 << 14, 16, (1, 2, 3)
PER_LANGUAGE, STEPS, RATE, BATCH = 600, 800, 2.0, 32
#: Embeddings move by so much more than the output layer: a feature's share of a mean is small.
GAIN = 10.0
TOLERATED, MIN_SCORE = 0.005, 0.5
PIECE = 1 << 18
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_SPACES = regex.compile(r"\s+")


def _features(text: str) -> Iterator[np.ndarray]:
    """The buckets of all features of a text, a piece at a time (pieces overlap so that no run is lost)."""
    over = max(ORDERS) - 1
    for at in range(0, max(1, len(text) - over), PIECE):
        part = _SPACES.sub(" ", text[at : at + PIECE + over]).lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        state = np.zeros(len(points), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            n = len(points) - order + 1
            if n <= 0:
                break
            state = (state[:n] * np.uint32(0x01000193)) ^ (points[order - 1 : order - 1 + n] * np.uint32(0x9E3779B1) + np.uint32(order))
            if order in ORDERS:
                yield ((state * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def counted(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    out = np.zeros(BUCKETS, np.int64)
    for f in _features(text):
        out += np.bincount(f, minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        counts = counted(text).astype(np.float32)
        return counts @ self.table / max(1.0, float(counts.sum())) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, rejected."""
        if not self.languages or not text or not _LETTER.search(text):
            return UND, 0.0, True
        p = _softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _trained(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and bias after stochastic gradient descent. rows: buckets and their shares."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1.0, (BUCKETS, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, classes), np.float32), np.zeros(classes, np.float32)
    order = np.empty(0, np.int64)
    for step in range(steps):
        if len(order) < BATCH:
            order = np.r_[order, rng.permutation(len(rows))]
        some, order = order[:BATCH], order[BATCH:]
        now = rate * (1 - step / steps)
        x = np.stack([share @ e[buckets] for buckets, share in (rows[i] for i in some)])
        wrong = _softmax(x @ w + b)
        wrong[np.arange(len(some)), y[some]] -= 1
        wrong /= len(some)
        back = wrong @ w.T
        w -= now * (x.T @ wrong)
        b -= now * wrong.sum(axis=0)
        for i, g in zip(some, back, strict=True):
            buckets, share = rows[i]
            e[buckets] -= now * GAIN * np.outer(share, g)
    return e, w, b


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, tolerated: float = TOLERATED) -> Model:
    """A model from labelled(doc_id, text, lang)."""
    known = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    # one count per language; as literals in the filter they need no join, so no text but the sample's leaves its scan
    shares = {r["lang"]: min(1.0, per_language / r["count"]) for r in known.groupBy("lang").count().collect()}
    if not shares:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    below = F.create_map(*(F.lit(x) for lang, share in sorted(shares.items()) for x in (lang, int(share * (1 << 30)))))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(below, F.col("lang")))
    sample = sample.select("doc_id", "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2):
                c = counted(text.as_py())
                at = np.flatnonzero(c)
                found.append((at.astype(np.int32), (c[at] / c.sum()).astype(np.float32)))
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.list_(pa.int32()), pa.list_(pa.float32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "lang", "at", "share"])

    got = sample.mapInArrow(count, "doc_id long, lang string, at array<int>, share array<float>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    names = sorted(set(got["lang"].to_pylist()))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    y = np.array([names.index(x) for x in got["lang"].to_pylist()])
    rows = [(a.values.to_numpy(zero_copy_only=False), s.values.to_numpy(zero_copy_only=False)) for a, s in zip(got["at"], got["share"], strict=True)]
    held = np.arange(len(rows)) % 5 == 4
    train = [r for r, h in zip(rows, held, strict=True) if not h]
    e, w, b = _trained(train, y[~held], len(names))
    model = Model(names, (e @ w).astype(np.float32), b, 1.0, MIN_SCORE)
    if held.any():
        z = np.stack([s @ model.table[a] for a, s in (r for r, h in zip(rows, held, strict=True) if h)]) + b
        model.temperature, model.threshold = _calibrated(z, y[held], tolerated)
    return model


def _calibrated(z: np.ndarray, y: np.ndarray, tolerated: float) -> tuple[float, float]:
    """The temperature of least log loss, and the lowest threshold that keeps accepted errors within what is tolerated."""
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.5, 20, 60), key=loss))
    p = _softmax(z / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    errors = np.cumsum(~right[order])
    ok = np.flatnonzero(errors <= tolerated * len(y))
    return temperature, max(MIN_SCORE, float(top[order][ok[-1]]) if len(ok) and ok[-1] + 1 < len(y) else MIN_SCORE)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with further columns lang_pred, score, rejected; no column but text is read."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    out = rows.withColumn("found", of(names[docs.columns.index("text")]))
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in ("lang_pred", "score", "rejected")]
    return out.select(*kept, "found.lang_pred", "found.score", "found.rejected")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


by_value(__name__)
