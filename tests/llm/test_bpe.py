"""BPE against the tiktoken library, and an exact round trip."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from emberframe.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.BytePair(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, text):
    ours, theirs = both
    ids = theirs.encode_ordinary(text)
    assert ours.encode(text) == ids
    assert ours.decode(ids) == text.encode()
    told = " ".join(map(str, ids)).encode()
    assert ours.digests(text) == (len(ids), hashlib.sha256(told).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_any_text(both, text):
    same(both, text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abeinorst", min_size=33, max_size=400))
def test_long_words(both, text):
    same(both, text)


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "a" * 5000, " " * 3000 + "x", "=-" * 2000, "é" * 3000, "1234567890" * 500, "aab" * 3000, "it's we'll don't", "İ‍👩‍👩‍👧"])
def test_hard_texts(both, text):
    same(both, text)


def test_random_long_pieces(both):
    rng = random.Random(3)
    for n in (50, 100, 1000, 20000):
        for letters in ("ab", "etaoinshrdlu", "*#=-_", "éàü"):
            same(both, "".join(rng.choice(letters) for _ in range(n)))


def test_frame(spark):
    docs = spark.createDataFrame([(1, "Hello wörld", "x"), (2, None, "y"), (None, "", "z"), (1, "Hello wörld", "x")], "doc_id long, text string, n_tokens string")
    got = [tuple(r) for r in bpe.digests(docs, PATH, P.PATTERN).collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(str, got)).count(str((2, 0, empty, empty))) == 1 and len(got) == 4
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert [r.decoded for r in back] == [r.text or "" for r in back]
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0
