"""Near dedup against plain loops: low signature agreement, words that weak hashes confuse, groups of many tiles, long texts."""

import random

import pytest
from test_operators import docs_of

from emberframe.llm import common, minhash, substring_dedup

#: Eight of ten word pairs shared, so a similarity of exactly 0.8; less than 0.70 of their 256 minima agree.
PAIRS = [
    ("ihejaa edebbc jdajid hfhcef agbdae hjddfd bjhcgh bhhhdh ceaiji", "cjghag", "agcibc"),
    ("ejichf hegghj cicidj jbaihh gbjacj gcbeii ecgcbg gageae deaaff", "jabhhf", "jjgaeb"),
    ("cihgjb igfgde gjccde bcfeca gdhfji cbegbi ebiahj hjfaej dbaaai", "jhcheh", "iifjda"),
]


def brute(rows, shingle, percent=80):
    """doc_id -> (size of the set, smallest id reachable), by comparing all pairs of word sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(spark, rows, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows), **options).collect()}


def edited(base, seed, most):
    rng = random.Random(seed)
    w = list(base)
    for k in rng.sample(range(len(w)), rng.randint(0, most)):
        w[k] = "w%06d" % rng.randrange(10**6)
    return " ".join(w)


def test_signatures_of_low_agreement(spark):
    rows = [(10 * k + j, f"{body} {last}") for k, (body, *ends) in enumerate(PAIRS) for j, last in enumerate(ends)]
    assert {i: c for i, (_, c) in found(spark, rows, shingle=2).items()} == {i: i - i % 10 for i, _ in rows}


def thue_morse(doublings):
    a, b = "a", "b"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("doublings", [10, 11])
def test_words_that_polynomial_hashes_confuse(spark, doublings):
    a, b = thue_morse(doublings)
    assert found(spark, [(1, a), (2, b)], shingle=2) == {1: (1, 1), 2: (1, 2)}
    rest = " ".join(f"w{i}" for i in range(19))
    got = substring_dedup.digests(docs_of(spark, [(1, f"{a} {rest}"), (2, f"{b} {rest}")])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 20, 0), (2, 20, 0)]


def test_runs_that_polynomial_hashes_confuse(spark):
    a, b = (" ".join(x) for x in thue_morse(7))
    got = substring_dedup.digests(docs_of(spark, [(1, a), (2, b)]), length=128).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0)]


def test_groups_of_many_tiles(spark, monkeypatch):
    """A group that shares buckets but is linked in part, in tiles far smaller than the group."""
    monkeypatch.setattr(minhash, "TILE", 16)
    base = [f"b{i}" for i in range(120)]
    rows = [(7 * i % 401, edited(base, i, 14)) for i in range(240)] + [(1000 + i, edited(base, 999, 14)) for i in range(40)]
    got = found(spark, rows, shingle=2)
    want = brute(rows, 2)
    assert got == want
    assert 2 < len({c for _, c in want.values()}) < 200


def test_long_texts_in_one_cluster(spark, monkeypatch):
    """Blocks are bounded in bytes: a few texts of 20,000 words are several blocks."""
    monkeypatch.setattr(minhash, "TILE_BYTES", 1 << 18)
    base = [f"b{i}" for i in range(20_000)]
    rows = [(i, edited(base, i, 1500)) for i in range(12)] + [(50, None), (51, ""), (52, " \n")]
    assert found(spark, rows, shingle=2) == brute(rows, 2)


def test_ids_that_stand_for_several_texts(spark):
    """Each row goes by its own text; the result is the same in every run."""
    near = [" ".join(f"{p}{i}" for i in range(60)) for p in "xyz"]
    rows = [(5, near[0]), (5, near[1]), (3, near[1] + " end"), (9, near[0] + " end"), (5, near[0]), (None, near[2]), (2, near[2])]
    runs = [sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in minhash.near_duplicates(docs_of(spark, rows), shingle=2).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    assert (-1, 59, -1, True) in runs[0] and (2, 59, 2, True) in runs[0]
    assert [r[2] for r in runs[0] if r[0] == 3] == [3]


def test_hot_keys(spark, monkeypatch):
    """Classes, buckets and hubs whose rows go to several tasks keep every row, once."""
    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = [(i, f"one two three four five {'six' if i < 9 else 'seven' if i < 15 else 'eight' if i < 20 else i}") for i in range(24)]
    rows += [rows[0]] * 5 + [(None, rows[0][1])] * 4 + [(30, None), (31, "")]
    got = minhash.near_duplicates(docs_of(spark, rows), 2).collect()
    want = brute([r for r in rows if r[0] is not None], 2)
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert sum(r.doc_id is None and r.component_id is None for r in got) == 4
