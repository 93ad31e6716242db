"""The cross-document part of the quality rules, at the limits in use."""

import random
from collections import defaultdict

import pytest
from test_operators import docs_of, words

from emberframe.llm import quality_rules


def frequent(rows, min_documents=20, share=0.02, own=0.04):
    """The lines of each doc_id, and the (host, line) above the limit, from plain loops over (doc_id, text, host)."""
    lines = {i: [" ".join(x.lower().split()) for x in t.split("\n") if x.split()] for i, t, _ in rows}
    holders, size = defaultdict(list), defaultdict(int)
    for i, _, s in rows:
        size[s] += 1
        for x in set(lines[i]):
            holders[s, x].append(i)
    limit = lambda s: max(min_documents, share * size[s])
    maybe = {k for k, ids in holders.items() if len(ids) > limit(k[0])}

    def name(i, s):
        held = {x for x in lines[i] if (s, x) in maybe}
        n = lambda part: sum(len(x.split()) for x in part)
        few = n(set(lines[i]) - held) <= own * n(set(lines[i]))
        return few, frozenset(held if few else lines[i])

    return lines, {k for k in maybe if len({name(i, k[0]) for i in holders[k]}) > limit(k[0])}


def brute(rows):
    """doc_id: (n_removed_words, depleted)."""
    lines, gone = frequent(rows)
    out = {}
    for i, t, s in rows:
        lost = sum(len(x.split()) for x in lines[i] if (s, x) in gone)
        out[i] = lost, len(t.split()) - lost < 0.2 * len(t.split())
    return out


def page(i, own, block=()):
    return "\n".join([*block, *(words(10, 1000 * i + k) for k in range(own))])


def check(spark, rows):
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, rows)).collect()}
    want = brute(rows)
    assert {i: (r.n_removed_words, not r.kept and not r.base_failed) for i, r in got.items()} == {i: (n, d and not got[i].base_failed) for i, (n, d) in want.items()}
    return got


def test_blocks_of_shared_lines(spark):
    """A template on 10 to 30 % of a host's different pages is removed, whatever its lines and theirs; so it is from pages of it alone."""
    cases = [(b, n, part) for b in (3, 5, 10, 20) for n in (1, 2, 5) for part in (0.1, 0.3)]
    rows, inside, alone = [], {}, {}
    for c, (b, n, part) in enumerate(cases):
        block = [words(10, 10**7 + 100 * c + k) for k in range(b)]
        for j in range(300):
            i = 400 * c + j
            if j < part * 300:
                inside[i] = 10 * b
                rows.append((i, page(i, n, block), f"s{c}"))
            else:
                rows.append((i, page(i, 6), f"s{c}"))
        for j in range(300, 320):
            alone[400 * c + j] = 10 * b
            rows.append((400 * c + j, "\n".join(block), f"s{c}"))
    got = check(spark, rows)
    assert {i: got[i].n_removed_words for i in inside} == inside
    assert {i: got[i].n_removed_words for i in alone} == alone and not any(got[i].kept for i in alone)
    assert all(r.n_removed_words == 0 for i, r in got.items() if i not in inside and i not in alone)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_hosts(spark, seed):
    """Hosts of pages, exact copies and near copies of clean documents, and templates of any share, against plain loops."""
    rng = random.Random(seed)
    rows, copies = [], set()
    for host in range(4):
        templates = [([words(rng.randint(2, 12), rng.random()) for _ in range(rng.randint(1, 12))], rng.choice([0.01, 0.03, 0.06, 0.2])) for _ in range(4)]
        copied = [words(12, rng.random()) for _ in range(30)]
        for j in range(500):
            kind, i = rng.random(), 1000 * host + j
            block = [x for lines, part in templates if rng.random() < part for x in lines]
            if kind < 0.1:
                text = "\n".join(copied)
            elif kind < 0.2:
                text = "\n".join([*copied, words(12, i)])
            else:
                text = page(i, rng.randint(0, 8), block)
            if kind < 0.2:
                copies.add(i)
            rows.append((i, text.replace(" ", "\t ") if rng.random() < 0.1 else text, f"h{host}"))
    got = check(spark, rows)
    assert copies and all(got[i].n_removed_words == 0 for i in copies)


def test_template_with_one_own_line(spark):
    """All of 11 lines that 500 different documents share are found."""
    block = [words(6, 10**8 + k) for k in range(11)]
    got = check(spark, [(i, "\n".join([*block, words(6, i)]), "h") for i in range(500)])
    assert {r.n_removed_words for r in got.values()} == {66}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", None), (3, " \n \n", "h"), (4, words(60, 4), None), (5, words(30_000, 5), "h"), (5, words(30_000, 5), "h")]
    got = sorted((r.doc_id, r.n_words, r.kept) for r in quality_rules.judge(docs_of(spark, rows)).collect())
    assert got == [(1, 0, False), (2, 0, False), (3, 0, False), (4, 60, True), (5, 30_000, True), (5, 30_000, True)]
