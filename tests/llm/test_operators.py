"""Corpus operators on small tables of their own: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import io
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberframe.llm import chat_format, components, exact_dedup, language_id, minhash, mixing, quality_rules, substring_dedup, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, copies int, kept boolean"


def docs_of(spark, rows):
    """rows of (doc_id, text[, source]); the further columns clash with names that operators use."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "d", 7, False) for r in rows], DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


# --- exact dedup


def test_exact_dedup(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a  b"), (4, None), (2, ""), (7, "c"), (7, "c"), (None, "ab"), (8, "x" * 200_000), (6, "x" * 200_000)]
    got = exact_dedup.assignments(docs_of(spark, rows)).collect()
    by = {(r.doc_id, r.text_sha256): r for r in got}
    ab = hashlib.sha256(b"ab").hexdigest()
    assert len(got) == len(rows)
    assert by[3, ab].keep_id == 9 and by[9, ab].kept and by[5, ab].group_size == 4 and not by[None, ab].kept
    assert by[4, hashlib.sha256(b"").hexdigest()].keep_id == 2
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True]
    assert by[8, hashlib.sha256(b"x" * 200_000).hexdigest()].keep_id == 6
    kept = exact_dedup.deduplicate(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 7, 9]
    assert exact_dedup.assignments(docs_of(spark, rows).limit(0)).count() == 0


# --- quality rules


def test_quality_rules(spark):
    shared = "the very same line of boilerplate"
    rows = [(i, f"{words(60, i)}\n{shared}") for i in range(60)]
    rows += [(100, "\n".join([shared] * 30)), (101, words(10, 101)), (102, None), (103, "a b c " * 100), (104, words(80, 104)), (104, words(80, 104))]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, rows), min_documents=20, share=0.02).collect()}
    assert got[0].kept and got[0].n_removed_words == 6 and got[0].n_dup_lines == 0
    assert not got[100].kept and got[100].n_dup_lines == 29
    assert not got[101].kept and got[101].base_failed and not got[102].kept and got[102].n_words == 0
    assert got[103].n_repeat_words == 300 and got[103].base_failed
    assert got[104].kept and got[104].n_removed_words == 0
    clean = quality_rules.clean(docs_of(spark, rows), min_documents=20, share=0.02)
    assert clean.columns == docs_of(spark, rows).columns
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[0].text == words(60, 0) and texts[0].n_chars == len(texts[0].text) and clean.where("doc_id = 104").count() == 2
    assert quality_rules.judge(docs_of(spark, rows).limit(0)).count() == 0


def test_copies_are_one_document(spark):
    """Many near copies of a clean document, alike in 29 of 30 lines, do not make its lines boilerplate."""
    body = [words(10, 1000 + k) for k in range(29)]
    rows = [(i, "\n".join([*body, words(10, i)])) for i in range(300)]
    got = quality_rules.judge(docs_of(spark, rows))
    assert got.where("kept").count() == 300


def test_boilerplate_of_any_hash(spark):
    """Lines that documents of a host share are found, however their hashes compare with those of the documents' own lines."""
    own = lambda i: "\n".join(words(6, 10 * i + k) for k in range(10))
    rows = [(60 * s + i, f"{own(60 * s + i)}\nfirst line of host {s}\nlast line of host {s}", f"s{s}") for s in range(40) for i in range(60)]
    got = quality_rules.judge(docs_of(spark, rows)).collect()
    assert {r.n_removed_words for r in got} == {10} and all(r.kept for r in got)


# --- substring dedup


def brute(rows, length=20):
    seen, gone = {}, defaultdict(set)
    tokens = {i: (t or "").encode().split() for i, t in rows if i is not None}
    for i in sorted(tokens):
        for s in range(len(tokens[i]) - length + 1):
            key = tuple(tokens[i][s : s + length])
            if key in seen:
                gone[i].update(range(s, s + length))
            else:
                seen[key] = (i, s)
    return {i: (len(w), len(gone[i]), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone[i])).hexdigest()) for i, w in tokens.items()}


def test_substring_dedup(spark):
    rng = random.Random(5)
    passages = [words(rng.choice([19, 20, 21, 33, 55]), 50 + k) for k in range(8)]
    rows = [(i, " ".join(rng.choice([words(rng.randint(1, 40), 1000 + 7 * i + k), rng.choice(passages)]) for k in range(6))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "ab " * 300), (303, "one\ttwo\n\x0bthree"), (304, passages[1] + " " + passages[1]), (305, words(30_000, 9))]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digests(docs_of(spark, rows)).collect()}
    assert got == brute(rows)
    again = [*rows[:50], *rows[:50], (None, rows[0][1])]
    out = substring_dedup.digests(docs_of(spark, again)).collect()
    assert len(out) == 101 and {r.doc_id: tuple(r)[1:] for r in out if r.doc_id is not None} == brute(rows[:50])
    assert [r.n_removed for r in out if r.doc_id is None] == [0]
    kept = substring_dedup.remove_repeats(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns and kept.count() == len(rows)
    assert substring_dedup.digests(docs_of(spark, rows).limit(0)).count() == 0


def test_substring_dedup_in_parts(spark, monkeypatch):
    """Buckets of more places than are ordered at once."""
    monkeypatch.setattr(substring_dedup, "AT_ONCE", 7)
    rng = random.Random(6)
    passages = [words(n, 90 + n) for n in (20, 30, 70)]
    rows = [(i, " ".join(rng.choice([words(15, 2000 + i), *passages]) for _ in range(4))) for i in range(60)]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digests(docs_of(spark, rows)).collect()}
    assert got == brute(rows)


# --- near dedup


def shingles(text, k):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    rows = []
    for base in range(12):
        w = words(120, base).split()
        for copy in range(12):
            new = list(w)
            for _ in range(rng.randint(0, 14)):
                new[rng.randrange(len(new))] = words(1, rng.random())
            rows.append((base * 100 + copy, " ".join(new)))
    rows += [(5000, None), (5001, ""), (5002, "One"), (5003, "one"), (5004, "a b"), (5005, "A\tB"), (5006, words(20_000, 3)), (5007, words(20_000, 3) + " end")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows), shingle=k).collect()}
    assert got == brute_components(rows, k)
    kept = minhash.deduplicate(docs_of(spark, [*rows, (None, "x")]), shingle=k)
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in got.items() if c == i)
    assert minhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in list(root)}


# --- mixing


def test_mixing(spark):
    rows = [(i, words(20 + i % 30, i), f"s{i % 4}" if i % 5 else None) for i in range(800)] + [(900, None, "s9"), (901, words(10, 1), "tiny"), (901, words(10, 1), "tiny")]
    got = mixing.draw(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.draw(docs_of(spark, rows)).collect()))
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    assert abs(sum(t for _, _, t in per.values()) - sum(s for s, _, _ in per.values())) < 1e-6
    assert all(t <= 3 * s + 1e-9 and abs(k - t) <= 50 for s, k, t in per.values())
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows).columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.draw(docs_of(spark, rows).limit(0)).count() == 0


# --- chat formatting


def test_chat_format(spark):
    hard = "\\<turn user>\n\\0\\1</turn>\n\\3>"
    rows = [(1, 0, "system", "s"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", "b"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 0, "ro\nle>", "x"), (None, 0, "assistant", "n")]
    made = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t or "") for c, _, r, t in rows if c == 1]
    assert back[1].losses == [hard, "b"] and back[2].losses == [] and back[3].turns[0].role == "ro\nle>" and back[None].losses == ["n"]
    full = sorted(chat_format.materialise(made).where("conv_id = 1").collect(), key=lambda r: r.example)
    assert len(full) == 2 and full[1].text.startswith(full[0].text) and full[1].text[full[1].loss_start : full[1].loss_end] == "b"
    assert chat_format.digests(made.limit(0)).count() == 0


# --- url filters


def test_url_filters(spark):
    link = "<link rel='canonical' href='%s'>"
    rows = [
        (1, "http://A.example.org/es/1", ""), (2, "http://x.net/a", link % "http://a.example.org/es/1"), (3, "http://y.net/b?q#f", '<meta http-equiv="refresh" content="0; url=http://x.net/a">'),
        (4, "http://z.net/", "<!-- " + link % "http://a.example.org/es/1" + " -->"), (5, "http://shop.com/fr/x", link % "http://b.com/de/1"), (6, "http://q.net/x", link % "http://shop.com/fr/x"),
        (7, None, ""), (8, "no scheme", None), (9, "http://example.org/en/12", ""), (10, "http://example.org", ""), (11, "http://badexample.org/es/", ""), (1, "http://A.example.org/es/1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filters.judge(pages, url_filters.rule_table(spark)).collect()}
    verdicts = {i: r.verdict for i, r in got.items()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "allow"}
    assert (got[1].host, got[1].path, got[1].rule) == ("a.example.org", "/es/1", "example.org/es/")
    assert (got[7].host, got[8].path, got[10].path, got[10].rule) == ("", "", "", None) and got[11].rule == "org/"
    more = spark.createDataFrame([("http://far.net/1", "http://c.com/de/2")], "source string, target string")
    far = spark.createDataFrame([(1, "http://far.net/1", "")], "page_id long, url string, html string")
    assert url_filters.judge(far, url_filters.rule_table(spark), more).first().verdict == "block"
    assert url_filters.judge(pages.limit(0), url_filters.rule_table(spark)).count() == 0


# --- WARC


def test_warc(spark, tmp_path):
    def record(kind, ident, url, date, head, body=""):
        block = f"{head}\r\n\r\n{body}".encode()
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    ok, no = "HTTP/1.1 200 OK\r\nETag: %s\r\nCache-Control: a\r\nContent-Type: text/html", "HTTP/1.1 304 Not Modified\r\nETag: %s\r\nCache-Control: b\r\nContent-Type: none"
    raw = record("response", "r1", "http://www.X.org/a/", "2024-01-01T00:00:00Z", ok % '"1"', "body") + record("response", "r2", "http://x.org/a#f", "2024-01-05T00:00:00Z", ok % '"2"', "")
    raw += record("revisit", "v0", "http://x.org/a", "2023-12-31T00:00:00Z", no % '"1"') + record("revisit", "v1", "https://x.org/a?utm_source=z", "2024-01-04T23:00:00Z", no % 'W/"1"')
    raw += record("revisit", "v2", "http://x.org/a", "2024-01-09T00:00:00Z", no % '"1"') + record("revisit", "v3", "http://x.org/a", "2024-01-09T00:00:00Z", "HTTP/1.1 304 Not Modified") + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut"
    (tmp_path / "a.warc").write_bytes(raw)
    records = warc.read_warc(spark, str(tmp_path / "a.warc"))
    assert [r.body for r in records.where("record_id = 'r1'").collect()] == [b"body"]
    got = {r.record_id: r for r in warc.resolve(records.drop("file", "body")).collect()}
    assert {k: (r.response_id, r.result) for k, r in got.items()} == {"v0": (None, "unresolved"), "v1": ("r1", "resolved"), "v2": (None, "mismatch"), "v3": ("r2", "unchecked")}
    assert got["v1"].headers == {"etag": 'W/"1"', "cache-control": "b", "content-type": "text/html"}
    assert list(warc.parse_records(io.BytesIO(b""))) == []
    assert warc.resolve(records.drop("file", "body").limit(0)).count() == 0


# --- language ID


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held_out), per_language=100)
    got = language_id.identify(docs.where(held_out), model)
    right = got.where("lang = lang_pred").count() / got.count()
    assert right >= 0.98 and got.where("score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !"), (4, "das ist ja nicht und der die " * 20_000)], "score long, text string")
    found = {r[0]: r for r in language_id.identify(odd.withColumnRenamed("score", "n"), model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[1].score == 0 and found[1].rejected and found[4].lang_pred == "de"
    assert language_id.fit(docs.limit(0)).predict("any text")[0] == "und"
    assert "score" in language_id.identify(docs.limit(0), model).columns
