"""Cases that the operators' larger tests do not reach: digests that clash, repeated rows, profiles, links against SQL, clashing names."""

import duckdb
from pyspark.sql import functions as F
from test_operators import docs_of, words
from test_queries import rows as plain_rows

from emberframe.llm import bpe, exact_dedup, language_id, mixing, url_filters, warc
from emberframe.llm.oracles import OP2


def test_digests_that_clash(spark):
    """With a digest of four values contents share digests; the content decides."""
    few = lambda content: F.pmod(F.xxhash64(content), F.lit(4)).cast("string")
    rows = [(i, f"t{i % 9}" + " " * (i % 2)) for i in range(40)] + [(7, "t7 "), (None, "t3"), (50, None), (51, "")]
    fields = lambda out: sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in out.collect())
    want = fields(exact_dedup.assignments(docs_of(spark, rows)))
    assert fields(exact_dedup.assignments(docs_of(spark, rows), digest=few)) == want
    assert len(want) == len(rows) and sum(k for *_, k in want) == 10
    kept = sorted(r.doc_id for r in exact_dedup.deduplicate(docs_of(spark, rows), digest=few).collect())
    assert kept == sorted(r[0] for r in want if r[3])


def test_repeated_rows_end_near_the_target(spark):
    rows = [(1, words(1000, 1), "a")] * 50 + [(100 + i, words(100, i), "b") for i in range(100)] + [(500 + i, words(10, 700 + i), "c") for i in range(20)]
    got = mixing.draw(docs_of(spark, rows)).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
        assert all(r.taken <= 3 * r.size for r in own)
    mixed = mixing.mix(docs_of(spark, rows))
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert taken == {s: sum(r.taken for r in got if r.source == s) for s in "abc"}


def test_equal_keys_and_long_texts(spark):
    """Without ids keys are drawn from the text, so equal texts tie; a long text is one document like any other."""
    rows = [(None, words(30, 1), "a")] * 4 + [(9, words(50_000, 2), "a"), (10, None, "a"), (11, words(5, 3), None)]
    got = mixing.draw(docs_of(spark, rows))
    assert got.count() == len(rows) and sorted(map(str, got.collect())) == sorted(map(str, mixing.draw(docs_of(spark, rows)).collect()))


def test_revisits_by_profile(spark):
    schema = "record_id string, kind string, profile string, url string, time timestamp, status int, headers map<string,string>"
    base = "http://netpreserve.org/warc/1.1/revisit/"
    rows = [
        ("r", "response", None, "http://x.org/a", 100, 200, {"etag": "1"}), ("a", "revisit", base + "identical-payload-digest", "http://x.org/a", 200, 200, {}),
        ("b", "revisit", base + "server-not-modified", "http://x.org/a", 200, 304, {"etag": "1"}), ("c", "revisit", None, "http://x.org/a", 200, 200, None),
        ("d", "revisit", None, "http://x.org/a", 200, 304, None), ("e", "revisit", None, None, 200, 304, None), ("f", "revisit", None, "http://x.org/a", None, 304, None),
        ("g", "revisit", None, "http://x.org/a", 100, 304, {"x": "y" * 100_000}), ("b", "revisit", base + "server-not-modified", "http://x.org/a", 200, 304, {"etag": "1"}),
    ]
    from datetime import UTC, datetime

    rows = [(*r[:4], None if r[4] is None else datetime.fromtimestamp(r[4], UTC), *r[5:]) for r in rows]
    got = warc.resolve(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.record_id, r.result, r.response_id) for r in got) == [
        ("a", "other_profile", None), ("b", "resolved", "r"), ("b", "resolved", "r"), ("c", "other_profile", None), ("d", "unchecked", "r"),
        ("e", "unresolved", None), ("f", "unresolved", None), ("g", "unchecked", "r"),
    ]


def test_links_against_sql(spark):
    """Blocks that are handed on over chains and stars of links, by the query's SQL."""
    link = "<html><link rel='canonical' href='%s'></html>"
    rows = [(i, f"http://h{i}.net/a", link % f"http://h{i // 2}.net/a") for i in range(1, 40)]
    rows += [(50, "http://h20.net/a", link % "http://www.example.org/es/q"), (51, "http://z.com/fr/1", link % "http://h50.net/a"), (52, "http://h50.net/a", link % "http://c.com/de/5"), (53, "http://c.com/de/5", "")]
    rows += [(60, "http://lone.org/x?y#z", None), (61, None, ""), (62, "http://" + "l" * 5000 + ".org/" + "p" * 100_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_filters.judge(pages, url_filters.rule_table(spark))
    con = duckdb.connect()
    con.register("pages_", pages.toPandas())
    con.sql("create view pages as select * from pages_")
    want = con.sql(OP2)
    assert plain_rows(got.columns, got.collect()) == plain_rows(want.columns, want.fetchall())
    assert {r.verdict for r in got.where("page_id < 40").collect()} == {"block"} and got.where("page_id = 52 and verdict = 'allow'").count() == 1


def test_rules_are_a_literal_table(spark):
    pages = spark.range(1000).selectExpr("id as page_id", "'http://a.com/de/' || id as url", "'' as html")
    plan = url_filters.judge(pages, url_filters.rule_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "ExistingRDD" not in plan
    assert url_filters.judge(pages, url_filters.rule_table(spark, [])).where("verdict = 'allow' and rule is null").count() == 1000


def test_clashing_names(spark):
    model = language_id.fit(docs_of(spark, [(i, words(30, i)) for i in range(30)]))
    docs = docs_of(spark, [(1, "ab cd"), (1, "ab cd")]).withColumns({"score": F.lit("x"), "rejected": F.lit(1)})
    out = language_id.identify(docs, model)
    assert out.columns == [*(c for c in docs.columns if c not in ("score", "rejected")), "lang_pred", "score", "rejected"] and out.distinct().count() == 1


def test_texts_beyond_one_split(monkeypatch):
    import public_tokenizers as P

    coder = bpe.BytePair.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = words(3000, 8) + "\n\n  x" + "y" * 500
    whole, ids = coder.digests(text), coder.encode(text)
    monkeypatch.setattr(bpe, "WHOLE", 100)
    monkeypatch.setattr(bpe, "RUN", 7)
    assert coder.digests(text) == whole and coder.encode(text) == ids and coder.decode(ids) == text.encode()
