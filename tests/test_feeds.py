import json

import pytest
from pyspark.sql import functions as F

from signalloom.operators.backends import with_embeddings, with_scores
from signalloom.plans import lookups, ranking
from signalloom.sources import feeds
from signalloom.sources.feeds import query_github, query_oa, release_results, rustsec_results, scope_hash
from signalloom.sources.manifests import auto_profiles
from signalloom.sources.replies import ledger_weaknesses, open_weaknesses


def frame(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) or p is None else json.dumps(p),) for p in payloads], "payload string")


def test_s2(spark):
    p = {"data": [{"paperId": "p1", "title": " A  B ", "authors": [{"name": "X"}, {"name": None}], "year": 2020, "venue": "", "externalIds": {"ArXiv": "1", "CorpusId": 7}, "publicationDate": "2020-02-30"}, {"paperId": "", "title": "t"}]}
    (r,) = feeds.s2_results(frame(spark, p, None, "broken"), "payload").collect()
    assert (r.title, r.authors, r.venue, r.external_ids.corpus_id, r.publication_date) == ("A B", ["X"], None, "7", None)
    assert r.url.endswith("/p1")


def test_oa(spark):
    p = {"results": [{"id": "W1", "title": "T", "doi": "https://doi.org/10.1/x", "abstract_inverted_index": {"b": [1], "a": [0]}, "concepts": [{"display_name": str(i)} for i in range(7)], "publication_date": "2020-01-02"}]}
    (r,) = feeds.oa_results(frame(spark, p), "payload").collect()
    assert (r.doi, r.abstract_text, len(r.concepts), str(r.publication_date)) == ("10.1/x", "a b", 5, "2020-01-02")


def test_rustsec(spark):
    a = {"advisories": [{"advisory": {"id": "R1", "title": "x", "date": "2020-01-01"}}, {"advisory": {"id": "R2", "title": "Memory bug"}, "versions": {"patched": [">=1"]}}]}
    (r,) = feeds.rustsec_results(frame(spark, a), "payload", ["memory"], 5).collect()
    assert (r.id, r.patched) == ("R2", [">=1"])
    assert feeds.rustsec_results(frame(spark, a), "payload", [], 1).first().id == "R1"


def test_arxiv(spark):
    xml = '<entry><id>http://arxiv.org/abs/1907.40123v1</id><title>A\n B</title><summary>s</summary><author><name>X</name></author><author><name>Y</name></author><published>2024-01-01T00:00:00Z</published><link href="p" title="pdf"/><category term="cs.AI"/></entry>'
    (r,) = feeds.arxiv_payload(frame(spark, xml, "<entry><title>no id</title></entry>"), "payload").collect()
    assert (r.arxiv_id, r.title, r.authors, r.categories, r.pdf_url) == ("1907.40123v1", "A B", ["X", "Y"], ["cs.AI"], "p")


def test_arxiv_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://arxiv.org/abs/1</id><title>T</title></entry><entry><title>none</title></entry></feed>")
    assert [r.arxiv_id for r in feeds.arxiv_entries(spark, str(tmp_path / "f.xml")).collect()] == ["1"]


def test_release_and_queries(spark):
    df = spark.createDataFrame([("o/r", json.dumps({"tag_name": "v1", "published_at": "2020-01-01T00:00:00Z", "prerelease": False})), ("o/q", None)], "repo string, payload string")
    assert [(r.full_name, r.tag_name) for r in feeds.release_results(df, "repo", "payload").collect()] == [("o/r", "v1")]
    one = spark.range(1)
    assert one.select(feeds.query_arxiv(["a b", "c"], ["n"]).alias("q")).first().q == "(all:a%20b+OR+all:c)+ANDNOT+all:n"
    assert one.select(feeds.query_s2(["a"], ["n"]).alias("q")).first().q == "a%20-n"
    h = one.select(feeds.scope_hash("s2_", F.array(F.lit("b"), F.lit("a"))).alias("x"), feeds.scope_hash("s2_", F.array(F.lit("a"), F.lit("b"))).alias("y")).first()
    assert h.x == h.y and h.x.startswith("s2_")


def test_latest_release_of_each_repository(spark):
    rows = [("a/x", '{"tag_name": "v1", "published_at": "2024-01-01T00:00:00Z"}'), ("a/x", '{"tag_name": "v2", "published_at": "2024-02-01T00:00:00Z"}'), ("b/y", '{"tag_name": "v0"}'), ("c/z", "{}"), ("d/w", "not json")]
    df = spark.createDataFrame(rows, "repo string, payload string")
    assert {(r.full_name, r.tag_name) for r in release_results(df, "repo", "payload").collect()} == {("a/x", "v2"), ("b/y", "v0")}
    assert [r.full_name for r in release_results(df, "repo", "payload", 1).collect()] == ["a/x"]


def test_first_advisories_of_each_payload(spark):
    one = lambda *ids: json.dumps({"advisories": [{"advisory": {"id": i, "title": "memory"}} for i in ids]})
    df = spark.createDataFrame([(one("a", "b", "c"),), (one("d"),), (None,)], "payload string")
    assert sorted(r.id for r in rustsec_results(df, "payload", ["memory"], 2).collect()) == ["a", "b", "d"]


def test_manifests(spark):
    got = {r.name: (r.keywords, r.keyword_count) for r in auto_profiles(spark.createDataFrame(lookups.MANIFESTS, "project string, file string, content string")).collect()}
    assert got == {"alpha": (["streaming", "proptest", "ingest", "stores", "vector", "alpha", "tokio"], 7), "beta": (["d3-shape", "pyarrow"], 2), "gamma": (["graphkit"], 1)}
    odd = [("p", "Cargo.toml", None), ("p", "package.json", "{"), ("p", "go.mod", ""), ("q", "README.md", "#" * 9)]
    assert auto_profiles(spark.createDataFrame(odd, "project string, file string, content string")).count() == 0
    many = [("m", "Cargo.toml", "[dependencies]\n" + "\n".join(f"crate{i:03} = 1" for i in range(60)))]
    assert auto_profiles(spark.createDataFrame(many, "project string, file string, content string")).first().keyword_count == 25


def test_queries_of_feeds(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(query_oa(["a b", "c"])) == "a%20b%20c" and one(query_github(["a b", "c"])) == "a%20b+OR+c"
    keys = lambda *k: F.array(*[F.lit(x) for x in k])
    assert one(scope_hash("x_", keys("b", "a"))) == one(scope_hash("x_", keys("a", "b"))) != one(scope_hash("x_", keys("ab")))


def test_snapshot_without_lists(spark):
    df = spark.createDataFrame([("{}",), ("no json",), ('{"ledger_weaknesses": [{"rank": 2, "weakness": "w"}]}',)], "doc string")
    assert open_weaknesses(df, "doc").count() == 0 and [r["rank"] for r in ledger_weaknesses(df, "doc").collect()] == [2]


def test_backends(spark):
    df = spark.createDataFrame([(1, "ab", 0), (2, None, 0), (3, "abcd", 0)], "id long, text string, score int")
    assert {r.id: r.score for r in with_scores(df, "id", "text", lambda ts: [len(t) / 2 for t in ts]).collect()} == {1: 1.0, 2: None, 3: 1.0}

    def broken(texts):
        raise OSError("gone")

    assert {r.score for r in with_scores(df, "id", "text", broken).collect()} == {None}
    got = {r.id: r.embedding for r in with_embeddings(df, "id", "text", lambda ts: [[len(t), 0] for t in ts], 2).collect()}
    assert got == {1: [2.0, 0.0], 2: None, 3: [4.0, 0.0]}
    with pytest.raises(Exception, match="2 places"):
        with_embeddings(df, "id", "text", lambda ts: [[1.0]] * len(ts), 2).collect()


@pytest.mark.parametrize("name", ["keyword_score_rank", "llm_topk_merge", "incremental_scan_pipeline"])
def test_every_phrase_is_counted_once(spark, name):
    """A phrase is counted once for content and once for the summary, whatever is filtered by the score."""
    plans = []
    kept = ranking.written
    ranking.written = lambda df, n: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, n)
    try:
        df = ranking.QUERIES[name](spark, "/root/testdata/sf0.001")
    finally:
        ranking.written = kept
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    # Once in the plan and once in its formatted list of nodes.
    assert sum(p.count("regexp_count") + p.count("RegExpCount") + p.count("regexp_extract_all") for p in plans) <= 2 * len([*ranking.KEYWORDS, *ranking.NEGATIVES])
