"""Queries that look up, rank and count: aliases, sources of entries, profiles, counters, replies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions.display import colour, domain_slug, hypothesis, is_archived, percent
from signalloom.operators.feedback import linked, reduced, useful_by
from signalloom.operators.relational import best_of_each, newest_of_each_text, numbered, page, unseen
from signalloom.plans import jobs, outcomes, ranking
from signalloom.sources.feeds import scope_hash
from signalloom.sources.manifests import auto_profiles
from signalloom.sources.replies import answer_score, obligation_ids, obligation_status, open_weaknesses
from signalloom.sources.storage import written
from signalloom.sources.tables import table

#: Profiles as a store may hold them: name, keywords, sources (none: all), archived.
PROFILES = [("systems", ["compiler", "inference"], ["paper", "release"], None), ("safety", ["sandbox"], ["advisory"], "2024-01-01 00:00:00"), ("all", ["token budget"], [], None)]
REPLIES = [
    '{"obligation_ids": ["o1", "", 5, "o2"], "obligation_id": "o3", "status": "open"}',
    '{"data": {"obligation_ids": ["d1"], "obligation_id": "d2", "status": "Applied"}, "obligations": [{"id": "x1"}, {"id": ""}, {"name": "y"}]}',
    '{"status": 7, "data": {"status": "closed"}}',
    '{"obligation": {"status": "blocked"}, "obligation_id": ""}',
    '{"obligation_ids": "o9", "obligations": []}',
    "not json",
    "{}",
]
ANSWERS = ['{"score": 0.75, "reason": "a"}', '```json\n{"score": 1.5}\n```', '```\n{"score": -2}\n```', "no answer", '{"reason": "b"}', ""]
SNAPSHOT = json.dumps({"generated_at": "2024-05-01T00:00:00Z", "open_obligations": [{"weakness_code": "memory_safety", "severity": "high", "count": 3, "domains": ["systems", "compilers"], "latest_summary": "unsafe paths"}, {"weakness_code": "token_budget", "severity": "low", "count": 1, "domains": ["inference"]}, {"weakness_code": "audit", "severity": "medium", "count": 2}]})
MANIFESTS = [
    ("alpha", "Cargo.toml", '[package]\nname = "alpha"\n[dependencies]\ntokio = { version = "1" }\nserde = "1"\n# lancedb = "0"\n[dev-dependencies]\nproptest = "1"\n'),
    ("alpha", "README.md", "# Alpha: Vector Stores\nplain words here\n## Streaming *ingest* setup\n"),
    ("beta", "pyproject.toml", '[project]\ndependencies = [\n  "pyarrow>=15",\n  "pytest==8",\n]\nversion_note = "a>=b"\n'),
    ("beta", "package.json", '{"dependencies": {"d3-shape": "1"}, "devDependencies": {"jest": "2"}}'),
    ("gamma", "go.mod", "module x\nrequire (\n\tgithub.com/acme/graphkit v1.2.0\n\tgithub.com/acme/2fast v1.0.0\n)\n"),
    ("empty", "notes.txt", "# Nothing to see"),
]


def _replies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REPLIES)), "n int, reply string")


def alias_probe_any(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the other feeds that the works feed has under any of their ids; an item is asked for once with all its ids."""
    oa = table(spark, folder, "oa_works")
    old = oa.select(F.explode(F.array(F.struct(F.lit("arxiv_id").alias("kind"), F.col("arxiv_id").alias("value")), F.struct(F.lit("doi").alias("kind"), F.col("doi").alias("value")))).alias("a")).select("a.*").where("value is not null").distinct()
    s2 = table(spark, folder, "s2_papers").select("rec_id", F.array(F.struct(F.lit("arxiv_id").alias("kind"), F.col("external_ids.arxiv_id").alias("value")), F.struct(F.lit("doi").alias("kind"), F.col("external_ids.doi").alias("value"))).alias("ids"))
    ax = table(spark, folder, "arxiv_papers").select("rec_id", F.array(F.struct(F.lit("arxiv_id").alias("kind"), F.col("arxiv_id").alias("value")), F.struct(F.lit("doi").alias("kind"), F.lit(None).cast("string").alias("value"))).alias("ids"))
    items = s2.unionByName(ax)
    hits = items.select("rec_id", F.explode("ids").alias("a")).select("rec_id", "a.*").where("value is not null").join(old, ["kind", "value"], "left_semi").select("rec_id").distinct()
    return items.select("rec_id").join(hits.withColumn("hit", F.lit(True)), "rec_id", "left").select("rec_id", F.coalesce("hit", F.lit(False)).alias("known"))


def priority_rank(spark: SparkSession, folder: str) -> DataFrame:
    """All actionable findings by priority, ranked from 0."""
    f = table(spark, folder, "findings").where("is_actionable").select("id", F.round(F.col("priority_score").cast("double"), 4).alias("priority"))
    return numbered(f, [F.desc("priority"), F.asc("id")], "rank")


def recent_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the 1000 newest findings; those without one are dropped after the limit."""
    f = table(spark, folder, "findings").select("id", "discovered_at", "embedding")
    return page(f, [F.desc("discovered_at"), F.asc("id")], 1000).where("embedding is not null").select("id", F.size("embedding").alias("places"), F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first_place"))


def entry_source_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """What a notice names an entry by: the title of its source, else its own id."""
    s = table(spark, folder, "sources").select(F.col("id").alias("source_id"), "title", "url")
    e = table(spark, folder, "entries").select("id", "source_id")
    return e.join(s, "source_id", "left").select("id", F.coalesce("title", "id").alias("heading"), "url")


def sources_of_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted entries with their source; an entry without one gives no row."""
    e = table(spark, folder, "entries").where("relevance_score >= 0.6").select("id", "source_id")
    return e.join(table(spark, folder, "sources").select(F.col("id").alias("source_id"), "source_type"), "source_id").select("id", "source_type")


def _profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "name string, keywords array<string>, sources array<string>, archived_at string")


def profile_source_items(spark: SparkSession, folder: str) -> DataFrame:
    """Sources without entries that each profile makes a placeholder for; a profile without sources takes all."""
    bare = ranking.placeholder_entries(spark, folder).select("source_id").join(table(spark, folder, "sources").select(F.col("id").alias("source_id"), "source_type"), "source_id")
    per = bare.groupBy("source_type").agg(F.count("*").alias("n"))
    p = _profiles(spark).where(~is_archived(F.col("archived_at"))).select("name", "sources")
    # A row per source type on one side, a few profiles on the other.
    return p.join(per, (F.size("sources") == 0) | F.array_contains("sources", F.col("source_type"))).groupBy("name").agg(F.sum("n").alias("placeholders"))


def archived_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return _profiles(spark).select("name", is_archived(F.col("archived_at")).alias("archived"))


def scope_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return _profiles(spark).select("name", scope_hash("s2_", F.col("keywords")).alias("scope"))


def count_sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").agg(F.count("*").alias("sources"))


def finding_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One finding by its key."""
    f = table(spark, folder, "findings")
    return f.where(F.col("id") == f.agg(F.min("id")).first()[0]).select("id", "title", "urgency")


def usefulness_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Source kinds by usefulness, the most useful first."""
    u = useful_by(outcomes._published(spark, folder), "source_kind").select("source_kind", "usefulness")
    return numbered(u, [F.desc("usefulness"), F.asc("source_kind")], "rank")


def scan_history_per_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The three newest jobs of every profile."""
    return best_of_each(jobs._jobs(spark, folder), "profile_id", [F.desc("created_at"), F.desc("id")], 3).select("profile_id", "id", "status", "rank")


def topk_per_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per source type, which stands for a profile, the ten best entries over the threshold."""
    s = ranking.scored(ranking._entries(spark, folder)).where(F.col("score") >= ranking.THRESHOLD).select("id", "source_id", "ingest_seq", "score")
    kinds = table(spark, folder, "sources").select(F.col("id").alias("source_id"), "source_type")
    return best_of_each(s.join(kinds, "source_id"), "source_type", [F.desc("score"), F.desc("ingest_seq")], 10).select("source_type", "id", "score", "rank")


def run_counters(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan did: fetched, new, left after removing repeats, scored, accepted."""
    e = ranking._entries(spark, folder)
    new = unseen(e, ranking._stored_scores(spark, folder), "id", "entry_id")
    kept = written(ranking.scored(newest_of_each_text(new, "content", "ingest_seq")).select("score"), "kept")
    a, b = e.agg(F.count("*").alias("fetched")), new.agg(F.count("*").alias("candidates"))
    c = kept.agg(F.count("*").alias("deduped"), F.count_if(F.col("score") > 0).alias("scored"), F.count_if(F.col("score") >= ranking.THRESHOLD).alias("accepted"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """A row per batch of entries: how many, from how many sources, how relevant, and a warning if nothing was relevant."""
    g = table(spark, folder, "entries").groupBy("batch_no").agg(F.count("*").alias("entries"), F.count_if(F.col("relevance_score") >= 0.6).alias("accepted"), F.count_if(F.col("relevance_score").isNull()).alias("unscored"))
    return g.select("batch_no", "entries", "accepted", "unscored", F.when(F.col("accepted") == 0, "nothing accepted").otherwise("ok").alias("remark"))


def poll_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of one poll of all findings' obligations."""
    d = outcomes.reduce_dispositions(spark, folder)
    of = lambda k: F.count_if(F.col("disposition") == k).alias(k)
    return d.agg(F.count("*").alias("polled"), of("favorable"), of("unfavorable"), of("pending"))


def outcomes_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """All published findings, the oldest first, with their place."""
    return numbered(outcomes._published(spark, folder).select("id", "outcome", "published_at"), [F.asc("published_at"), F.asc("id")], "place")


def score_display(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "entries").where("relevance_score is not null").select("id", F.round("relevance_score", 3).alias("s"))
    return e.select("id", colour(F.col("s")).alias("colour"), percent(F.col("s")).alias("label"))


def finding_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    """What each finding may do about the first weakness it is linked to; the weaknesses come from a snapshot."""
    doc = spark.createDataFrame([(SNAPSHOT,)], "doc string")
    w = open_weaknesses(doc, "doc")
    f = table(spark, folder, "findings").select("id", "title", "domain", F.concat_ws(" ", "title", "summary").alias("text"))
    code = linked(f, w).withColumnRenamed("weakness_code", "code")
    j = f.join(code, "id").join(F.broadcast(w.select(F.col("weakness_code").alias("code"), "summary")), "code", "left")  # a few rows
    return j.select("id", domain_slug(F.col("domain")).alias("slug"), hypothesis(F.col("title"), F.col("code"), F.col("summary")).alias("hypothesis"))


def obligation_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and status out of replies of every shape."""
    return _replies(spark).select("n", F.array_join(obligation_ids(F.col("reply")), ",").alias("ids"), obligation_status(F.col("reply")).alias("status"))


def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ANSWERS)), "n int, answer string").select("n", answer_score(F.col("answer")).alias("score"))


def weakness_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    w = open_weaknesses(spark.createDataFrame([(SNAPSHOT,)], "doc string"), "doc")
    return w.select("ord", "weakness_code", "severity", "count", F.array_join("domains", ",").alias("domains"))


def auto_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles made of project manifests."""
    p = auto_profiles(spark.createDataFrame(MANIFESTS, "project string, file string, content string"))
    return p.select("name", F.array_join("keywords", ",").alias("keywords"), "keyword_count", "score_threshold")


QUERIES = {f.__name__: f for f in (alias_probe_any, priority_rank, recent_embeddings, entry_source_lookup, sources_of_accepted, profile_source_items, archived_profiles, scope_hashes, count_sources, finding_lookup, usefulness_rank, scan_history_per_profile, topk_per_profile, run_counters, run_report, poll_summary, outcomes_in_order, score_display, finding_hypotheses, obligation_replies, answer_scores, weakness_snapshot, auto_profile)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_P = " UNION ALL ".join(f"SELECT {_q(n)} AS name, {k!r} AS keywords, {s!r}::VARCHAR[] AS sources, {'NULL' if a is None else _q(a)} AS archived_at" for n, k, s, a in PROFILES)
_NEW = f"(SELECT * FROM entries WHERE id NOT IN (SELECT entry_id FROM ({ranking._STORED})))"
_IDS = "list_filter(list_concat({0}), lambda x: x IS NOT NULL AND x <> '')"


def _many(path: str) -> str:
    return f"CASE WHEN json_type(p, '{path}') = 'ARRAY' THEN list_transform(CAST(json_extract(p, '{path}') AS JSON[]), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' END) ELSE [] END"


def _one(path: str) -> str:
    return f"CASE WHEN json_type(p, '{path}') = 'VARCHAR' THEN json_extract_string(p, '{path}') END"


_LISTED = "CASE WHEN json_type(p, '$.obligations') = 'ARRAY' THEN list_transform(CAST(json_extract(p, '$.obligations') AS JSON[]), lambda x: CASE WHEN json_type(x, '$.id') = 'VARCHAR' THEN x->>'$.id' END) ELSE [] END"
_ALL = f"list_concat(list_concat(list_concat(list_concat({_many('$.obligation_ids')}, [{_one('$.obligation_id')}]), {_many('$.data.obligation_ids')}), [{_one('$.data.obligation_id')}]), {_LISTED})"
_HYP_W = "SELECT ord - 1 AS ord, w.weakness_code AS code, coalesce(w.domains, []) AS domains, w.latest_summary AS summary, w.severity AS severity, w.count AS count FROM (SELECT unnest(o) AS w, generate_subscripts(o, 1) AS ord FROM (SELECT from_json(json_extract(" + _q(SNAPSHOT) + "::JSON, '$.open_obligations'), '[{\"weakness_code\":\"VARCHAR\",\"severity\":\"VARCHAR\",\"count\":\"INT\",\"domains\":[\"VARCHAR\"],\"latest_summary\":\"VARCHAR\"}]') AS o))"
SQL = {
    "alias_probe_any": "WITH i AS (SELECT rec_id, external_ids.arxiv_id AS ax, external_ids.doi AS doi FROM s2_papers UNION ALL SELECT rec_id, arxiv_id, NULL FROM arxiv_papers) SELECT rec_id, coalesce(ax IN (SELECT arxiv_id FROM oa_works WHERE arxiv_id IS NOT NULL), false) OR coalesce(doi IN (SELECT doi FROM oa_works WHERE doi IS NOT NULL), false) AS known FROM i",
    "priority_rank": "SELECT id, priority, row_number() OVER (ORDER BY priority DESC, id) - 1 AS rank FROM (SELECT id, round(priority_score::DOUBLE, 4) AS priority FROM findings WHERE is_actionable)",
    "recent_embeddings": "SELECT id, len(embedding)::INT AS places, round(embedding[1]::DOUBLE, 5) AS first_place FROM (SELECT * FROM findings ORDER BY discovered_at DESC, id LIMIT 1000) WHERE embedding IS NOT NULL",
    "entry_source_lookup": "SELECT e.id, coalesce(s.title, e.id) AS heading, s.url FROM entries e LEFT JOIN sources s ON s.id = e.source_id",
    "sources_of_accepted": "SELECT e.id, s.source_type FROM entries e JOIN sources s ON s.id = e.source_id WHERE relevance_score >= 0.6",
    "profile_source_items": f"WITH p AS ({_P}) SELECT name, count(*) AS placeholders FROM p JOIN sources s ON len(p.sources) = 0 OR list_contains(p.sources, s.source_type) WHERE archived_at IS NULL AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.source_id = s.id) GROUP BY name",
    "archived_profiles": f"SELECT name, archived_at IS NOT NULL AS archived FROM ({_P})",
    "scope_hashes": f"SELECT name, 's2_' || substr(sha256(array_to_string(list_sort(keywords), chr(1))), 1, 16) AS scope FROM ({_P})",
    "count_sources": "SELECT count(*) AS sources FROM sources",
    "finding_lookup": "SELECT id, title, urgency FROM findings WHERE id = (SELECT min(id) FROM findings)",
    "usefulness_rank": f"SELECT source_kind, usefulness, row_number() OVER (ORDER BY usefulness DESC, source_kind) - 1 AS rank FROM ({outcomes.SQL['source_usefulness']})",
    "scan_history_per_profile": f"SELECT profile_id, id, status, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, id DESC) AS rank FROM ({jobs._JOBS})) WHERE rank <= 3",
    "topk_per_profile": f"SELECT source_type, id, score, rank::INT AS rank FROM (SELECT s.source_type, e.id, e.score, row_number() OVER (PARTITION BY s.source_type ORDER BY e.score DESC, e.ingest_seq DESC) AS rank FROM ({ranking._scored_sql('entries')}) e JOIN sources s ON s.id = e.source_id WHERE e.score >= {ranking.THRESHOLD}) WHERE rank <= 10",
    "run_counters": f"SELECT (SELECT count(*) FROM entries) AS fetched, (SELECT count(*) FROM {_NEW}) AS candidates, count(*) AS deduped, count(*) FILTER (score > 0) AS scored, count(*) FILTER (score >= {ranking.THRESHOLD}) AS accepted FROM ({ranking._scored_sql('(' + ranking._NEWEST.format(_NEW) + ')')})",
    "run_report": "SELECT batch_no, entries, accepted, unscored, CASE WHEN accepted = 0 THEN 'nothing accepted' ELSE 'ok' END AS remark FROM (SELECT batch_no, count(*) AS entries, count(*) FILTER (relevance_score >= 0.6) AS accepted, count(*) FILTER (relevance_score IS NULL) AS unscored FROM entries GROUP BY batch_no)",
    "poll_summary": f"SELECT count(*) AS polled, count(*) FILTER (disposition = 'favorable') AS favorable, count(*) FILTER (disposition = 'unfavorable') AS unfavorable, count(*) FILTER (disposition = 'pending') AS pending FROM ({outcomes.SQL['reduce_dispositions']})",
    "outcomes_in_order": f"SELECT id, outcome, published_at, row_number() OVER (ORDER BY published_at, id) - 1 AS place FROM ({outcomes._PUBLISHED})",
    "score_display": "SELECT id, CASE WHEN s >= 0.9 THEN 16711680 WHEN s >= 0.7 THEN 16747520 WHEN s >= 0.5 THEN 16766720 ELSE 8421504 END AS colour, round_even(s * 100, 0)::INT || '%' AS label FROM (SELECT id, round(relevance_score, 3) AS s FROM entries WHERE relevance_score IS NOT NULL)",
    "finding_hypotheses": f"WITH w AS ({_HYP_W}), m AS (SELECT f.id, min(w.ord) AS ord FROM findings f JOIN w ON list_contains(w.domains, f.domain) OR contains(lower(concat_ws(' ', f.title, f.summary)), lower(w.code)) OR len(list_filter(regexp_split_to_array(lower(w.code), '[_\\-\\s]+'), lambda x: length(x) > 2 AND contains(lower(concat_ws(' ', f.title, f.summary)), x))) > 0 GROUP BY f.id) SELECT f.id, replace(lower(f.domain), ' ', '-') AS slug, CASE WHEN w.code IS NULL THEN 'This applies to the monitored system: ' || f.title ELSE 'Addresses weakness ' || w.code || ': ' || coalesce(w.summary, '') || ' — ' || f.title END AS hypothesis FROM findings f LEFT JOIN m ON m.id = f.id LEFT JOIN w ON w.ord = m.ord",
    "obligation_replies": "SELECT n, array_to_string(CASE WHEN p IS NULL THEN [] ELSE list_filter(" + _ALL + ", lambda x: x IS NOT NULL AND x <> '') END, ',') AS ids, CASE WHEN json_exists(p, '$.status') THEN " + _one("$.status") + " WHEN json_exists(p, '$.data.status') THEN " + _one("$.data.status") + " WHEN json_exists(p, '$.obligation.status') THEN " + _one("$.obligation.status") + " END AS status FROM (SELECT n, TRY_CAST(reply AS JSON) AS p FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(REPLIES)) + ") t(n, reply))",
    "answer_scores": "SELECT n, CASE WHEN v IS NOT NULL THEN least(1.0, greatest(0.0, v)) END::DOUBLE AS score FROM (SELECT n, TRY_CAST(json_extract_string(TRY_CAST(trim(regexp_replace(trim(answer), '^```(?:json)?\\s*|\\s*```$', '', 'g'), E' \\n') AS JSON), '$.score') AS DOUBLE) AS v FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(ANSWERS)) + ") t(n, answer))",
    "weakness_snapshot": f"SELECT ord::INT AS ord, code AS weakness_code, severity, count, array_to_string(domains, ',') AS domains FROM ({_HYP_W})",
}
