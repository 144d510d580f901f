"""Queries on entries: keyword scores, search, incremental scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions.scoring import contains_any, urgency_of, with_keyword_score
from signalloom.functions.text import token_text
from signalloom.operators.backends import with_scores
from signalloom.operators.relational import newest_of_each_text, page, ranked, unseen
from signalloom.sources.storage import written
from signalloom.sources.tables import table

KEYWORDS = ["compiler", "under heavy load", "token budget", "inference"]
NEGATIVES = ["weakness ledger"]
THRESHOLD = 0.25


def scored(df: DataFrame, keywords=KEYWORDS, negatives=NEGATIVES) -> DataFrame:
    """Adds score; the tokens of a row are made once."""
    return with_keyword_score(df, "content", "summary", keywords, negatives).withColumn("score", F.round("score", 6))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entries").select("id", "ingest_seq", "source_id", "content", "summary", "relevance_score")


def _stored_scores(spark: SparkSession, folder: str) -> DataFrame:
    """item_scores as an earlier scan left them: every second entry with a relevance."""
    e = _entries(spark, folder).where("relevance_score is not null and ingest_seq % 2 = 0")
    return e.select(F.col("id").alias("entry_id"), F.round("relevance_score", 6).alias("score"), F.when(F.col("relevance_score") >= 0.5, "new").otherwise("filtered").alias("disposition"))


def keyword_score_rank(spark: SparkSession, folder: str) -> DataFrame:
    s = scored(_entries(spark, folder)).where("score > 0")
    return s.select("id", "score", F.when(F.col("score") >= THRESHOLD, "new").otherwise("filtered").alias("disposition"), urgency_of(F.col("score")).alias("urgency"))


def keyword_score_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return scored(_entries(spark, folder), ["vector store", "citation graph under heavy load"], []).select("id", "score")


def negative_keyword_filter(spark: SparkSession, folder: str) -> DataFrame:
    e = _entries(spark, folder)
    return e.where(contains_any(token_text(F.col("content")), NEGATIVES) | contains_any(token_text(F.col("summary")), NEGATIVES)).select("id")


def search_entries_like(spark: SparkSession, folder: str) -> DataFrame:
    p = "%Token_Budget%"
    return _entries(spark, folder).where(F.col("content").ilike(p) | F.col("summary").ilike(p)).select("id", "source_id")


def list_entries_in(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "sources").where("source_type = 'release'").select(F.col("id").alias("source_id"))
    return _entries(spark, folder).join(wanted, "source_id", "left_semi").select("id", "source_id")


def items_by_profile_page(spark: SparkSession, folder: str) -> DataFrame:
    s = _stored_scores(spark, folder).where("disposition = 'new' and score >= 0.6")
    j = s.join(_entries(spark, folder).select("id", "source_id"), F.col("entry_id") == F.col("id"))
    return page(j.select("entry_id", "source_id", "score"), [F.desc("score"), F.asc("entry_id")], 20, 10)


def unscored_entries_anti(spark: SparkSession, folder: str) -> DataFrame:
    return unseen(_entries(spark, folder), _stored_scores(spark, folder), "id", "entry_id").select("id", "ingest_seq")


def dedup_normalized_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return newest_of_each_text(_entries(spark, folder).select("id", "ingest_seq", "content"), "content", "ingest_seq").select("id", "ingest_seq")


def incremental_scan_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Unscored entries, one per text, scored; zero scores aren't kept; the 500 newest-best as candidates."""
    new = unseen(_entries(spark, folder), _stored_scores(spark, folder), "id", "entry_id")
    s = scored(newest_of_each_text(new, "content", "ingest_seq")).where("score > 0")
    s = s.select("id", "ingest_seq", "score", F.when(F.col("score") >= THRESHOLD, "new").otherwise("filtered").alias("disposition"))
    return ranked(s, [F.desc("score"), F.desc("ingest_seq")], 500)


def text_length(texts: Sequence[str]) -> list[float]:
    """Stands in for a costly scorer."""
    return [len(t) / 1000 for t in texts]


def llm_topk_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best get a second score, which overrides the first; the rest keep theirs."""
    s = scored(_entries(spark, folder)).where("score > 0").select("id", "ingest_seq", "score")
    # Written, so that the texts are scored once for both uses.
    s = written(s, "scored")
    top = page(s.where(F.col("score") >= THRESHOLD), [F.desc("score"), F.desc("ingest_seq")], 10)
    texts = table(spark, folder, "entries").select(F.col("id").alias("sid"), "content").join(F.broadcast(top.select(F.col("id").alias("sid"))), "sid", "left_semi")  # ten rows
    second = with_scores(texts, "sid", "content", text_length).select("sid", F.round("score", 6).alias("llm"))
    j = s.join(second, s.id == second.sid, "left")
    final = F.coalesce("llm", "score")
    return j.select("id", final.alias("score"), F.when(F.col("llm").isNull(), "keyword").when(F.col("llm") >= 0.5, "matched").otherwise("scored_below_threshold").alias("disposition"))


def placeholder_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Sources without entries get one made of their title."""
    s = table(spark, folder, "sources").select(F.col("id").alias("source_id"), "title", "url")
    return s.join(_entries(spark, folder).select("source_id").distinct(), "source_id", "left_anti").select("source_id", F.coalesce("title", "url").alias("content"))


# The same in DuckDB.
_TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}''\\-]+'), lambda x: x <> '')"


def _count(toks: str, phrase: str) -> str:
    ws = phrase.lower().split()
    if len(ws) == 1:
        return f"len(list_filter({toks}, lambda x: x = '{ws[0]}'))"
    needle = "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    return f"len(list_filter(range(1, greatest(len({toks}) - {len(ws)} + 2, 1)), lambda i: {toks}[i:i + {len(ws) - 1}] = {needle}))"


def _score_sql(keywords, negatives) -> str:
    parts = []
    for k in keywords:
        c, s = _count("c", k), _count("s", k)
        share = 1.0 / len(keywords)
        parts.append(f"CASE WHEN {c} > 0 OR {s} > 0 THEN least({share!r}::DOUBLE * (1 + greatest(least({c}, 3) - 1, 0) * 0.1::DOUBLE + CASE WHEN {c} > 0 AND {s} > 0 THEN 0.15::DOUBLE ELSE 0 END), {share * 1.4!r}::DOUBLE) ELSE 0 END")
    neg = " OR ".join(f"{_count('c', n)} > 0 OR {_count('s', n)} > 0" for n in negatives) or "false"
    return f"round(CASE WHEN {neg} THEN 0 ELSE least(1.0::DOUBLE, {' + '.join(parts)}) END, 6)::DOUBLE"


def _scored_sql(source: str, keywords=KEYWORDS, negatives=NEGATIVES) -> str:
    return f"SELECT *, {_score_sql(keywords, negatives)} AS score FROM (SELECT *, {_TOK.format('content')} AS c, {_TOK.format('summary')} AS s FROM {source})"


_STORED = "SELECT id AS entry_id, round(relevance_score, 6) AS score, CASE WHEN relevance_score >= 0.5 THEN 'new' ELSE 'filtered' END AS disposition FROM entries WHERE relevance_score IS NOT NULL AND ingest_seq % 2 = 0"
_NEWEST = "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) ORDER BY ingest_seq DESC) AS rn FROM {0}) WHERE rn = 1"
_URGENCY = "CASE WHEN score >= 0.95 THEN 'critical' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END"

QUERIES = {f.__name__: f for f in (keyword_score_rank, keyword_score_phrase, negative_keyword_filter, search_entries_like, list_entries_in, items_by_profile_page, unscored_entries_anti, dedup_normalized_first_wins, incremental_scan_pipeline, llm_topk_merge, placeholder_entries)}
SQL = {
    "keyword_score_rank": f"SELECT id, score, CASE WHEN score >= {THRESHOLD} THEN 'new' ELSE 'filtered' END AS disposition, {_URGENCY} AS urgency FROM ({_scored_sql('entries')}) WHERE score > 0",
    "keyword_score_phrase": f"SELECT id, score FROM ({_scored_sql('entries', ['vector store', 'citation graph under heavy load'], [])})",
    "negative_keyword_filter": f"SELECT id FROM (SELECT id, {_TOK.format('content')} AS c, {_TOK.format('summary')} AS s FROM entries) WHERE {_count('c', NEGATIVES[0])} > 0 OR {_count('s', NEGATIVES[0])} > 0",
    "search_entries_like": "SELECT id, source_id FROM entries WHERE content ILIKE '%Token_Budget%' OR summary ILIKE '%Token_Budget%'",
    "list_entries_in": "SELECT id, source_id FROM entries WHERE source_id IN (SELECT id FROM sources WHERE source_type = 'release')",
    "items_by_profile_page": f"SELECT entry_id, e.source_id, s.score FROM ({_STORED}) s JOIN entries e ON e.id = s.entry_id WHERE disposition = 'new' AND s.score >= 0.6 ORDER BY s.score DESC, entry_id LIMIT 20 OFFSET 10",
    "unscored_entries_anti": f"SELECT id, ingest_seq FROM entries e WHERE NOT EXISTS (SELECT 1 FROM ({_STORED}) s WHERE s.entry_id = e.id)",
    "dedup_normalized_first_wins": f"SELECT id, ingest_seq FROM ({_NEWEST.format('entries')})",
    "incremental_scan_pipeline": f"SELECT id, ingest_seq, score, CASE WHEN score >= {THRESHOLD} THEN 'new' ELSE 'filtered' END AS disposition, row_number() OVER (ORDER BY score DESC, ingest_seq DESC)::INT AS rank FROM ({_scored_sql('(' + _NEWEST.format(f'(SELECT * FROM entries WHERE id NOT IN (SELECT entry_id FROM ({_STORED})))') + ')')}) WHERE score > 0 ORDER BY score DESC, ingest_seq DESC LIMIT 500",
    "llm_topk_merge": f"WITH s AS (SELECT id, ingest_seq, content, score FROM ({_scored_sql('entries')}) WHERE score > 0), t AS (SELECT id, round(least(1.0, length(content) / 1000), 6) AS llm FROM (SELECT * FROM s WHERE score >= {THRESHOLD} ORDER BY score DESC, ingest_seq DESC LIMIT 10)) SELECT s.id, coalesce(llm, score) AS score, CASE WHEN llm IS NULL THEN 'keyword' WHEN llm >= 0.5 THEN 'matched' ELSE 'scored_below_threshold' END AS disposition FROM s LEFT JOIN t ON t.id = s.id",
    "placeholder_entries": "SELECT id AS source_id, coalesce(title, url) AS content FROM sources s WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.source_id = s.id)",
}
