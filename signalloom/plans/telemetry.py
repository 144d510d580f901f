"""Queries on sources, aliases and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions.scoring import backoff_seconds
from signalloom.functions.text import arxiv_from_doi, plain_doi
from signalloom.operators.relational import first_wins
from signalloom.operators.state import advanced, broken, failures_in_a_row, past_watermark, within_budget
from signalloom.sources.tables import table

FEEDS = [("s2_papers", "external_ids.arxiv_id", "external_ids.doi"), ("oa_works", "arxiv_id", "doi"), ("arxiv_papers", "arxiv_id", None)]


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, alias_type, alias_value, source_type, seq from the hard ids of the feeds; an item is a normalised title."""
    out = []
    for name, ax, doi in FEEDS:
        rows = table(spark, folder, name)
        for kind, col in (("arxiv_id", ax), ("doi", doi)):
            if col:
                out.append(rows.select(F.md5(F.lower(F.trim("title"))).alias("item_id"), F.lit(kind).alias("alias_type"), F.col(col).alias("alias_value"), F.lit(name).alias("source_type"), F.col("rec_id").alias("seq")))
    return reduce(DataFrame.unionByName, out).where("alias_value is not null")


_ALIASES = " UNION ALL ".join(
    f"SELECT md5(lower(trim(title))) AS item_id, '{kind}' AS alias_type, {col} AS alias_value, '{name}' AS source_type, rec_id AS seq FROM {name} WHERE {col} IS NOT NULL"
    for name, ax, doi in FEEDS
    for kind, col in (("arxiv_id", ax), ("doi", doi))
    if col
)


def source_health_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sources")
    e = table(spark, folder, "entries")
    # Entries are summed up per source before the join, so the source that holds a tenth of them is one row.
    per = e.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("relevance_score").alias("sum"), F.count("relevance_score").alias("k"))
    g = s.join(per, s.id == per.source_id, "left").groupBy("source_type").agg(F.max("added_at").alias("last_added_at"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), (F.sum("sum") / F.sum("k")).alias("avg"))
    return g.select("source_type", "last_added_at", "entries", F.round(F.coalesce("avg", F.lit(0.0)), 6).alias("avg_relevance"), F.when(F.col("entries") > 0, "ready").otherwise("empty").alias("status"))


def alias_counts(spark: SparkSession, folder: str) -> DataFrame:
    return aliases(spark, folder).groupBy("source_type").agg(F.count("*").alias("aliases"))


def unique_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """Items that only one source knows, per source: a group per item instead of a correlated NOT IN."""
    one = aliases(spark, folder).groupBy("item_id").agg(F.min("source_type").alias("source_type"), F.max("source_type").alias("other")).where("source_type = other")
    return one.groupBy("source_type").agg(F.count("*").alias("unique_items"))


def cross_source_dedup_hits(spark: SparkSession, folder: str) -> DataFrame:
    per = aliases(spark, folder).groupBy("item_id").agg(F.min("source_type").alias("a"), F.max("source_type").alias("b"))
    return per.where("a <> b").agg(F.count("*").alias("dedup_hits"))


def alias_dedup_insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """What an insert-or-ignore on (alias_type, alias_value) adds when the works feed is stored and the others arrive."""
    a = aliases(spark, folder)
    old, new = a.where("source_type = 'oa_works'"), a.where("source_type <> 'oa_works'")
    return first_wins(old, new, ["alias_type", "alias_value"], ["seq", "source_type"]).select("alias_type", "alias_value", "item_id", "source_type")


def doi_normalize(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "oa_works").where("doi is not null").select("rec_id", plain_doi(F.col("doi"), r"doi\.(?:org|example)").alias("doi"))
    return d.select("rec_id", "doi", arxiv_from_doi(F.col("doi")).alias("arxiv_id"))


def circuit_breaker_state(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    f = failures_in_a_row(e, "user_id", F.col("ts"), F.col("event_type") == "error", F.col("event_id"))
    return f.select("user_id", "consecutive_failures", broken(F.col("consecutive_failures"), F.lit(None).cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("broken"), backoff_seconds(F.col("consecutive_failures")).alias("backoff_s"))


def marks_of(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, mark as a run in the middle of January left them."""
    return table(spark, folder, "events").where("ts < timestamp_ntz'2024-01-15'").groupBy("user_id").agg(F.max("ts").alias("mark"))


def _items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type"), marks_of(spark, folder)


def watermark_incremental(spark: SparkSession, folder: str) -> DataFrame:
    items, marks = _items(spark, folder)
    return past_watermark(items, marks, "user_id", "ts", "mark").select("event_id", "user_id")


def watermark_advance(spark: SparkSession, folder: str) -> DataFrame:
    items, marks = _items(spark, folder)
    taken = past_watermark(items, marks, "user_id", "ts", "mark").where("event_type <> 'error'")
    return advanced(marks, taken, "user_id", "ts", "mark").select("user_id", F.col("mark").cast("timestamp_ntz").alias("mark"))


def llm_budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Calls each user makes before a budget of 1200 refuses one; a call without cost is charged 1000."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", F.when(F.coalesce("value", F.lit(0.0)) <= 0, 1000).otherwise(F.floor("value")).cast("long").alias("cost"))
    return within_budget(e, "user_id", [F.col("ts"), F.col("event_id")], F.col("cost"), 1_200).select("event_id", "user_id", "spent_before")


def worker_health(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("cycles"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


QUERIES = {f.__name__: f for f in (source_health_summary, alias_counts, unique_contributions, cross_source_dedup_hits, alias_dedup_insert_ignore, doi_normalize, circuit_breaker_state, watermark_incremental, watermark_advance, llm_budget_prefix, worker_health)}
_MARKS = "SELECT user_id, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id"
SQL = {
    "source_health_summary": "SELECT source_type, max(added_at) AS last_added_at, count(e.id) AS entries, round(coalesce(avg(e.relevance_score), 0), 6) AS avg_relevance, CASE WHEN count(e.id) > 0 THEN 'ready' ELSE 'empty' END AS status FROM sources s LEFT JOIN entries e ON e.source_id = s.id GROUP BY source_type",
    "alias_counts": f"SELECT source_type, count(*) AS aliases FROM ({_ALIASES}) GROUP BY source_type",
    "unique_contributions": f"WITH a AS ({_ALIASES}) SELECT source_type, count(DISTINCT item_id) AS unique_items FROM a WHERE item_id IN (SELECT item_id FROM a GROUP BY item_id HAVING count(DISTINCT source_type) = 1) GROUP BY source_type",
    "cross_source_dedup_hits": f"SELECT count(*) AS dedup_hits FROM (SELECT item_id FROM ({_ALIASES}) GROUP BY item_id HAVING count(DISTINCT source_type) > 1)",
    "alias_dedup_insert_ignore": f"WITH a AS ({_ALIASES}) SELECT alias_type, alias_value, item_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY alias_type, alias_value ORDER BY seq, source_type) AS rn FROM a WHERE source_type <> 'oa_works' AND NOT EXISTS (SELECT 1 FROM a o WHERE o.source_type = 'oa_works' AND o.alias_type = a.alias_type AND o.alias_value = a.alias_value)) WHERE rn = 1",
    "doi_normalize": "SELECT rec_id, d AS doi, nullif(regexp_extract(d, '(?i)^10\\.48550/arxiv\\.(.*)$', 1), '') AS arxiv_id FROM (SELECT rec_id, regexp_replace(doi, '^https?://(?:dx\\.)?doi\\.(?:org|example)/', '') AS d FROM oa_works WHERE doi IS NOT NULL)",
    "circuit_breaker_state": "WITH l AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN {'ts': ts, 'o': event_id} END) AS ok FROM events GROUP BY user_id), f AS (SELECT l.user_id, count(e.event_id) AS n FROM l LEFT JOIN events e ON e.user_id = l.user_id AND e.event_type = 'error' AND (l.ok IS NULL OR {'ts': e.ts, 'o': e.event_id} > l.ok) GROUP BY l.user_id) SELECT user_id, n AS consecutive_failures, n >= 3 AS broken, CASE WHEN n < 5 THEN 0 ELSE least(300, 30 * pow(2, n - 5)) END::INT AS backoff_s FROM f",
    "watermark_incremental": f"SELECT event_id, e.user_id FROM events e LEFT JOIN ({_MARKS}) m ON m.user_id = e.user_id WHERE ts IS NULL OR mark IS NULL OR ts > mark",
    "watermark_advance": f"WITH m AS ({_MARKS}), t AS (SELECT e.user_id, max(ts) AS new FROM events e LEFT JOIN m ON m.user_id = e.user_id WHERE (ts IS NULL OR mark IS NULL OR ts > mark) AND event_type <> 'error' GROUP BY e.user_id) SELECT coalesce(m.user_id, t.user_id) AS user_id, greatest(mark, new) AS mark FROM m FULL JOIN t ON t.user_id = m.user_id",
    "llm_budget_prefix": "SELECT event_id, user_id, spent_before FROM (SELECT event_id, user_id, coalesce(sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM (SELECT event_id, user_id, ts, CASE WHEN coalesce(value, 0) <= 0 THEN 1000 ELSE floor(value) END::BIGINT AS cost FROM events)) WHERE spent_before + 1000 <= 1200",
    "worker_health": "SELECT event_type, count(*) AS cycles, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type",
}
