"""The tables of the store: columns and keys.

Fixed values: the data model.  Instants are timestamps in UTC; what the payloads
hold as JSON text stays text.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from signalloom.sources.store import Table

#: Table -> (columns, key).
TABLES: dict[str, tuple[str, list[str]]] = {
    "sources": ("id string, url string, title string, source_type string, added_at timestamp", ["id"]),
    "entries": ("id string, ingest_seq bigint, source_id string, content string, summary string, tags array<string>, relevance_score double, last_reread_at timestamp", ["id"]),
    "queries": ("id string, query_text string, created_at timestamp", ["id"]),
    "results": ("id string, query_id string, entry_id string, score double, retrieved_at timestamp", ["id"]),
    "profiles": ("id string, name string, keywords array<string>, negative_keywords array<string>, sources array<string>, scoring_prompt string, score_threshold double, max_llm_calls int, revision int, last_seen_at timestamp, archived_at timestamp, created_at timestamp", ["id"]),
    "scan_jobs": ("id string, profile_id string, status string, progress int, total int, reason string, attempt_count int, profile_revision_at_enqueue int, warnings_json string, error_json string, progress_json string, created_at timestamp, completed_at timestamp", ["id"]),
    "item_scores": ("id string, entry_id string, profile_id string, score double, disposition string", ["entry_id", "profile_id"]),
    "notifications": ("id string, profile_id string, item_id string, channel string, sent_at timestamp", ["profile_id", "item_id", "channel"]),
    "source_watermarks": ("id string, profile_id string, source_type string, source_scope_hash string, last_fetched_at timestamp, last_item_published_at timestamp, gap_skipped boolean", ["profile_id", "source_type", "source_scope_hash"]),
    "item_aliases": ("id string, item_id string, alias_type string, alias_value string, source_type string, created_at timestamp", ["alias_type", "alias_value"]),
    "source_health": ("source_type string, last_success_at timestamp, last_error_at timestamp, last_error_category string, consecutive_failures int, current_lag_seconds bigint, last_gap_skipped_at timestamp, rate_limit_until timestamp", ["source_type"]),
    "published_findings": ("finding_id string, obligation_ids array<string>, source_kind string, domain string, confidence double, novelty double, weakness_code string, outcome string, published_at timestamp, last_polled_at timestamp", ["finding_id"]),
    "findings": ("id string, source_url string, source_title string, source_type string, domain string, title string, summary string, confidence float, impact_weight float, urgency string, priority_score float, is_actionable boolean, suggested_action string, applicability_tags array<string>, cited_paper struct<title:string,authors:string,year:int,url:string,venue:string>, discovered_at timestamp, related_entry_ids array<string>, schema_version string, embedding array<float>", ["id"]),
}
#: Tables whose rows go when a profile goes.
OF_PROFILE = ["scan_jobs", "item_scores", "notifications", "source_watermarks"]


def store_table(spark: SparkSession, folder: str, name: str) -> Table:
    schema, key = TABLES[name]
    return Table(spark, folder, name, schema, key)


def delete_profiles(spark: SparkSession, folder: str, ids: list[str]) -> None:
    """Profiles go last, so that a run that dies half way can be run again."""
    gone = spark.createDataFrame([(i,) for i in ids], "profile_id string")
    for name in OF_PROFILE:
        t = store_table(spark, folder, name)
        t.delete(t.rows().join(gone, "profile_id", "left_semi"))
    store_table(spark, folder, "profiles").delete(gone.withColumnRenamed("profile_id", "id"))
