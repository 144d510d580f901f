"""Queries on feed records and JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions.scoring import local_embeddings
from signalloom.functions.text import from_inverted, squeezed, tokens, truncated
from signalloom.operators.feedback import linked
from signalloom.sources.feeds import advisory_matches, as_entries
from signalloom.sources.tables import table

ANSWER = "struct<score:double,reason:string>"


def substring_advisory_match(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rustsec_advisories").where(advisory_matches(["memory", "sandbox"])).select("rec_id", "package")


def abstract_reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries through an inverted index of their words and back."""
    t = table(spark, folder, "arxiv_papers").select("rec_id", squeezed(F.col("summary")).alias("text")).where("text <> ''")
    each = t.select("rec_id", F.posexplode(F.split("text", " ")).alias("pos", "w")).groupBy("rec_id", "w").agg(F.collect_list("pos").alias("at"))
    index = each.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("rec_id", from_inverted(F.col("index")).alias("text"))


def llm_json_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Scores in model answers, with or without a code fence; what can't be read gives null."""
    f = table(spark, folder, "findings").select("id", F.when(F.col("confidence") > 0.8, F.concat(F.lit("```json\n{\"score\": "), F.round(F.col("confidence").cast("double") * 1.2, 4).cast("string"), F.lit("}\n```"))).when(F.col("confidence") > 0.2, F.concat(F.lit('{"score": '), F.round(F.col("confidence").cast("double"), 4).cast("string"), F.lit("}"))).otherwise("no answer").alias("answer"))
    body = F.trim(F.regexp_replace("answer", r"(?s)^```(?:json)?\s*|\s*```$", ""))
    score = F.from_json(body, ANSWER)["score"]
    return f.select("id", F.when(score.isNotNull(), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4)).alias("score"))


def obligation_id_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Obligation ids from the places a reply may hold them, in order, blanks dropped."""
    f = table(spark, folder, "findings").select("id", F.to_json(F.struct(F.col("related_entry_ids").alias("obligation_ids"), F.when(F.col("urgency") == "high", F.col("id")).alias("obligation_id"))).alias("reply"))
    p = F.from_json("reply", "struct<obligation_ids:array<string>,obligation_id:string>")
    ids = F.concat(F.coalesce(p["obligation_ids"], F.array().cast("array<string>")), F.array(p["obligation_id"]))
    kept = F.filter(ids, lambda x: x.isNotNull() & (x != ""))
    return f.select("id", F.size(kept).alias("n"), F.array_join(kept, ",").alias("obligations"))


def release_entries(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "github_releases")
    return r.select("rec_id", F.concat(F.coalesce("full_name", F.lit("")), F.lit(" "), F.coalesce("tag_name", F.lit("")), F.lit(": "), F.coalesce("name", "tag_name", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("content"))


def paper_entries(spark: SparkSession, folder: str) -> DataFrame:
    return as_entries(table(spark, folder, "arxiv_papers"), "title", "summary", "authors", "categories").select("rec_id", "content")


def utf8_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", truncated(F.col("text"), 120).alias("head"), truncated(F.col("text"), 120, True).alias("preview"))


def local_embedding_norm(spark: SparkSession, folder: str) -> DataFrame:
    v = local_embeddings(table(spark, folder, "entries").select("id", "content"), "id", "content")
    return v.select("id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), 4).alias("norm"))


def export_findings_json(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 best actionable findings as one JSON envelope; the confidence filter comes after the limit."""
    from signalloom.plans.outcomes import actionable_findings

    f = table(spark, folder, "findings")
    best = actionable_findings(spark, folder).select("id").join(f, "id").where("confidence >= 0.6")
    row = F.struct("id", "title", "summary", "domain", "source_url", "source_title", "urgency", F.col("confidence").cast("double").alias("confidence"), F.col("priority_score").cast("double").alias("priority_score"), "suggested_action", "applicability_tags", "cited_paper", "discovered_at")
    return best.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(row)).alias("findings")).select(F.to_json(F.struct(F.lit("signalloom").alias("source"), F.col("n").alias("count"), "findings")).alias("envelope"))


def publish_payload_json(spark: SparkSession, folder: str) -> DataFrame:
    """The document each finding is published as: what it may do, how new it is, and the weakness it is linked to or the gap it names."""
    from signalloom.plans.outcomes import WEAKNESSES

    f = table(spark, folder, "findings")
    codes = linked(f.select("id", "domain", F.concat_ws(" ", "title", "summary").alias("text")), spark.createDataFrame(WEAKNESSES, "ord int, weakness_code string, domains array<string>"))
    f = f.join(codes, "id").withColumn("hypothesis", F.concat_ws("", "summary", F.lit(" — "), "suggested_action", F.lit(" (domain: "), "domain", F.lit(")")))
    d = lambda c: F.col(c).cast("double").alias(c)
    gap = F.when(F.col("weakness_code").isNull(), F.col("title"))
    kind = F.when(F.col("weakness_code").isNull(), "propose_capability_gap").otherwise("strengthen_existing")
    link = F.struct(gap.alias("gap_summary"), kind.alias("link"), "weakness_code")
    # A finding whose novelty was never measured counts as half new.
    inner = F.struct("applicability_tags", F.col("hypothesis").alias("applicability_hypothesis"), F.col("cited_paper").alias("citation"), d("confidence"), "discovered_at", "domain", F.col("id").alias("finding_id"), d("impact_weight"), F.lit(0.5).alias("novelty_score"), F.col("urgency").alias("proposed_urgency"), "schema_version", F.col("source_type").alias("source_kind"), "source_title", "source_url", "suggested_action", "summary", "title", link.alias("weakness_link"))
    return f.select("id", F.to_json(F.struct(F.lit("v1").alias("contract_version"), inner.alias("finding"), F.lit("signalloom").alias("producer"))).alias("payload"))


def manifest_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 longest words of release names and notes, as a profile's keywords."""
    t = table(spark, folder, "github_releases").select(F.explode(F.array_distinct(tokens(F.concat_ws(" ", "name", "body")))).alias("w"))
    w = t.where(F.col("w").rlike(r"^[a-z][a-z0-9_\-]{3,}$")).distinct()
    return w.orderBy(F.desc(F.length("w")), "w").limit(25).select(F.col("w").alias("keyword"))


QUERIES = {f.__name__: f for f in (substring_advisory_match, abstract_reconstruct, llm_json_extract, obligation_id_extract, release_entries, paper_entries, utf8_truncate, local_embedding_norm, export_findings_json, publish_payload_json, manifest_keywords)}
_ADVISORY = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(package, ''), coalesce(array_to_string(categories, ' '), '')))"
SQL = {
    "substring_advisory_match": f"SELECT rec_id, package FROM rustsec_advisories WHERE contains({_ADVISORY}, 'memory') OR contains({_ADVISORY}, 'sandbox')",
    "abstract_reconstruct": "SELECT rec_id, t AS text FROM (SELECT rec_id, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS t FROM arxiv_papers) WHERE t <> ''",
    "llm_json_extract": "SELECT id, CASE WHEN confidence > 0.8::FLOAT THEN round(least(1, round(confidence::DOUBLE * 1.2::DOUBLE, 4)), 4) WHEN confidence > 0.2::FLOAT THEN round(confidence::DOUBLE, 4) END::DOUBLE AS score FROM findings",
    "obligation_id_extract": "SELECT id, len(o)::INT AS n, array_to_string(o, ',') AS obligations FROM (SELECT id, list_filter(coalesce(related_entry_ids, []) || [CASE WHEN urgency = 'high' THEN id END], lambda x: x IS NOT NULL AND x <> '') AS o FROM findings)",
    "release_entries": "SELECT rec_id, coalesce(full_name, '') || ' ' || coalesce(tag_name, '') || ': ' || coalesce(name, tag_name, '') || chr(10) || chr(10) || coalesce(body, '') AS content FROM github_releases",
    "paper_entries": "SELECT rec_id, coalesce(title, '') || chr(10) || chr(10) || coalesce(summary, '') || chr(10) || CASE WHEN len(authors) > 0 THEN chr(10) || 'Authors: ' || array_to_string(authors, ', ') ELSE '' END || CASE WHEN len(categories) > 0 THEN chr(10) || 'Categories: ' || array_to_string(categories, ', ') ELSE '' END AS content FROM arxiv_papers",
}
_WORDS = "SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', name, body)), '[^\\p{L}\\p{N}''\\-]+'), lambda x: x <> '')) AS w FROM github_releases"
SQL["manifest_keywords"] = f"SELECT w AS keyword FROM ({_WORDS}) WHERE regexp_full_match(w, '[a-z][a-z0-9_\\-]{{3,}}') ORDER BY length(w) DESC, w LIMIT 25"


def _prefix(room: int) -> str:
    return f"substr(text, 1, list_max(list_filter(range(0, {room + 1}), lambda k: strlen(substr(text, 1, k)) <= {room})))"


def _cut(prefix: str, dots: str = "") -> str:
    return f"CASE WHEN strlen(text) <= 120 THEN text ELSE coalesce(nullif(regexp_extract({prefix}, '(?s)^(.*)\\s', 1), ''), {prefix}) || '{dots}' END"


SQL["utf8_truncate"] = f"SELECT doc_id, {_cut('a')} AS head, {_cut('b', '...')} AS preview FROM (SELECT doc_id, text, {_prefix(120)} AS a, {_prefix(117)} AS b FROM documents)"
