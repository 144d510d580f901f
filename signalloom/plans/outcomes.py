"""Queries on findings: actionability, novelty, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions.scoring import adjusted, citation, disposition_class, is_actionable, is_critical, priority, urgency_rank
from signalloom.operators.feedback import linked, reduced, useful_by
from signalloom.operators.relational import in_chunks, page, upserted
from signalloom.operators.vectors import novelty
from signalloom.sources.tables import table

# A snapshot of weaknesses: code, domains, severity.
WEAKNESSES = [(0, "memory_safety", ["systems", "compilers"]), (1, "token_budget", ["inference"]), (2, "audit", ["security", "privacy"]), (3, "scheduler-trace", ["scheduling"])]
LEDGER = [(3, "slow review", "open"), (1, "weak probes", "open"), (2, "stale index", "closed"), (5, "no owner", "open"), (4, "few seeds", "open")]


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "findings")


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """published_findings: the outcome follows from the confidence."""
    f = _findings(spark, folder)
    outcome = F.when(F.col("confidence") >= F.lit(0.7).cast("float"), "accepted").when(F.col("confidence") < F.lit(0.3).cast("float"), "rejected").otherwise("pending")
    return f.select("id", F.col("source_type").alias("source_kind"), "domain", outcome.alias("outcome"), F.col("discovered_at").alias("published_at"), "confidence")


_PUBLISHED = "SELECT id, source_type AS source_kind, domain, CASE WHEN confidence >= 0.7::FLOAT THEN 'accepted' WHEN confidence < 0.3::FLOAT THEN 'rejected' ELSE 'pending' END AS outcome, discovered_at AS published_at, confidence FROM findings"


def urgency_priority_rank(spark: SparkSession, folder: str) -> DataFrame:
    p = priority(F.col("urgency"), F.col("confidence"), F.col("impact_weight"))
    return _findings(spark, folder).select("id", urgency_rank(F.col("urgency")).alias("urgency_rank"), F.round(p, 4).alias("priority"), is_critical(F.col("confidence"), F.col("urgency")).alias("critical"))


def actionable_findings(spark: SparkSession, folder: str) -> DataFrame:
    f = _findings(spark, folder).where(is_actionable(F.col("confidence"), F.col("urgency")))
    return page(f.select("id", "title", "urgency", F.round(F.col("priority_score").cast("double"), 4).alias("priority")), [F.desc("priority"), F.asc("id")], 100)


def findings_by_urgency(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).where("urgency = 'high'").select("id", "domain", "discovered_at")


def paper_citation(spark: SparkSession, folder: str) -> DataFrame:
    c = _findings(spark, folder).where("cited_paper is not null").select("id", "cited_paper.*")
    return c.select("id", citation(F.col("title"), F.col("authors"), F.col("year"), F.col("venue"), F.col("url")).alias("citation"))


def source_usefulness(spark: SparkSession, folder: str) -> DataFrame:
    return useful_by(_published(spark, folder), "source_kind")


def domain_usefulness(spark: SparkSession, folder: str) -> DataFrame:
    return useful_by(_published(spark, folder), "domain")


def outcome_totals(spark: SparkSession, folder: str) -> DataFrame:
    p = _published(spark, folder).agg(F.count_if(F.col("outcome") == "accepted").alias("accepted"), F.count_if(F.col("outcome") == "rejected").alias("rejected"), F.count("*").alias("total"))
    return p.withColumn("pending", F.col("total") - F.col("accepted") - F.col("rejected"))


def pending_outcomes_topn(spark: SparkSession, folder: str) -> DataFrame:
    return page(_published(spark, folder).where("outcome = 'pending'").select("id", "published_at"), [F.asc("published_at"), F.asc("id")], 100)


def reduce_dispositions(spark: SparkSession, folder: str) -> DataFrame:
    """Obligations of a finding are its related entries; their status follows from the entry's relevance."""
    f = _findings(spark, folder).select(F.col("id").alias("finding_id"), F.explode_outer("related_entry_ids").alias("entry_id"))
    e = table(spark, folder, "entries").select(F.col("id").alias("entry_id"), F.when(F.col("relevance_score") >= 0.6, " Applied").when(F.col("relevance_score") < 0.5, "BLOCKED").otherwise("open").alias("status"))
    j = f.join(e, "entry_id", "left")
    return reduced(j, "finding_id", disposition_class(F.coalesce("status", F.lit(""))))


def weakness_link_theta(spark: SparkSession, folder: str) -> DataFrame:
    f = _findings(spark, folder).select("id", "domain", F.concat_ws(" ", "title", "summary").alias("text"))
    return linked(f, spark.createDataFrame(WEAKNESSES, "ord int, weakness_code string, domains array<string>"))


def weakness_contexts_union(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts in order: the snapshot's weaknesses, then the ledger's first three by rank; with the findings of each domain."""
    w = spark.createDataFrame(WEAKNESSES, "ord int, code string, domains array<string>").select("ord", "code", "domains")
    ledger = page(spark.createDataFrame(LEDGER, "rank int, code string, status string"), [F.asc("rank")], 3).select((F.col("rank") + 100).alias("ord"), "code", F.array().cast("array<string>").alias("domains"))
    per = _findings(spark, folder).groupBy("domain").agg(F.count("*").alias("n"))
    each = w.unionByName(ledger).withColumn("domain", F.explode_outer("domains"))
    return each.join(per, "domain", "left").groupBy("ord", "code").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


def published_upsert_preserve_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Yesterday's published findings, republished with new confidences: outcome and time stay."""
    p = _published(spark, folder)
    old = p.where("id not like '%3'")
    new = p.where("id like '%1' or id like '%3'").withColumn("outcome", F.lit("pending")).withColumn("confidence", (F.col("confidence") / 2).cast("float"))
    u = upserted(old, new, "id", ["outcome", "published_at"])
    return u.select("id", "source_kind", "domain", "outcome", "published_at", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


def notification_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Findings to announce per domain, without those already sent, in batches of ten."""
    f = _findings(spark, folder).where(F.col("confidence") >= F.lit(0.5).cast("float")).select("id", "domain", "confidence")
    f = f.join(_findings(spark, folder).where("id like '%5'").select("id"), "id", "left_anti")
    return in_chunks(f, "domain", [F.desc("confidence"), F.asc("id")], 10).select("id", "domain", "chunk")


def novelty_max_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Novelty of the stated queries, every vector whose id is divisible by 100, against all other vectors."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    n = novelty(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding")
    return n.select("vec_id", F.round("max_similarity", 5).alias("max_similarity"), F.round("novelty", 5).alias("novelty"))


def evaluation_adjust(spark: SparkSession, folder: str) -> DataFrame:
    f = _findings(spark, folder)
    return f.select("id", F.round(adjusted(F.col("confidence").cast("double"), F.when(F.col("urgency") == "high", 0.1).otherwise(-0.3), F.col("urgency") == "low"), 5).alias("confidence"))


QUERIES = {f.__name__: f for f in (urgency_priority_rank, actionable_findings, findings_by_urgency, paper_citation, source_usefulness, domain_usefulness, outcome_totals, pending_outcomes_topn, reduce_dispositions, weakness_link_theta, weakness_contexts_union, published_upsert_preserve_outcome, notification_batches, novelty_max_cosine, evaluation_adjust)}
_URANK = "CASE urgency WHEN 'low' THEN 0 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE 1 END"


def _useful(key: str) -> str:
    return f"SELECT {key}, accepted, rejected, total - accepted - rejected AS pending, round((accepted + 1) / (accepted + rejected + 2), 6) AS usefulness FROM (SELECT {key}, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) AS total FROM ({_PUBLISHED}) GROUP BY {key})"


_W = " UNION ALL ".join(f"SELECT {o} AS ord, '{c}' AS code, {d!r} AS domains" for o, c, d in WEAKNESSES)
SQL = {
    "urgency_priority_rank": f"SELECT id, {_URANK} AS urgency_rank, round(({_URANK} + 1) * 0.5::DOUBLE + confidence::DOUBLE * 0.3::DOUBLE + impact_weight::DOUBLE * 0.2::DOUBLE, 4) AS priority, {_URANK} = 3 OR confidence >= 0.95::FLOAT AS critical FROM findings",
    "actionable_findings": f"SELECT id, title, urgency, round(priority_score::DOUBLE, 4) AS priority FROM findings WHERE confidence >= 0.4::FLOAT AND {_URANK} > 0 ORDER BY priority DESC, id LIMIT 100",
    "findings_by_urgency": "SELECT id, domain, discovered_at FROM findings WHERE urgency = 'high'",
    "paper_citation": "SELECT id, '\"' || c.title || '\" by ' || c.authors || ' (' || coalesce(c.year::VARCHAR, 'n.d.') || '). ' || CASE WHEN c.venue IS NOT NULL THEN c.venue || ' — ' ELSE '' END || c.url AS citation FROM (SELECT id, cited_paper AS c FROM findings WHERE cited_paper IS NOT NULL)",
    "source_usefulness": _useful("source_kind"),
    "domain_usefulness": _useful("domain"),
    "outcome_totals": f"SELECT accepted, rejected, total, total - accepted - rejected AS pending FROM (SELECT count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) AS total FROM ({_PUBLISHED}))",
    "pending_outcomes_topn": f"SELECT id, published_at FROM ({_PUBLISHED}) WHERE outcome = 'pending' ORDER BY published_at, id LIMIT 100",
    "reduce_dispositions": "WITH f AS (SELECT id AS finding_id, unnest(CASE WHEN related_entry_ids IS NULL OR len(related_entry_ids) = 0 THEN [NULL] ELSE related_entry_ids END) AS entry_id FROM findings), j AS (SELECT finding_id, CASE WHEN relevance_score >= 0.6 THEN 'favorable' WHEN relevance_score < 0.5 THEN 'unfavorable' ELSE 'pending' END AS d FROM f LEFT JOIN entries e ON e.id = f.entry_id) SELECT finding_id, CASE WHEN bool_or(d = 'favorable') THEN 'favorable' WHEN bool_and(d = 'unfavorable') THEN 'unfavorable' ELSE 'pending' END AS disposition FROM j GROUP BY finding_id",
    "weakness_link_theta": f"WITH w AS ({_W}), m AS (SELECT f.id, min(w.ord) AS ord FROM findings f JOIN w ON list_contains(w.domains, f.domain) OR contains(lower(concat_ws(' ', f.title, f.summary)), lower(w.code)) OR len(list_filter(regexp_split_to_array(lower(w.code), '[_\\-\\s]+'), lambda x: length(x) > 2 AND contains(lower(concat_ws(' ', f.title, f.summary)), x))) > 0 GROUP BY f.id) SELECT f.id, w.code AS weakness_code FROM findings f LEFT JOIN m ON m.id = f.id LEFT JOIN w ON w.ord = m.ord",
    "weakness_contexts_union": f"WITH w AS ({_W}), x AS (SELECT ord, code, unnest(domains) AS domain FROM w UNION ALL SELECT rank + 100, code, NULL FROM (VALUES {', '.join(f'({r}, {c!r})' for r, c, _ in sorted(LEDGER)[:3])}) t(rank, code)) SELECT ord, code, coalesce(sum(n), 0)::BIGINT AS findings FROM x LEFT JOIN (SELECT domain, count(*) AS n FROM findings GROUP BY domain) p ON p.domain = x.domain GROUP BY ord, code",
    "published_upsert_preserve_outcome": f"SELECT id, source_kind, domain, CASE WHEN id LIKE '%3' THEN 'pending' ELSE outcome END AS outcome, published_at, round(CASE WHEN id LIKE '%1' OR id LIKE '%3' THEN (confidence::DOUBLE / 2)::FLOAT ELSE confidence END::DOUBLE, 4) AS confidence FROM ({_PUBLISHED})",
    "notification_batches": "SELECT id, domain, ((row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, id) - 1) // 10)::INT AS chunk FROM findings WHERE confidence >= 0.5::FLOAT AND id NOT LIKE '%5'",
    "novelty_max_cosine": "SELECT vec_id, round(s, 5) AS max_similarity, round(least(1, greatest(0, 1 - s)), 5) AS novelty FROM (SELECT q.vec_id, max(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[])) AS s FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id GROUP BY q.vec_id)",
    "evaluation_adjust": "SELECT id, round(least(1::DOUBLE, greatest(0::DOUBLE, confidence::DOUBLE + CASE WHEN urgency = 'high' THEN 0.1::DOUBLE ELSE -0.3::DOUBLE END)) * CASE WHEN urgency = 'low' THEN 0.5::DOUBLE ELSE 1 END, 5) AS confidence FROM findings",
}
