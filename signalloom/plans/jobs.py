"""Queries on scan jobs and state tables; orders stand in for jobs (status O/F/P = pending/running/complete)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.relational import latest, page
from signalloom.sources.tables import table


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "running").otherwise("complete")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("profile_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


_JOBS = "SELECT o_orderkey AS id, o_custkey AS profile_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'running' ELSE 'complete' END AS status, o_orderdate AS created_at FROM orders"


def active_job_latest(spark: SparkSession, folder: str) -> DataFrame:
    active = _jobs(spark, folder).where("status in ('pending', 'running')").select("profile_id", "id", "status", "created_at")
    return latest(active, ["profile_id"], ["created_at", "id"])


def scan_history(spark: SparkSession, folder: str) -> DataFrame:
    return page(_jobs(spark, folder).select("id", "profile_id", "status", "created_at"), [F.desc("created_at"), F.desc("id")], 100)


def upsert_item_score_latest(spark: SparkSession, folder: str) -> DataFrame:
    """item_scores as a change log of (order, part) pairs; the last line wins."""
    log = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("entry_id"), F.col("l_suppkey").alias("profile_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("score"))
    return latest(log, ["entry_id", "profile_id"], ["seq", "line", "score"]).select("entry_id", "profile_id", "score")


def profile_cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left of jobs (orders) after all profiles (customers) of one segment were deleted."""
    gone = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("profile_id"))
    return _jobs(spark, folder).join(gone, "profile_id", "left_anti").groupBy("status").agg(F.count("*").alias("jobs"))


def profile_upsert_enqueue(spark: SparkSession, folder: str) -> DataFrame:
    """One active job per profile: profiles without one get a new job."""
    p = table(spark, folder, "customer").select(F.col("c_custkey").alias("profile_id"))
    active = _jobs(spark, folder).where("status in ('pending', 'running')").select("profile_id").distinct()
    return p.join(active, "profile_id", "left_anti")


QUERIES = {f.__name__: f for f in (active_job_latest, scan_history, upsert_item_score_latest, profile_cascade_delete, profile_upsert_enqueue)}
SQL = {
    "active_job_latest": f"SELECT profile_id, id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, id DESC) AS rn FROM ({_JOBS}) WHERE status IN ('pending', 'running')) WHERE rn = 1",
    "scan_history": f"SELECT id, profile_id, status, created_at FROM ({_JOBS}) ORDER BY created_at DESC, id DESC LIMIT 100",
    "upsert_item_score_latest": "SELECT entry_id, profile_id, score FROM (SELECT l_partkey AS entry_id, l_suppkey AS profile_id, l_discount AS score, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_discount DESC) AS rn FROM lineitem) WHERE rn = 1",
    "profile_cascade_delete": f"SELECT status, count(*) AS jobs FROM ({_JOBS}) WHERE profile_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY status",
    "profile_upsert_enqueue": f"SELECT c_custkey AS profile_id FROM customer WHERE c_custkey NOT IN (SELECT profile_id FROM ({_JOBS}) WHERE status IN ('pending', 'running'))",
}
