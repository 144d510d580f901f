"""State as change logs: circuit breaker, watermarks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from signalloom.sources.storage import written

BREAK_AT = 3


def failures_in_a_row(log: DataFrame, key: str, ts: Column, failed: Column, order: Column) -> DataFrame:
    """key, consecutive_failures, last_success_at, last_error_at: failures after the last success.

    Two aggregations and a join on the key instead of a window, so that a key
    with very many events is summed up before the shuffle.
    """
    log = log.select(F.col(key).alias(key), ts.alias("ts"), failed.alias("failed"), order.alias("ord"))
    last = log.groupBy(key).agg(F.max(F.when(~F.col("failed"), F.struct("ts", "ord"))).alias("ok"))
    # The join is on the key only; its right side has one row per key.
    after = log.where("failed").join(last, key).where(F.col("ok").isNull() | (F.struct("ts", "ord") > F.col("ok")))
    runs = after.groupBy(key).agg(F.count("*").alias("consecutive_failures"))
    ends = log.groupBy(key).agg(F.max(F.when(~F.col("failed"), F.col("ts"))).alias("last_success_at"), F.max(F.when(F.col("failed"), F.col("ts"))).alias("last_error_at"))
    return ends.join(runs, key, "left").select(key, F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), "last_success_at", "last_error_at")


def broken(failures: Column, limited_until: Column, now: Column) -> Column:
    return (failures >= BREAK_AT) | F.coalesce(limited_until > now, F.lit(False))


def past_watermark(items: DataFrame, marks: DataFrame, key: str, ts: str, mark: str) -> DataFrame:
    """Items newer than their key's watermark; items without time always pass, as do keys without a mark."""
    j = items.join(marks.select(F.col(key), F.col(mark).alias("_mark")), key, "left")
    return j.where(F.col(ts).isNull() | F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")


def advanced(marks: DataFrame, accepted: DataFrame, key: str, ts: str, mark: str) -> DataFrame:
    """Watermarks after a run: the latest accepted time, never backwards."""
    new = accepted.groupBy(key).agg(F.max(ts).alias("_new"))
    return marks.select(key, mark).join(new, key, "full_outer").select(key, F.greatest(mark, "_new").alias(mark))


def within_budget(calls: DataFrame, by: str, order: list[Column], cost: Column, budget: int, reserve: int = 1000) -> DataFrame:
    """Calls made before a budget refuses one; costs are never negative, so what was spent before a call decides.

    Sums run inside ranges of the order, and the sums of the ranges before are added, so a hot ``by`` is no hot task.
    """
    ranged = calls.withColumn("_cost", cost).repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    placed = written(ranged.withColumn("_part", F.spark_partition_id()), "calls")
    sums = placed.groupBy("_part", by).agg(F.sum("_cost").alias("_sum"))
    earlier = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col("_part").alias("_p2"), F.col(by).alias("_by2"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    w = W.partitionBy("_part", by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    spent = placed.withColumn("_here", F.coalesce(F.sum("_cost").over(w), F.lit(0))).join(base, (F.col("_part") == F.col("_p2")) & F.col(by).eqNullSafe(F.col("_by2")))
    spent = spent.withColumn("spent_before", F.col("_base") + F.col("_here"))
    return spent.where(F.col("spent_before") + reserve <= budget).select(*calls.columns, "spent_before")
