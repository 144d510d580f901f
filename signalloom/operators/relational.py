"""Reads, joins and change-log tables of the store."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from signalloom.functions.text import normal_text
from signalloom.sources.storage import written


def latest(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key of an append-only log; combines before the shuffle, so a hot key is no hot task."""
    rest = [c for c in log.columns if c not in key]
    top = log.groupBy(*key).agg(F.max(F.struct(*order, F.struct(*rest).alias("row"))).alias("m"))
    return top.select(*key, *[F.col(f"m.row.{c}").alias(c) for c in rest])


def first_wins(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that an insert-or-ignore on ``key`` would add."""
    fresh = new.join(old.select(*key).distinct(), list(key), "left_anti")
    rest = [c for c in new.columns if c not in key]
    one = fresh.groupBy(*key).agg(F.min(F.struct(*order, F.struct(*rest).alias("row"))).alias("m"))
    return one.select(*key, *[F.col(f"m.row.{c}").alias(c) for c in rest])


def upserted(old: DataFrame, new: DataFrame, key: str, kept: Sequence[str]) -> DataFrame:
    """Rows after an upsert that keeps the ``kept`` columns of rows that were there."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"o.{key}").isNotNull()
    cols: list[Column] = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in old.columns:
        if c != key:
            mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}")
            cols.append((F.when(there, mine).otherwise(theirs) if c in kept else F.when(F.col(f"n.{key}").isNotNull(), theirs).otherwise(mine)).alias(c))
    return joined.select(*cols)


def unseen(rows: DataFrame, seen: DataFrame, key: str, seen_key: str) -> DataFrame:
    return rows.join(seen.select(F.col(seen_key).alias(key)).distinct(), key, "left_anti")


def newest_of_each_text(rows: DataFrame, content: str, seq: str) -> DataFrame:
    """One row per normalised text, the one with the highest ``seq``; null texts are one text.

    Texts stand for themselves by 256 bits of hash, of which no two texts are known to share all.
    """
    keyed = rows.withColumn("_norm", F.sha2(normal_text(F.coalesce(F.col(content), F.lit(""))), 256))
    return keyed.groupBy("_norm").agg(F.max_by(F.struct(*rows.columns), F.col(seq)).alias("r")).select("r.*")


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def ranked(rows: DataFrame, order: Sequence[Column], limit: int, name: str = "rank", start: int = 1) -> DataFrame:
    """The first ``limit`` rows with their rank; the window sees only those."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(W.orderBy(*order)) + (start - 1))


def numbered(rows: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Place of every row in a total order, from 0, inside ``by`` or over all rows.

    The rows are sorted by ranges, so neither one large ``by`` nor the whole table is
    one task; the rows of a range are counted, and the counts before it are added.
    """
    ranged = rows.repartitionByRange(*[F.col(c) for c in by], *order).sortWithinPartitions(*[F.col(c) for c in by], *order)
    place = ranged.withColumn("_id", F.monotonically_increasing_id())
    placed = written(place.withColumn("_part", F.shiftright("_id", 33)), "numbered")
    # A row for each range and ``by``.
    counts = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_id").alias("_from"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = ["_part", *by]
    joined = placed.join(counts.select(*[F.col(c).alias(f"{c}_2") for c in same], "_from", "_before"), reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in same]))
    return joined.withColumn(name, F.col("_id") - F.col("_from") + F.col("_before")).select(*rows.columns, name)


def in_chunks(rows: DataFrame, by: str, order: Sequence[Column], size: int) -> DataFrame:
    """Rows of each ``by`` numbered in chunks of ``size`` from 0."""
    return numbered(rows, order, "_at", [by]).withColumn("chunk", F.floor(F.col("_at") / size).cast("int")).drop("_at")


def best_of_each(rows: DataFrame, by: str, order: Sequence[Column], most: int, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of each ``by`` with their rank from 1; those that can't be among them are dropped before the shuffle."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col(name) <= most)
