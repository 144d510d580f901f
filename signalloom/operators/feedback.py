"""Outcomes: usefulness, dispositions, weakness links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions.scoring import usefulness


def useful_by(rows: DataFrame, key: str) -> DataFrame:
    g = rows.groupBy(key).agg(F.count_if(F.col("outcome") == "accepted").alias("accepted"), F.count_if(F.col("outcome") == "rejected").alias("rejected"), F.count("*").alias("total"))
    return g.select(key, "accepted", "rejected", (F.col("total") - F.col("accepted") - F.col("rejected")).alias("pending"), F.round(usefulness(F.col("accepted"), F.col("rejected")), 6).alias("usefulness"))


def reduced(rows: DataFrame, key: str, disposition: Column) -> DataFrame:
    """favorable if any is, unfavorable if all are, else pending."""
    g = rows.groupBy(key).agg(F.bool_or(disposition == "favorable").alias("any"), F.bool_and(disposition == "unfavorable").alias("all"))
    return g.select(key, F.when(F.col("any"), "favorable").when(F.col("all"), "unfavorable").otherwise("pending").alias("disposition"))


def linked(findings: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """id, weakness_code: the first weakness (by ord) whose domain fits, or whose code or a word of it stands in the text.

    ``weaknesses`` is one snapshot, a short list kept in one row; it is read as
    an array, so the theta condition is evaluated row by row without a join.
    """
    snapshot = weaknesses.agg(F.sort_array(F.collect_list(F.struct("ord", "weakness_code", "domains"))).alias("all"))
    f = findings.join(F.broadcast(snapshot))  # one row
    text = F.lower(F.coalesce("text", F.lit("")))
    fits = F.filter("all", lambda w: F.coalesce(F.array_contains(w["domains"], F.col("domain")), F.lit(False)) | F.contains(text, F.lower(w["weakness_code"])) | F.exists(F.split(F.lower(w["weakness_code"]), r"[_\-\s]+"), lambda x: (F.length(x) > 2) & F.contains(text, x)))
    return f.select("id", F.get(fits, F.lit(0))["weakness_code"].alias("weakness_code"))
