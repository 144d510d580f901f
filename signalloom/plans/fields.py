"""Queries on fields: timestamps and packed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.packed import explode_packed
from signalloom.operators.timestamps import normalise
from signalloom.sources.tables import table

TIMES = [("s2_papers", "publication_date"), ("arxiv_papers", "published"), ("github_releases", "published_at"), ("rustsec_advisories", "date")]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every instant named in the four feeds, in microseconds since 1970-01-01 UTC."""
    clocks = table(spark, folder, "feed_clocks")
    parts = []
    for feed, field in TIMES:
        rows = table(spark, folder, feed).select("rec_id", "collector", F.col(field).alias("value"))
        parts.append(normalise(rows, "value", clocks).select(F.lit(feed).alias("feed"), "rec_id", "utc_us"))
    return reduce(DataFrame.unionByName, parts).where(F.col("utc_us").isNotNull())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value packed in entries.tags and findings.cited_paper.authors, with its position."""
    tags = explode_packed(table(spark, folder, "entries").select("id", "tags"), "id", "tags")
    people = table(spark, folder, "findings").select("id", F.col("cited_paper.authors").alias("authors"))
    authors = explode_packed(people, "id", "authors", people=True)
    return tags.select(F.lit("entries").alias("origin"), "*").unionByName(authors.select(F.lit("findings").alias("origin"), "*"))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found}
SQL: dict[str, str] = {}
