"""Queries of the training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.history import features, repeats
from signalloom.llm.mixing import mixed, shares
from signalloom.llm.names import classes, title_keys, variants
from signalloom.llm.packing import fill, packed
from signalloom.llm.sentences import sentences
from signalloom.llm.storage import written
from signalloom.llm.survivors import survivors
from signalloom.llm.works import cross_matches, prepare, unified, works
from signalloom.sources.tables import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each group of records of one work within a table, the record whose value survives, by field."""
    tables = [table(spark, folder, t) for t in ("s2_papers", "oa_works", "arxiv_papers")]
    return survivors(tables[0], tables[1], works(written(prepare(unified(*tables)), "records")))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, or piece of a larger one, with its container for each spec."""
    return packed(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "bin_specs"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each spec are."""
    return fill(p7_pack(spark, folder), table(spark, folder, "bin_specs"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of the sources of documents, block by block."""
    return mixed(table(spark, folder, "documents").select("doc_id", "text", "source"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached against the targets."""
    return shares(p8_mix(spark, folder), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every text."""
    return sentences(table(spark, folder, "documents").select("doc_id", "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of author spellings that name the same person or organisation."""
    parts = [table(spark, folder, t).select("authors", "title") for t in ("s2_papers", "oa_works", "arxiv_papers")]
    mentions = title_keys(reduce(DataFrame.unionByName, parts), "authors").select(F.explode("authors").alias("name"), F.xxhash64("t").alias("t"))
    return variants(classes(mentions, table(spark, folder, "given_forms")))


def p2_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of different tables that describe the same work, each with a confidence."""
    rows = unified(*[table(spark, folder, t) for t in ("s2_papers", "oa_works", "arxiv_papers")])
    return cross_matches(works(written(prepare(rows), "records")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs without the confidence."""
    return p2_matches(spark, folder).select("rec_a", "rec_b")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of a later batch that repeats a row of an earlier one, with the first row of its group."""
    parts = [("entries", "ingest_seq", "content"), ("sources", "ingest_seq", "url"), ("oa_works", "rec_id", "openalex_id")]
    return repeats(reduce(DataFrame.unionByName, [features(table(spark, folder, t), t, key, field) for t, key, field in parts]))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_matches": p2_matches, "p3_found": p3_found, "p6_found": p6_found, "p7_pack": p7_pack, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found}
SQL: dict[str, str] = {}
