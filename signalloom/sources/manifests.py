"""Keywords of software projects from their manifests and headings, as profiles.

Input is one row per file: project, file (its name), content.  A file that can't be read gives no keywords.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST = 25
THRESHOLD = 0.3
# Dependencies that say nothing about a project's subject.
NOISE = """serde serde_json anyhow thiserror tracing tracing-subscriber libc cfg-if once_cell lazy_static regex base64 hex
url percent-encoding mime log env_logger pytest setuptools wheel pip flake8 mypy black eslint prettier typescript jest webpack
vite babel build hatchling cryptography""".split()
# Heading words that say nothing about a project's subject.
COMMON = """this that with from have been will would could should there their about which when what they them then than these
those some such only also into over under more most very just like make made your here must does done each both first last next
project code file data test tool tools using used uses readme license install usage docs repository following example examples
default config configuration build script scripts output input error warning status model based library package version
description setup start stop run running source""".split()
# Files whose headings count.
HEADED = ["README.md", "AGENTS.md", "CLAUDE.md"]


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))


def cargo_names(text: Column) -> Column:
    """Names left of = in the sections that are called dependencies."""
    sections = F.filter(F.split(text, r"(?m)^[ \t]*(?=\[)"), lambda s: F.regexp_extract(s, r"^\[[^\r\n]*", 0).contains("dependencies"))
    names = F.transform(F.flatten(F.transform(sections, lambda s: F.filter(_lines(s), lambda x: ~x.startswith("[")))), lambda x: F.regexp_extract(x, r"^([^=#\s][^=]*?)\s*=", 1))
    return F.filter(names, lambda x: x != "")


def pyproject_names(text: Column) -> Column:
    """Names of quoted requirements with a version; a line that does not begin with a quote is no requirement, whatever it holds."""
    return F.filter(F.transform(_lines(text), lambda x: F.trim(F.regexp_extract(x, r'^"+([^><=~"]*)[^"]*(?:>=|==|~=)', 1))), lambda x: x != "")


def package_names(text: Column) -> Column:
    kind = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    p = F.from_json(text, kind)
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.map_keys(p["dependencies"]), none), F.coalesce(F.map_keys(p["devDependencies"]), none))


def gomod_names(text: Column) -> Column:
    """Last parts of the module paths that are required."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.ltrim(x).startswith("require ") | F.trim(F.regexp_replace(x, r"^ +", "")).contains("\t") | x.startswith("\t"))
    words = F.flatten(F.transform(lines, lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")))
    last = F.transform(F.filter(words, lambda w: w.contains("/") & ~w.startswith("require")), lambda w: F.regexp_extract(w, r"([^/]*)$", 1))
    return F.filter(last, lambda w: (w != "") & ~w.rlike(r"^\d"))


def heading_words(text: Column) -> Column:
    heads = F.transform(F.filter(_lines(text), lambda x: x.startswith("#")), lambda x: F.lower(F.regexp_replace(x, r"^#+", "")))
    words = F.transform(F.flatten(F.transform(heads, lambda h: F.split(F.trim(h), r"\s+"))), lambda w: F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}\-_]", ""))
    return F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~w.isin(COMMON))


def project_keywords(files: DataFrame) -> DataFrame:
    """project, keyword, rank: the 25 longest keywords of each project, then by name; words of all its files, each once, without the noise."""
    of = {"Cargo.toml": cargo_names, "pyproject.toml": pyproject_names, "package.json": package_names, "go.mod": gomod_names} | dict.fromkeys(HEADED, heading_words)
    text = F.coalesce("content", F.lit(""))
    found = reduce(lambda rest, kv: F.when(F.col("file") == kv[0], kv[1](text)).otherwise(rest), of.items(), F.array().cast("array<string>"))
    words = files.select("project", F.explode(F.array_distinct(found)).alias("keyword")).where((F.octet_length("keyword") >= 3) & ~F.col("keyword").isin(NOISE)).distinct()
    rank = F.row_number().over(W.partitionBy("project").orderBy(F.desc(F.octet_length("keyword")), "keyword"))
    return words.withColumn("rank", rank).where(F.col("rank") <= MOST)


def auto_profiles(files: DataFrame) -> DataFrame:
    """name, keywords, keyword_count, score_threshold; projects without keywords have none."""
    words = project_keywords(files).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k"))
    return words.select(F.col("project").alias("name"), F.col("k.keyword").alias("keywords"), F.size("k").alias("keyword_count"), F.lit(THRESHOLD).alias("score_threshold"))
