"""Feed payloads -> records, as expressions on string columns; and records -> (source, entry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from signalloom.functions.text import from_inverted, plain_doi, squeezed, url_encoded

S2 = "struct<data:array<struct<paperId:string,title:string,abstract:string,authors:array<struct<name:string>>,year:int,venue:string,citationCount:int,fieldsOfStudy:array<string>,publicationDate:string,externalIds:struct<ArXiv:string,DOI:string,CorpusId:string>,url:string>>>"
OA = "struct<results:array<struct<id:string,doi:string,title:string,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,publication_date:string,cited_by_count:int,concepts:array<struct<display_name:string>>,primary_location:struct<source:struct<display_name:string>>,type:string,ids:struct<openalex:string,doi:string>>>>"
RUSTSEC = "struct<advisories:array<struct<advisory:struct<id:string,package:string,title:string,description:string,date:string,url:string,categories:array<string>,aliases:array<string>,cvss:string>,versions:struct<patched:array<string>,unaffected:array<string>>>>>"
RELEASE = "struct<tag_name:string,name:string,body:string,html_url:string,published_at:string,prerelease:boolean>"
ATOM = "struct<id:string,title:string,summary:string,author:array<struct<name:string>>,published:string,updated:string,link:array<struct<_href:string,_rel:string,_title:string,_type:string>>,category:array<struct<_term:string>>>"


def _or_empty(c: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(kind))


def arxiv_entries(spark: SparkSession, path: str) -> DataFrame:
    """arXiv Atom files: one row per entry with an id."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(T.StructType.fromDDL(f"e {ATOM}")["e"].dataType).load(path)
    return _arxiv(raw)


def arxiv_payload(df: DataFrame, payload: str) -> DataFrame:
    """arXiv Atom entries in a string column, one <entry> element per row."""
    return _arxiv(df.select(F.from_xml(F.col(payload), ATOM).alias("e")).select("e.*"))


def _arxiv(raw: DataFrame) -> DataFrame:
    aid = F.regexp_extract("id", r"/abs/(.+)$", 1)
    pdf = F.get(F.filter(_or_empty(F.col("link"), "array<struct<_href:string,_rel:string,_title:string,_type:string>>"), lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    e = raw.select(
        aid.alias("arxiv_id"), squeezed(F.col("title")).alias("title"), squeezed(F.col("summary")).alias("summary"), _or_empty(F.col("author.name")).alias("authors"),
        _or_empty(F.col("category._term")).alias("categories"), F.try_to_timestamp("published").alias("published"), F.try_to_timestamp("updated").alias("updated"), F.coalesce(pdf, F.lit("")).alias("pdf_url"), F.col("id").alias("abs_url"),
    )
    return e.where("arxiv_id <> ''")


def s2_results(df: DataFrame, payload: str) -> DataFrame:
    r = df.select(F.explode(F.from_json(payload, S2)["data"]).alias("r")).select("r.*").where("coalesce(paperId, '') <> '' and coalesce(title, '') <> ''")
    return r.select(
        F.col("paperId").alias("paper_id"), squeezed(F.col("title")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract_text"), _or_empty(F.filter(F.col("authors.name"), lambda x: x.isNotNull())).alias("authors"), "year", F.nullif(F.col("venue"), F.lit("")).alias("venue"),
        F.col("citationCount").alias("citation_count"), _or_empty(F.col("fieldsOfStudy")).alias("fields_of_study"), F.try_to_date(F.col("publicationDate"), "yyyy-MM-dd").alias("publication_date"), F.struct(F.col("externalIds.ArXiv").alias("arxiv_id"), F.col("externalIds.DOI").alias("doi"), F.col("externalIds.CorpusId").alias("corpus_id")).alias("external_ids"),
        F.coalesce("url", F.concat(F.lit("https://www.semanticscholar.org/paper/"), "paperId")).alias("url"),
    )


def oa_results(df: DataFrame, payload: str) -> DataFrame:
    r = df.select(F.explode(F.from_json(payload, OA)["results"]).alias("r")).select("r.*").where("coalesce(id, '') <> '' and coalesce(title, '') <> ''")
    doi = plain_doi(F.coalesce("doi", F.col("ids.doi")))
    return r.select(
        F.col("id").alias("openalex_id"), doi.alias("doi"), squeezed(F.col("title")).alias("title"), F.coalesce(from_inverted(F.col("abstract_inverted_index")), F.lit("")).alias("abstract_text"), _or_empty(F.filter(F.col("authorships.author.display_name"), lambda x: x.isNotNull())).alias("authors"),
        F.try_to_date(F.col("publication_date"), "yyyy-MM-dd").alias("publication_date"), "cited_by_count", F.slice(_or_empty(F.filter(F.col("concepts.display_name"), lambda x: x.isNotNull())), 1, 5).alias("concepts"), F.col("primary_location.source.display_name").alias("source_name"), F.col("type").alias("work_type"),
        F.when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.col("id")).alias("url"),
    )


def rustsec_results(df: DataFrame, payload: str, keywords: list[str], most: int) -> DataFrame:
    """Advisories whose text holds any keyword, of each payload the first ``most`` in feed order."""
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), F.from_json(payload, RUSTSEC)["advisories"].alias("all"))
    r = numbered.select("_row", F.posexplode("all").alias("pos", "r")).select("_row", "pos", "r.advisory.*", F.col("r.versions.patched").alias("patched"), F.col("r.versions.unaffected").alias("unaffected"))
    # A window per payload: what can't be among the first is dropped before the shuffle.
    first = F.row_number().over(W.partitionBy("_row").orderBy("pos"))
    kept = r.where(advisory_matches(keywords)).withColumn("_n", first).where(F.col("_n") <= most)
    return kept.withColumn("date", F.try_to_date("date", "yyyy-MM-dd")).drop("_row", "pos", "_n")


def advisory_matches(keywords: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("package", F.lit("")), F.array_join(F.coalesce("categories", F.array().cast("array<string>")), " ")))
    out = F.lit(not keywords)
    for k in keywords:
        out = out | F.contains(text, F.lit(k.lower()))
    return out


def release_results(df: DataFrame, repo: str, payload: str, most: int | None = None) -> DataFrame:
    """Releases with a tag, of each repository the latest one; at most ``most`` repositories, by name."""
    r = df.select(F.col(repo).alias("full_name"), F.from_json(payload, RELEASE).alias("r")).select("full_name", "r.*").where("tag_name is not null")
    r = r.withColumn("published_at", F.try_to_timestamp("published_at"))
    rest = [c for c in r.columns if c != "full_name"]
    top = r.groupBy("full_name").agg(F.max(F.struct("published_at", F.struct(*rest).alias("row"))).alias("m")).select("full_name", *[F.col(f"m.row.{c}").alias(c) for c in rest])
    return top if most is None else top.orderBy("full_name").limit(most)


def query_arxiv(keywords: list[str], negatives: list[str]) -> Column:
    pos = F.concat_ws("+OR+", *[F.concat(F.lit("all:"), url_encoded(F.lit(k))) for k in keywords])
    if not negatives:
        return pos
    neg = F.concat_ws("+ANDNOT+", *[F.concat(F.lit("all:"), url_encoded(F.lit(n))) for n in negatives])
    return F.concat(F.lit("("), pos, F.lit(")+ANDNOT+"), neg)


def query_oa(keywords: list[str]) -> Column:
    return url_encoded(F.concat_ws(" ", *[F.lit(k) for k in keywords]))


def query_github(keywords: list[str]) -> Column:
    """Repositories that have any of the keywords; the search takes + for a blank."""
    return F.concat_ws("+OR+", *[url_encoded(F.lit(k)) for k in keywords])


def query_s2(keywords: list[str], negatives: list[str]) -> Column:
    return url_encoded(F.concat_ws(" ", *[F.lit(k) for k in keywords], *[F.lit("-" + n) for n in negatives]))


def scope_hash(prefix: str, keywords: Column) -> Column:
    """Names what was asked of a feed: the same for the same keywords in any order."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(keywords), "\x01"), 256), 1, 16))


def as_entries(papers: DataFrame, title: str, body: str, people: str, labels: str, label: str = "Categories") -> DataFrame:
    """content of an entry from a paper: title, text, authors and labels."""
    listed = lambda c, name: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{name}: "), F.array_join(c, ", "))).otherwise("")
    return papers.withColumn("content", F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")), F.lit("\n"), listed(F.col(people), "Authors"), listed(F.col(labels), label)))
