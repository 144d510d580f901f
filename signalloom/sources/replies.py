"""Replies of the services that findings are sent to, as expressions on JSON text; unreadable text is a reply that says nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAPSHOT = "struct<generated_at:string,open_obligations:array<struct<weakness_code:string,severity:string,count:int,domains:array<string>,latest_summary:string,last_observed_at:string>>,ledger_weaknesses:array<struct<rank:int,weakness:string,status:string,evidence:string,owning_task:string>>>"


def _text(v: Column) -> Column:
    """A JSON string; null for every other kind of value."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def obligation_ids(reply: Column) -> Column:
    """Ids in their five places, one after the other; blank ones and those that are no strings are left out."""
    v = F.try_parse_json(reply)
    at = lambda path: F.try_variant_get(v, path, "variant")
    many = lambda path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    texts = lambda path: F.transform(many(path), _text)
    listed = F.transform(many("$.obligations"), lambda o: _text(F.try_variant_get(o, "$.id", "variant")))
    ids = F.concat(texts("$.obligation_ids"), F.array(_text(at("$.obligation_id"))), texts("$.data.obligation_ids"), F.array(_text(at("$.data.obligation_id"))), listed)
    return F.filter(ids, lambda x: x.isNotNull() & (x != ""))


def obligation_status(reply: Column) -> Column:
    """The first of status, data.status and obligation.status that is there; null if that one is no string."""
    v = F.try_parse_json(reply)
    out = F.lit(None).cast("string")
    for path in ("$.obligation.status", "$.data.status", "$.status"):
        x = F.try_variant_get(v, path, "variant")
        out = F.when(x.isNotNull(), _text(x)).otherwise(out)
    return out


def answer_score(answer: Column) -> Column:
    """score of a model's answer, with or without a code fence, between 0 and 1; null where it can't be read."""
    plain = F.try_variant_get(F.try_parse_json(answer), "$.score", "double")
    body = F.trim(F.regexp_replace(F.trim(answer), r"(?s)^```(?:json)?\s*|\s*```$", ""))
    score = F.coalesce(plain, F.try_variant_get(F.try_parse_json(body), "$.score", "double"))
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def open_weaknesses(df: DataFrame, doc: str) -> DataFrame:
    """ord, weakness_code, severity, count, domains, summary of the open obligations of a snapshot; missing lists are empty."""
    r = df.select(F.posexplode(F.from_json(doc, SNAPSHOT)["open_obligations"]).alias("ord", "o"))
    return r.select("ord", "o.weakness_code", "o.severity", "o.count", F.coalesce("o.domains", F.array().cast("array<string>")).alias("domains"), F.col("o.latest_summary").alias("summary"))


def ledger_weaknesses(df: DataFrame, doc: str) -> DataFrame:
    """rank, weakness, status, evidence of the ledger of a snapshot."""
    return df.select(F.explode(F.from_json(doc, SNAPSHOT)["ledger_weaknesses"]).alias("w")).select("w.rank", "w.weakness", "w.status", "w.evidence")
