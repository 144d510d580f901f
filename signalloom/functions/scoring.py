"""Scores: keywords, urgency, priority, similarity, usefulness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions.text import count_phrase, token_text


def contains_any(toks: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | (count_phrase(toks, p) > 0)
    return out


def keyword_score(content: Column, summary: Column, keywords: Sequence[str], negatives: Sequence[str] = ()) -> Column:
    """Share of keywords found, with a bonus for repetition and for standing in both fields; 0 on any negative one."""
    return keyword_score_of(token_text(content), token_text(summary), keywords, negatives)


def keyword_score_of(c: Column, s: Column, keywords: Sequence[str], negatives: Sequence[str] = ()) -> Column:
    """The same over token texts, so that the tokens are made once."""
    counts = [(count_phrase(c, k), count_phrase(s, k)) for k in keywords]
    return score_of_counts(counts, contains_any(c, negatives) | contains_any(s, negatives))


def with_keyword_score(df: DataFrame, content: str, summary: str, keywords: Sequence[str], negatives: Sequence[str] = (), name: str = "score") -> DataFrame:
    """Adds the score; tokens are made once and every phrase is counted once, also where rows are filtered by the score.

    A projection would be copied into every filter on it, so texts and counts
    are made by one-row generators, which filters can't pass.
    """
    t = df.select("*", F.inline(F.array(F.struct(token_text(F.col(content)).alias("_c"), token_text(F.col(summary)).alias("_s")))))
    phrases = [*keywords, *negatives]
    if phrases:
        counts = [count_phrase(F.col(f), p).alias(f"_{f}{i}") for i, p in enumerate(phrases) for f in ("_c", "_s")]
        t = t.select(*df.columns, F.inline(F.array(F.struct(*counts))))
    pair = lambda i: (F.col(f"__c{i}"), F.col(f"__s{i}"))
    bad = F.lit(False)
    for i in range(len(keywords), len(phrases)):
        bad = bad | (pair(i)[0] > 0) | (pair(i)[1] > 0)
    return t.select(*df.columns, score_of_counts([pair(i) for i in range(len(keywords))], bad).alias(name))


def score_of_counts(counts: Sequence[tuple[Column, Column]], bad: Column) -> Column:
    """Score of (times in content, times in summary) of every keyword; 0 where ``bad``."""
    if not counts:
        return F.lit(0.0)
    share = 1.0 / len(counts)
    total = F.lit(0.0)
    for in_c, in_s in counts:
        bonus = F.greatest(F.least(in_c, F.lit(3)) - 1, F.lit(0)) * 0.1
        both = F.when((in_c > 0) & (in_s > 0), 0.15).otherwise(0.0)
        part = F.least(share * (1 + bonus + both), F.lit(share * 1.4))
        total = total + F.when((in_c > 0) | (in_s > 0), part).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    return F.when(bad, 0.0).otherwise(score)


def urgency_of(score: Column) -> Column:
    return F.when(score >= 0.95, "critical").when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def urgency_rank(urgency: Column) -> Column:
    """0 to 3; anything unknown counts as medium."""
    return F.when(urgency == "low", 0).when(urgency == "high", 2).when(urgency == "critical", 3).otherwise(1)


def priority(urgency: Column, confidence: Column, impact: Column) -> Column:
    return (urgency_rank(urgency) + 1) * 0.5 + confidence.cast("double") * 0.3 + impact.cast("double") * 0.2


def is_actionable(confidence: Column, urgency: Column) -> Column:
    return (confidence >= F.lit(0.4).cast("float")) & (urgency_rank(urgency) > 0)


def is_critical(confidence: Column, urgency: Column) -> Column:
    return (urgency_rank(urgency) == 3) | (confidence >= F.lit(0.95).cast("float"))


def budget_allows(spent: Column, budget: Column, call: int = 1000) -> Column:
    return budget.isNull() | (spent + call <= budget)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, one is empty or has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) < 1) | (norm(a) * norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def usefulness(accepted: Column, rejected: Column) -> Column:
    return (accepted + 1) / (accepted + rejected + 2)


def local_embeddings(df: DataFrame, key: str, text: str, dim: int = 1024) -> DataFrame:
    """key, embedding: L2-normalised hashed word counts; all zeros for a text without words.  No shuffle: a text is one row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.zeros((len(b), dim))
            for i, places in enumerate(b["at"]):
                np.add.at(m[i], np.asarray(places, np.int64), 1.0)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0).astype("float32")
            yield pd.DataFrame({key: b[key], "embedding": list(unit)})

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return df.select(key, places.alias("at")).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def adjusted(base: Column, delta: Column, refuted: Column) -> Column:
    """Confidence after a critique: clamped, halved where refuted."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + delta))
    return F.when(refuted, v * 0.5).otherwise(v)


def disposition_class(status: Column) -> Column:
    s = F.lower(F.trim(status))
    return F.when(s.isin("applied", "closed", "authorized"), "favorable").when(s.isin("rolled_back", "blocked"), "unfavorable").otherwise("pending")


def backoff_seconds(failures: Column) -> Column:
    """0 below five failures in a row, then doubling from 30 to 300 seconds."""
    return F.when(failures < 5, 0).otherwise(F.least(F.lit(300.0), 30 * F.pow(F.lit(2.0), failures - 5))).cast("int")


def citation(title: Column, authors: Column, year: Column, venue: Column, url: Column) -> Column:
    return F.concat(F.lit('"'), title, F.lit('" by '), authors, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("). "), F.when(venue.isNotNull(), F.concat(venue, F.lit(" — "))).otherwise(""), url)
