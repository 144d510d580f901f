"""Texts and small values made for people and for prompts, and the rules of polling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of a notice by score.
COLOURS = [(0.9, 0xFF0000), (0.7, 0xFF8C00), (0.5, 0xFFD700)]
GREY = 0x808080


def colour(score: Column) -> Column:
    out = F.lit(GREY)
    for least, value in reversed(COLOURS):
        out = F.when(score >= least, value).otherwise(out)
    return out


def percent(score: Column) -> Column:
    """Whole per cent, halves to the even number."""
    return F.concat(F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%"))


def domain_slug(domain: Column) -> Column:
    return F.replace(F.lower(domain), F.lit(" "), F.lit("-"))


def is_archived(at: Column) -> Column:
    return at.isNotNull()


def should_poll(now: Column, last: Column, every_seconds: int) -> Column:
    """Whether the interval has passed; never if it is 0, always if there was no poll."""
    return F.lit(every_seconds > 0) & (last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= every_seconds))


def limited_until(error: Column, now: Column, minutes: int = 10) -> Column:
    """Until when a feed is left alone after an error that speaks of too many requests; null otherwise."""
    text = F.lower(error)
    return F.when(F.contains(text, F.lit("429")) | F.contains(text, F.lit("rate limit")), now + F.expr(f"interval {minutes} minutes"))


def hypothesis(title: Column, code: Column, summary: Column) -> Column:
    """What a finding may do: about the first weakness it is linked to, else in general."""
    return F.when(code.isNull(), F.concat(F.lit("This applies to the monitored system: "), title)).otherwise(F.concat(F.lit("Addresses weakness "), code, F.lit(": "), F.coalesce(summary, F.lit("")), F.lit(" — "), title))


def experiment(title: Column) -> Column:
    return F.concat(F.lit("Run a small benchmark validating: "), title)


def scoring_prompt(profile: Column, keywords: Column, content: Column) -> Column:
    """Asks a model for the relevance of a text to a profile, answered as JSON with score and reason."""
    return F.concat(F.lit("Profile: "), profile, F.lit("\nKeywords: "), F.array_join(keywords, ", "), F.lit("\nText:\n"), content, F.lit('\nAnswer with JSON only: {"score": a number from 0 to 1, "reason": a short sentence}'))


def critique_prompt(title: Column, claim: Column) -> Column:
    """Asks a model to refute what a finding is said to do."""
    return F.concat(F.lit("Finding: "), title, F.lit("\nClaim: "), claim, F.lit('\nTry to refute it. Answer with JSON only: {"refuted": true or false, "reason": a short sentence, "confidence_delta": a number from -0.3 to 0.1}'))
