"""Text expressions: tokens, phrase counts, white space, truncation, identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits, ' and -; empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}'\-]+"), lambda x: x != "")


def token_text(text: Column) -> Column:
    """The tokens with one blank before and after each, as one string: a form that phrases are counted in without arrays."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}'\-]+", " "), F.lit(" "))


def count_phrase(toks: Column, phrase: str) -> Column:
    """Overlapping occurrences of a phrase of whole words in a token text; 0 for a blank phrase."""
    words = phrase.lower().split()
    if not words:
        return F.lit(0)
    return F.regexp_count(toks, F.lit("(?= " + " ".join(re.escape(w) for w in words) + " )"))


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_text(text: Column) -> Column:
    return F.lower(squeezed(text))


def truncated(text: Column, limit: int, ellipsis: bool = False) -> Column:
    """At most ``limit`` UTF-8 bytes, cut at the last blank inside the window and never inside a character."""
    room = limit - 3 if ellipsis else limit
    # A prefix of room / 4 characters always fits; the longest is found by halving the rest.
    head = F.substring(text, 1, room)
    step = 1 << max(0, (room - room // 4)).bit_length()
    fits = F.lit(room // 4)
    steps = []
    while step:
        steps.append(step)
        step //= 2
    fits = F.aggregate(F.array(*[F.lit(x) for x in steps]), fits, lambda k, x: F.when(F.octet_length(F.substring(head, F.lit(1), k + x)) <= room, F.least(k + x, F.lit(room))).otherwise(k))
    prefix = F.substring(head, F.lit(1), fits)
    at_blank = F.regexp_extract(prefix, r"(?s)^(.*)\s", 1)
    cut = F.when(at_blank != "", at_blank).otherwise(prefix)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("..." if ellipsis else "")))


def plain_doi(doi: Column, resolver: str = r"doi\.org") -> Column:
    """A DOI without one http(s) resolver prefix; ``resolver`` is a pattern of the host."""
    return F.regexp_replace(doi, r"^https?://(?:dx\.)?" + resolver + "/", "")


def arxiv_from_doi(doi: Column) -> Column:
    """The arXiv id inside an arXiv DOI, else null."""
    found = F.regexp_extract(doi, r"(?i)^10\.48550/arxiv\.(.*)$", 1)
    return F.when(found != "", found)


def from_inverted(index: Column) -> Column:
    """Text of a map word -> positions, words in the order of their positions; null for null and empty maps."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


def url_encoded(text: Column) -> Column:
    """The few replacements that feed queries need."""
    for raw, code in ((" ", "%20"), ('"', "%22"), ("&", "%26"), ("#", "%23"), ("+", "%2B")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text
