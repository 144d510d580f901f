"""Several values packed in one field -> one row per value with its position.

Arrow string buffers are scanned as bytes: escapes, quote parity and delimiter
masks are computed for a whole batch with numpy; from the delimiters that stand
outside quotes the child offsets are derived, a string array is built over the
remaining bytes, and the children are flattened with their parents' ordinals.

Dialects (chosen per row by what stands outside quotes): JSON and Python lists,
quoted CSV, line, tab, ``|``, ``;``, middle dot, spaced slash, ``#`` and comma lists.
``split_people`` also knows conjunctions ("A, B and C"), endings such as
"et al.", and re-joins family name, given name or initials, and suffix.

Defined results: null, empty and blank fields give no rows; empty pieces take no
position; repeats are kept; a field with one value gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Delimiters of several bytes are marked by one control byte for the scan; those left in values are turned back.
_MARKS = [("；", "\x01"), ("，", "\x02"), ("、", "\x03"), (" · ", "\x04"), ("·", "\x05"), ("•", "\x06"), (" / ", "\x07"), ("\r\n", "\n"), ("｜", "\x0e")]
# Rank of each delimiter byte, strongest first; bytes of one rank are used together.
_RANKS = ["\n\r", "\t", "|\x0e", ";\x01", "\x04\x05\x06", "\x07", ",\x02\x03"]
_SOFT = len(_RANKS) - 1
# Without names, where a comma belongs to a value only if quoted or escaped, these may be mixed in one field.
_MIXED_RANKS = [2, 3, _SOFT]
_MIXED = [_RANKS[r] for r in _MIXED_RANKS]
_HASH, _LIST = 100, 101
_CONJ, _KEPT = "\x10", "\x11"
# Words that join the last author, and endings that only say there are more.
CONJUNCTIONS = ["and", "und", "et", "y", "e", "en", "och", "&"]
MORE_RE = r"(?i)[\s,;|&]*\b(?:and|und|et|y)?\s*(?:et\.? ?al(?:ii|\.)?|(?:and |& ?)?others|u\. ?a\.|и др\.|(?:and )?colleagues|y otros|et autres|und andere)\s*[;,.]*\s*$"
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "phd", "md", "esq"]


def _repeat(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return np.repeat(values, lens)


def _escaped(b: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Whether an odd number of backslashes of the same row stands right before each byte."""
    idx = np.arange(len(b))
    last = np.maximum.accumulate(np.where(b != 92, idx, -1))
    before = np.maximum(np.concatenate([[-1], last[:-1]]), row_start - 1)
    return (idx - 1 - before) % 2 == 1


def split(packed: pa.Array, people: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent ordinal, position from 1, and value of every value of a string array."""
    packed = pc.fill_null(packed.cast(pa.large_string()), "")
    if people:
        packed = pc.replace_substring_regex(packed, MORE_RE, "")
        packed = pc.replace_substring_regex(packed, r"\b(for|of) ([\w\-]+) and ([\w\-]+)", rf"\1 \2{_KEPT}\3")
        packed = pc.replace_substring_regex(packed, r",?\s+(?:%s)\s+" % "|".join(CONJUNCTIONS), _CONJ)
    for text, mark in _MARKS:
        packed = pc.replace_substring(packed, text, mark)
    packed = pc.utf8_trim_whitespace(packed)
    n = len(packed)
    buffers = packed.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, packed.offset * 8)
    base, end = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    if end == base:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    b = np.frombuffer(buffers[2], np.uint8, end)[base:]
    offsets = offsets - base
    lens = np.diff(offsets)
    row = _repeat(np.arange(n), lens)
    start = offsets[:-1]
    full = lens > 0
    first = np.zeros(n, np.uint8)
    last = np.zeros(n, np.uint8)
    first[full], last[full] = b[start[full]], b[offsets[1:][full] - 1]
    is_list = (first == 91) & (last == 93)
    single = is_list & ~_any(b == 34, start, lens)

    esc = _escaped(b, start[row])
    prev = np.concatenate([[0], b[:-1]])
    nxt = np.concatenate([b[1:], [0]])
    at_start, at_end = np.arange(len(b)) == start[row], np.arange(len(b)) == offsets[1:][row] - 1
    edge = np.zeros(256, bool)
    edge[[ord(c) for c in "[]{}(),;|\t\n\r \x01\x02\x03\x04\x05\x06\x07\x0e\x10"]] = True
    near = at_start | at_end | edge[prev] | edge[nxt]
    quote = ((b == 34) & ~single[row] | (b == 39) & single[row] & near) & ~esc
    per_row = np.add.reduceat(quote, start[full]) if full.any() else np.zeros(0, np.int64)
    count = np.zeros(n, np.int64)
    count[full] = per_row
    quote &= (count % 2 == 0)[row]
    run = np.cumsum(quote)
    inside = (run - (run[start[row]] - quote[start[row]])) % 2 == 1
    free = ~inside & ~quote & ~esc

    dialect = np.full(n, -1, np.int64)
    for r, chars in reversed(list(enumerate(_RANKS))):
        hit = _any(np.isin(b, [ord(c) for c in chars]) & free, start, lens)
        dialect[hit] = r
    dialect[is_list] = _LIST
    dialect[(first == 35) & ~is_list] = _HASH
    d = dialect[row]
    cut = np.zeros(len(b), bool)
    for r, chars in enumerate(_RANKS):
        with_weaker = "".join(_MIXED[max(0, _MIXED_RANKS.index(r)) :]) if not people and r in _MIXED_RANKS else chars
        cut |= (d == r) & np.isin(b, [ord(c) for c in with_weaker])
    cut |= (d == _LIST) & (b == 44)
    cut |= (d == _HASH) & (b == 35) & (at_start | (prev == 32) | (prev == 44) | (prev == 59) | (prev == 9) | (prev == 10))
    cut &= free
    soft = cut & (d == _SOFT)
    if people:
        conj = (b == ord(_CONJ)) & free & ((d == _SOFT) | (d == -1))
        cut |= conj
    brackets = is_list[row] & (at_start | at_end)

    # Child offsets over the bytes that are left.
    keep = ~cut & ~brackets
    before = np.concatenate([[0], np.cumsum(keep)])
    cuts = np.flatnonzero(cut)
    bounds = np.concatenate([start[full], cuts + 1])
    parent = np.concatenate([np.flatnonzero(full), row[cuts]])
    order = np.lexsort((parent, bounds))
    bounds, parent = bounds[order], parent[order]
    linked = np.concatenate([np.zeros(int(full.sum()), bool), soft[cuts]])[order]
    child_off = np.append(before[bounds], before[-1]).astype(np.int64)
    child = pa.LargeStringArray.from_buffers(len(bounds), pa.py_buffer(child_off.tobytes()), pa.py_buffer(b[keep].tobytes()))

    if people:
        child = pc.replace_substring(child, _CONJ, " and ")
        child = pc.replace_substring(child, _KEPT, " and ")
    for text, mark in _MARKS:
        if mark != "\n":
            child = pc.replace_substring(child, mark, text)
    child = _clean(child, dialect[parent], single[parent])
    if people:
        parent, child = _join_names(parent, child, linked)
    good = np.asarray(pc.not_equal(child, ""))
    parent, child = parent[good], child.filter(pa.array(good))
    if not len(parent):
        return parent, parent, child.cast(pa.string())
    new = np.concatenate([[True], parent[1:] != parent[:-1]])
    pos = np.arange(len(parent)) - np.maximum.accumulate(np.where(new, np.arange(len(parent)), 0)) + 1
    return parent, pos, child.cast(pa.string())


def _any(flag: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flag)])
    return run[start + lens] > run[start]


def _clean(child: pa.Array, dialect: np.ndarray, single: np.ndarray) -> pa.Array:
    """Blanks, enclosing quotes and escapes off; JSON escapes are read as JSON."""
    child = pc.utf8_trim_whitespace(child)
    lead = pc.replace_substring_regex(child, r"^(?:#+|[-*•]\s+)\s*", "")
    child = pc.if_else(pa.array(dialect == _LIST), child, lead)
    quoted = pc.match_substring_regex(child, r'(?s)^".*"$|^\'.*\'$')
    quoted = pc.and_(quoted, pc.greater(pc.binary_length(child), 1))
    bare = pc.if_else(quoted, pc.utf8_slice_codeunits(child, 1, -1), child)
    bare = pc.if_else(pc.and_(quoted, pc.starts_with(child, '"')), pc.replace_substring(bare, '""', '"'), bare)
    if pc.any(pc.match_substring_regex(bare, r"\\u[0-9a-fA-F]{4}|\\[nrtbf]")).as_py():
        import json

        def read(s: str) -> str:
            try:
                return json.loads(f'"{s}"')
            except ValueError:
                return s

        rare = pc.and_(pa.array((dialect == _LIST) & ~single), pc.match_substring(bare, "\\"))
        at = np.flatnonzero(np.asarray(rare))
        bare = pc.replace_with_mask(bare, rare, pa.array([read(bare[int(i)].as_py()) for i in at], bare.type))
    bare = pc.replace_substring_regex(bare, r"\\(.)", r"\1")
    return pc.utf8_trim_whitespace(bare)


def _join_names(parent: np.ndarray, child: pa.Array, linked: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Join ``Family`` + ``Given`` and suffix pieces of comma lists; linked: a comma stands before the piece."""
    n = len(parent)
    if not n:
        return parent, child
    suffix = np.asarray(pc.match_substring_regex(child, r"(?i)^(?:%s)\.?$" % "|".join(SUFFIXES)))
    initials = np.asarray(pc.match_substring_regex(child, r"^(?:\p{Lu}\p{M}*[.\s\-]*){1,4}$"))
    family = np.asarray(pc.match_substring_regex(child, r"^(?:(?:\p{Ll}[\p{Ll}'’]*|[Vv]an|[Vv]on|[Dd]e|[Dd]er|[Dd]en|[Dd]i|[Dd]a|[Ee]l|[Ll]a|[Ll]e) )*[^\s.,]{2,}$"))
    given = np.asarray(pc.match_substring_regex(child, r"^[^\s,]+(?: \p{Lu}\p{M}*\.?)*$"))
    linked = linked & np.concatenate([[False], parent[1:] == parent[:-1]])
    takes = family & ~suffix & ~initials
    join = np.zeros(n, bool)
    # A given name joins the family piece right before it, unless that piece is itself a given part: pairs alternate within a run.
    may = linked & np.concatenate([[False], takes[:-1]]) & (initials | given & ~suffix)
    idx = np.arange(n)
    run_start = np.maximum.accumulate(np.where(may, -1, idx))
    join |= may & ((idx - run_start) % 2 == 1)
    join |= linked & suffix
    heads = np.flatnonzero(~join)
    glue = pa.ListArray.from_arrays(pa.array(np.append(heads, n).astype(np.int32)), child.cast(pa.string()))
    return parent[heads], pc.binary_join(glue, ", ").cast(pa.large_string())


def explode_packed(df: DataFrame, key: str, packed: str, people: bool = False) -> DataFrame:
    """row_key, pos, val for every value packed in ``packed``; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, pos, val = split(batch.column(1), people)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parent)), pa.array(pos, pa.int32()), val], ["row_key", "pos", "val"])

    from pyspark.sql import functions as F

    source = df.select(F.col(key).cast("string").alias("row_key"), F.col(packed).alias("packed")).where(F.col("packed").isNotNull())
    return source.mapInArrow(run, "row_key string, pos int, val string")
