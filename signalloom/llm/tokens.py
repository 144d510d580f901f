"""Token counts by a public tokenizer; its files stay where they are installed."""

from __future__ import annotations

import ast
import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Longer texts are encoded in parts cut at white space, so that memory stays bounded; the counts are added.
PART = 200_000


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(folder, name).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(name, pat_str=_pattern(folder), mergeable_ranks=ranks, special_tokens={})


def _pattern(folder: str) -> str:
    """The splitting pattern that is written down beside the vocabulary files; the file is read, not run."""
    for node in ast.parse(Path(folder, "__init__.py").read_text()).body:
        if isinstance(node, ast.Assign) and any(getattr(t, "id", "") == "PATTERN" for t in node.targets):
            return ast.literal_eval(node.value)
    raise ValueError(f"no PATTERN in {folder}")


def count(text: str | None, enc) -> int:
    if not text:
        return 0
    if len(text) <= PART:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + PART)
        if end < len(text) and (cut := text.rfind(" ", at + 1, end)) > at:
            end = cut
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_count(text: Column, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> Column:
    """Number of tokens of a text; 0 for null and empty ones."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(folder, name)
        for s in batches:
            yield pd.Series([count(t, enc) for t in s], dtype="int64")

    return counted(text)
