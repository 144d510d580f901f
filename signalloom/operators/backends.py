"""Scorers and embedders that are handed in.

A backend is a function on a batch of texts, called in the executors once per Arrow
batch.  Without one the built-in expressions do the work inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[Sequence[str]], Sequence[float]]
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def with_scores(df: DataFrame, key: str, text: str, scorer: Scorer) -> DataFrame:
    """key, score of each text by ``scorer``, between 0 and 1; null texts and failed batches have none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = b[text].notna()
            got = pd.Series(float("nan"), index=b.index)
            if known.any():
                try:
                    got[known] = [min(1.0, max(0.0, float(s))) for s in scorer(b.loc[known, text].tolist())]
                except Exception:  # noqa: BLE001 - a service that fails leaves the first score standing
                    pass
            yield pd.DataFrame({key: b[key], "score": got})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, score double").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def with_embeddings(df: DataFrame, key: str, text: str, embedder: Embedder, dim: int) -> DataFrame:
    """key, embedding of each text; a vector of another length than ``dim`` is an error, null texts have none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = b[b[text].notna()]
            vectors = [list(map(float, v)) for v in embedder(known[text].tolist())] if len(known) else []
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"the embedder gave a vector that has not {dim} places")
            by = dict(zip(known.index, vectors))
            yield pd.DataFrame({key: b[key], "embedding": [by.get(i) for i in b.index]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
