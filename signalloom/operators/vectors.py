"""Vector search: novelty of vectors against earlier ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.sources.storage import written

BLOCK = 4096


def _blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """block, keys, data, dim: up to BLOCK vectors of a partition as one matrix of unit rows (zero rows stay zero)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            b = b.dropna()
            for dim, same in b.groupby(b[vector].map(len)):
                for at in range(0, len(same), BLOCK):
                    cut = same.iloc[at : at + BLOCK]
                    m = np.stack(cut[vector].to_list()).astype(np.float64).reshape(len(cut), int(dim))
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                    yield pd.DataFrame({"block": [(part << 20) + n], "keys": [cut[key].to_list()], "data": [m.tobytes()], "dim": [int(dim)]})
                    n += 1

    return df.select(F.col(key).cast("long").alias(key), vector).mapInPandas(run, "block long, keys array<long>, data binary, dim int")


#: Blocks of one side that meet in one task.
SIDE = 32


def novelty(queries: DataFrame, priors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, max_similarity, novelty = clamp(1 - max similarity); 1 for a query without any prior of its length.  A row with the query's own key is no prior.

    Both sides are cut into matrices, and these are dealt to the cells of a grid: a
    query matrix goes to every cell of its row, a prior one to every cell of its column,
    so a matrix is copied once per SIDE matrices of the other side, and a cell holds
    SIDE of each; matrix products give the maxima.
    """
    p, q = written(_blocks(priors, key, vector), "priors"), written(_blocks(queries, key, vector), "queries")
    rows, columns = (max(1, -(-df.count() // SIDE)) for df in (q, p))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(place(rows).alias("r"), every(columns).alias("c"), "keys", "data", "dim")
    right = p.select(every(rows).alias("r"), place(columns).alias("c"), "keys", "data", "dim")

    def products(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({key: pd.Series([], dtype="int64"), "s": pd.Series([], dtype="float64")})]
        for ks, x, d in zip(a["keys"], a["data"], a["dim"]):
            m = np.frombuffer(x).reshape(-1, d)
            best = np.full(len(m), -np.inf)
            for others, y, e in zip(b["keys"], b["data"], b["dim"]):
                if e == d:
                    s = m @ np.frombuffer(y).reshape(-1, d).T
                    _, i, j = np.intersect1d(ks, others, return_indices=True)
                    if len(i):
                        s[np.equal.outer(np.asarray(ks), np.asarray(others))] = -np.inf
                    best = np.maximum(best, s.max(axis=1))
            known = np.isfinite(best)
            out.append(pd.DataFrame({key: np.asarray(ks)[known], "s": best[known]}))
        return pd.concat(out)

    best = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(products, f"{key} long, s double").groupBy(key).agg(F.max("s").alias("s"))
    out = queries.select(F.col(key).cast("long").alias(key)).join(best, key, "left")
    return out.select(key, F.coalesce("s", F.lit(0.0)).alias("max_similarity"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.coalesce("s", F.lit(0.0)))).alias("novelty"))
