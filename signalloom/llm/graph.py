"""Joins on skewed keys, all pairs of large blocks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.storage import counted, written

#: A key is hot beyond this share of the rows, so at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1 / 500
HOT_ROWS = 20_000


def join_skewed(big: DataFrame, by_key: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``by_key`` (one row per key, ``count`` = the key's rows in ``big``).

    Keys over HOT_SHARE of all rows are joined by a broadcast that holds at most
    1 / HOT_SHARE rows; the others by an ordinary join.  ``count`` is dropped.
    """
    total = by_key.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    cold = big.join(by_key.where(F.col(count) <= limit).drop(count), on, how)
    if total <= limit:
        return big.join(by_key.drop(count), on, how)
    hot = by_key.where(F.col(count) > limit)
    keys = hot.select(*on)
    if how == "left":
        cold = big.join(F.broadcast(keys), on, "left_anti").join(by_key.where(F.col(count) <= limit).drop(count), on, "left")
    return cold.unionByName(big.join(F.broadcast(hot.drop(count)), on, "inner"))


#: A class is paired in parts of so many members.
PAIR_ROWS = 512


def paired(rows: DataFrame, on: str, count: str, of: str) -> DataFrame:
    """``of``_a, ``of``_b and the other columns of both, for all pairs of members of a class; ``count`` = members of the class.

    A class of more than PAIR_ROWS members is spread over as many tasks as it has such parts.
    """
    parts = F.ceil(F.col(count) / PAIR_ROWS).cast("int")
    rest = [c for c in rows.columns if c not in (on, count)]
    a = rows.select(on, F.pmod(F.xxhash64(of), parts).cast("int").alias("_part"), *[F.col(c).alias(f"{c}_a") for c in rest])
    b = rows.select(on, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), *[F.col(c).alias(f"{c}_b") for c in rest])
    return a.join(b, [on, "_part"]).drop(on, "_part")


#: A block is compared in tiles of two parts of about so many members.
TILE_ROWS = 1 << 15
#: Members with more partners than this are compared one after the other, the rest many at once.
LONG, AT_ONCE = 256, 1 << 20


def tiled(rows: DataFrame, on: str, count: str, of: str, *then: str) -> DataFrame:
    """The rows, once for each tile (i, j) of their block, so that any two members meet in one tile; count = members of the block.

    The rows of a tile lie together, those of its second part (``second``) last, then ordered by ``then``.
    """
    parts = F.ceil(F.col(count) / TILE_ROWS).cast("int")
    p = F.pmod(F.xxhash64(of), parts).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least(p, q).alias("i"), F.greatest(p, q).alias("j"), (q < p).alias("second")))
    spread = rows.withColumn("_tile", F.explode(tiles)).select("*", "_tile.*").drop("_tile")
    return spread.repartition(on, "i", "j").sortWithinPartitions(on, "i", "j", "second", *then)


def whole_tiles(batches: Iterator[pa.RecordBatch], on: str, at_least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of ``tiled`` in tables that cut no tile, each with the row at which the tile of a row begins."""
    kept: list[pa.RecordBatch] = []
    rows, most = 0, at_least

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in (on, "i", "j"):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def out(t: pa.Table, first: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        return t, np.repeat(first, np.diff(np.append(first, t.num_rows)))

    for b in batches:
        kept.append(b)
        rows += b.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(kept)
        first = begins(t)
        if (last := int(first[-1])) == 0:
            most *= 2
            continue
        yield out(t.slice(0, last), first[:-1])
        kept = t.slice(last).to_batches()
        rows, most = t.num_rows - last, max(at_least, 2 * (t.num_rows - last))
    if rows:
        t = pa.Table.from_batches(kept)
        yield out(t, begins(t))


def spans(first: np.ndarray, tiles: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """lo, hi of the rows of ``whole_tiles`` for ``all_pairs``: within a tile of one part each row with all after it, else each of the first part with all of the second."""
    n = len(first)
    at = np.arange(n)
    heads = np.flatnonzero(at == first)
    of = np.searchsorted(heads, first)
    stop = np.append(heads[1:], n)[of]
    second, one = tiles.column("second").to_numpy(), tiles.column("i").to_numpy() == tiles.column("j").to_numpy()
    lo = np.where(one, at + 1, stop - np.add.reduceat(second.astype(np.int64), heads)[of])
    return lo, np.where(second, lo, stop)


def all_pairs(lo: np.ndarray, hi: np.ndarray, alike: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows a, b of all pairs of a row r and a row from lo[r] to hi[r] (exclusive) for which alike(a, b) holds.

    ``alike`` gets two arrays, or a row and a slice.
    """
    n = hi - lo
    for r in np.flatnonzero(n > LONG).tolist():
        b = np.flatnonzero(alike(r, slice(lo[r], hi[r]))) + lo[r]
        if len(b):
            yield np.full(len(b), r), b
    some = np.flatnonzero((n > 0) & (n <= LONG))
    ends = np.cumsum(n[some])
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        r = some[at:to]
        a = np.repeat(r, n[r])
        b = np.arange(len(a)) - np.repeat(np.cumsum(n[r]) - n[r], n[r]) + np.repeat(lo[r], n[r])
        keep = alike(a, b)
        yield a[keep], b[keep]
        at = to


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges.

    Labels take the smallest label among the neighbours and then their label's
    label, until nothing changes; each round is written to the shared folder.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct()
    both = written(both, "edges")
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).select(F.col("u").alias("node"), "root")
    labels = written(labels, "labels")
    changed = 1
    while changed:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        moved = labels.join(near, labels.node == near.u, "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        up = labels.select(F.col("node").alias("n2"), F.col("root").alias("jump"))
        after = moved.join(up, moved.new == up.n2, "left").select("node", "root", F.least("new", F.coalesce("jump", "new")).alias("new"))
        after, changed = counted(after, "labels", F.col("new") != F.col("root"))
        labels = after.select("node", F.col("new").alias("root"))
    return labels
