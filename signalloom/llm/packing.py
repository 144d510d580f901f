"""Filling fixed-capacity containers with texts measured in tokens.

Bounded-space online packing: each partition keeps a fixed number of open
windows, puts every text into the one with the least room that still holds it,
and closes the fullest when none does.  The windows left open at the end are
merged like texts, over fewer and fewer partitions.  Only a text larger than the
capacity is split, into full containers and a rest that is packed like a text.

Defined results: a text without tokens takes part with size 0; repeated rows are
packed as often as they come; an empty table gives no rows; containers are
numbered per spec and the same for the same input.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.storage import written
from signalloom.llm.tokens import token_count

OPEN = 64
#: Texts per partition (some 40 MB of sizes; the texts themselves take no part), and partitions merged into one per round.
ROWS_PER_PARTITION, FAN_IN = 1_000_000, 16


class Windows:
    """The open windows of one partition, by remaining room."""

    def __init__(self, capacity: int, limit: int = OPEN):
        self.capacity, self.limit = capacity, limit
        self.rooms: list[tuple[int, int]] = []
        self.made = 0

    def place(self, size: int) -> int:
        """The window that takes an item; opens one, closing the fullest if too many are open."""
        k = bisect_left(self.rooms, (size, -1))
        if k < len(self.rooms):
            room, window = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.limit:
                self.rooms.pop(0)
            room, window = self.capacity, self.made
            self.made += 1
        insort(self.rooms, (room - size, window))
        return window

    def left(self) -> dict[int, int]:
        """Used size of each window that is still open."""
        return {w: self.capacity - room for room, w in self.rooms}


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, tok_start, tokens; one piece unless the text is larger than the capacity."""
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    each = sized.select("doc_id", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return each.select("doc_id", "piece", start.alias("tok_start"), F.least(F.lit(capacity).cast("long"), F.col("all") - start).alias("tokens"))


def _packer(capacity: int, out: str):
    """Packs the rows of one partition in their order and hands each on at once; ``out`` windows are named by partition and number.

    After the last row come the windows that are still open, as rows with ``used`` set.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        w = Windows(capacity)
        columns: list[str] = []
        for b in batches:
            columns = list(b.columns)
            yield b.assign(**{out: [part + w.place(int(t)) for t in b["tokens"]], "used": -1})
        left = w.left()
        if left:
            yield pd.DataFrame({**{c: 0 for c in columns}, out: [part + k for k in left], "used": list(left.values())})

    return run


def pack(sized: DataFrame, name: str, capacity: int) -> DataFrame:
    """bin_name, container, doc_id, piece, tok_start, tokens of texts given as doc_id, tokens."""
    items = pieces(sized, capacity)
    whole = items.where(F.col("tokens") == capacity)
    rest = items.where(F.col("tokens") < capacity)
    total = rest.agg(F.count("*").alias("n")).first()
    count = max(1, -(-total.n // ROWS_PER_PARTITION))
    schema = "doc_id long, piece int, tok_start long, tokens long, window long, used long"
    # Dealt out in turn, as one doc_id may hold many rows; the order inside a partition is fixed by a hash.
    placed = rest.repartition(count).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "tok_start", "tokens")
    placed = written(placed.mapInPandas(_packer(capacity, "window"), schema), "placed")

    # Rounds of merging what was left open: old window -> new window.
    open_ = placed.where("used >= 0").select("window", F.col("used").alias("tokens"))
    placed = placed.where("used < 0")
    moves: DataFrame | None = None
    level = 1
    while True:
        count = -(-count // FAN_IN)
        merged = open_.repartition(count, F.xxhash64(F.expr("window >> 32"))).sortWithinPartitions(F.desc("tokens"), "window")
        merged = written(merged.mapInPandas(_packer(capacity, "into"), "window long, tokens long, into long, used long"), "merged")
        # Levels number their windows apart from each other.
        step = merged.select("window", (F.col("into") + F.lit(level << 56)).alias("into"), "used")
        pairs = step.where("used < 0").select("window", "into")
        if moves is None:
            moves = pairs
        else:
            moves = moves.join(pairs.select(F.col("window").alias("into"), F.col("into").alias("later")), "into", "left").select("window", F.coalesce("later", "into").alias("into"))
        if count == 1:
            break
        open_ = step.where("used >= 0").select(F.col("into").alias("window"), F.col("used").alias("tokens"))
        level += 1
    final = placed.join(moves, "window", "left").select(F.coalesce("into", "window").alias("container"), "doc_id", "piece", "tok_start", "tokens")
    # A full piece is a container of its own.
    own = written(whole, "whole").select((F.lit(-1) - F.monotonically_increasing_id()).alias("container"), "doc_id", "piece", "tok_start", "tokens")
    return final.unionByName(own).select(F.lit(name).alias("bin_name"), "container", "doc_id", "piece", "tok_start", "tokens")


def packed(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """All texts packed for every spec of the fixed table bin_name, capacity_tokens."""
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text")).alias("tokens")), "sized")
    out = None
    for s in specs.orderBy("bin_name").collect():
        one = pack(sized, s.bin_name, int(s.capacity_tokens))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], "bin_name string, container long, doc_id long, piece int, tok_start long, tokens long")


def fill(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """bin_name, containers, tokens, fill (share of the room used), split_texts."""
    each = rows.groupBy("bin_name", "container").agg(F.sum("tokens").alias("tokens"), F.count_if((F.col("piece") == 1)).alias("split"))
    total = each.groupBy("bin_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("split").alias("split_texts"))
    return total.join(specs, "bin_name").select("bin_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"), "split_texts")
