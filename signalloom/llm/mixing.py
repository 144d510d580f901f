"""Mixing sources to target weights.

The tokens of each source are laid end to end in a pseudorandom order of its
texts and cut into blocks of fixed length.  Every output shard draws its counts
per source from a multinomial; the slots of a source are mapped through a
pseudorandom permutation of its block numbers, a new one for each pass over the
source, and joined with the blocks.  Shards are drawn in chunks, each from a seed of its own,
so executors number and draw them; what chance put beyond a source's quota in
the end is handed to the sources that fell short.  No block is used more often than
max_repeats; the mix is as large as the scarcest source allows.

Positions come from prefix sums over hashed buckets, so no source, however
large, is put in order by one task.

Defined results: sources without a target or with a null name are not drawn;
targets without texts get nothing and the report shows 0; texts without tokens
are in no block; repeated rows are texts of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.llm.storage import written
from signalloom.llm.tokens import token_count

BLOCK = 512
SLOTS = 256
#: Shards drawn from one seed, and chunks drawn by one task (some 2 million slots, 100 MB).
CHUNK, CHUNKS_PER_TASK = 1000, 8
ROWS_PER_BUCKET = 20_000


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of each i < n under a keyed pseudorandom permutation of range(n): a Feistel network with cycle walking."""
    half = max(1, (max(1, int(n - 1).bit_length()) + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = i.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0xBF58476D1CE4E5B9 + r * 0x94D049BB133111EB) & ((1 << 64) - 1))
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def blocks(docs: DataFrame, sources: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """source, block, doc_id, tok_start, tok_end of every piece of a text in a block."""
    sized = docs.where("source is not null").join(sources.select("source").distinct(), "source", "left_semi")
    sized = written(sized.select(F.col("doc_id").cast("long").alias("doc_id"), "source", token_count(F.col("text")).alias("tokens")).where("tokens > 0"), "sized")
    buckets = max(8, sized.count() // ROWS_PER_BUCKET)
    # The row's place is part of the hash, so that repeated ids spread over the buckets too.
    rows = sized.withColumn("h", F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    base = sums.withColumn("base", F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = rows.withColumn("end", F.sum("tokens").over(inner)).join(base.drop("sum"), ["source", "bucket"]).select("source", "doc_id", "tokens", (F.col("base") + F.col("end") - F.col("tokens")).alias("from"))
    each = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("tokens") - 1) / block))))
    begin = F.greatest(F.lit(0), F.col("block") * block - F.col("from"))
    end = F.least(F.col("tokens"), (F.col("block") + 1) * block - F.col("from"))
    return written(each.select("source", "block", "doc_id", begin.alias("tok_start"), end.alias("tok_end")), "blocks")


def quotas(have: dict[str, int], targets: list[tuple[str, float, int]]) -> tuple[int, list[str], list[int]]:
    """(slots of the mix, sources, slots of each); have: blocks per source.  The mix is as large as the scarcest source allows."""
    use = [(s, t, r) for s, t, r in targets if have.get(s, 0) > 0 and t > 0 and r > 0]
    if not use:
        return 0, [], []
    share = np.array([t for _, t, _ in use]) / sum(t for _, t, _ in use)
    cap = np.array([have[s] * r for s, _, r in use])
    size = int(np.floor((cap / share).min()))
    quota = np.floor(share * size).astype(np.int64)
    quota[np.argsort(quota - share * size)[: size - quota.sum()]] += 1
    quota = np.minimum(quota, cap)
    return int(quota.sum()), [s for s, _, _ in use], quota.tolist()


def slots(spark: SparkSession, have: dict[str, int], size: int, names: list[str], quota: list[int], seed: int) -> DataFrame:
    """shard, slot, source, pass, block of every slot; slots of a shard are not in order yet."""
    schema = "shard long, slot long, source string, pass int, block long"
    if not size:
        return spark.createDataFrame([], schema)
    shards = max(1, size // SLOTS)
    share = np.array(quota) / size
    per_chunk, base = CHUNK, size // shards
    longer = size % shards

    def drawn(chunk: int) -> np.ndarray:
        """Slots per shard of the chunk and source."""
        ids = np.arange(chunk * per_chunk, min(shards, (chunk + 1) * per_chunk))
        return np.random.default_rng([seed, chunk]).multinomial(base + (ids < longer), share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk": b["id"], "counts": [drawn(int(c)).sum(0).tolist() for c in b["id"]]})

    chunks = -(-shards // per_chunk)
    tasks = -(-chunks // CHUNKS_PER_TASK)
    counts = written(spark.range(0, chunks, 1, tasks).mapInPandas(count, "chunk long, counts array<long>"), "counts")
    each = counts.select("chunk", F.posexplode("counts").alias("j", "n"))
    # One row per 1000 shards and source.
    before = F.coalesce(F.sum("n").over(W.partitionBy("j").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = each.withColumn("start", before).groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "start"))), lambda x: x["start"]).alias("starts"))
    got = {r.j: r.n for r in each.groupBy("j").agg(F.sum("n").alias("n")).collect()}  # one row per source
    total = np.array([got[j] for j in range(len(names))])
    over, under = np.maximum(0, total - quota), np.maximum(0, np.array(quota) - total)
    over_from, under_to = np.cumsum(over) - over, np.cumsum(under)
    blocks = np.array([have[n] for n in names])
    keys = [zlib.crc32(n.encode()) for n in names]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, start in zip(b["chunk"], b["starts"]):
                n = drawn(int(chunk))
                ids = np.arange(len(n)) + chunk * per_chunk
                shard = np.concatenate([np.repeat(ids, n[:, j]) for j in range(len(names))])
                source = np.repeat(np.arange(len(names)), n.sum(0))
                q = np.concatenate([start[j] + np.arange(n[:, j].sum()) for j in range(len(names))])
                # Beyond the quota: the same number among all that is over, counted into what is short.
                late = q >= np.array(quota)[source]
                place = over_from[source[late]] + q[late] - np.array(quota)[source[late]]
                to = np.searchsorted(under_to, place, side="right")
                q[late], source[late] = total[to] + place - (under_to[to] - under[to]), to
                passes = q // blocks[source]
                block = np.empty(len(q), np.int64)
                for j, p in {(int(j), int(p)) for j, p in zip(source, passes)}:
                    at = (source == j) & (passes == p)
                    block[at] = permuted(q[at] % blocks[j], int(blocks[j]), seed + 31 * p + keys[j])
                yield pd.DataFrame({"shard": shard, "slot": q, "source": np.array(names, object)[source], "pass": passes.astype("int32"), "block": block})

    return starts.repartition(tasks, "chunk").mapInPandas(draw, schema)


def mixed(docs: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """shard, slot, source, pass, block, doc_id, tok_start, tok_end of the whole mix; targets is the fixed table source, target_share, max_repeats."""
    made = blocks(docs, targets, block, seed)
    have = {r["source"]: r["n"] for r in made.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}
    wanted = sorted((r.source, float(r.target_share), int(r.max_repeats)) for r in targets.collect())
    mix = slots(docs.sparkSession, have, *quotas(have, wanted), seed)
    order = W.partitionBy("shard").orderBy(F.xxhash64("shard", "source", "slot"), "source", "slot")
    mix = mix.withColumn("slot", F.row_number().over(order).cast("long"))
    return mix.join(made, ["source", "block"]).select("shard", "slot", "source", "pass", "block", "doc_id", "tok_start", "tok_end")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, most_repeats, max_repeats for every target."""
    part = mix.groupBy("source").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("tokens"), (F.max("pass") + 1).alias("most_repeats"))
    total = part.agg(F.sum("tokens").alias("all"))
    joined = targets.join(part, "source", "left").join(F.broadcast(total))  # one row
    return joined.select("source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.col("all"), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
