"""Packing and mixing."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.llm.mixing import mixed, permuted, quotas, shares, slots
from signalloom.llm.packing import Windows, fill, pack
from signalloom.llm.tokens import PART, count, encoder, token_count

pytestmark = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabulary files here")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200), st.integers(1, 8))
def test_windows_never_overfill(sizes, limit):
    w = Windows(50, limit)
    used: dict[int, int] = {}
    for s in sizes:
        k = w.place(s)
        used[k] = used.get(k, 0) + s
        assert len(w.rooms) <= limit
    assert all(v <= 50 for v in used.values()) and all(used[k] == v for k, v in w.left().items())


def _rows():
    rng = np.random.default_rng(2)
    return [(i, int(s)) for i, s in enumerate(rng.integers(0, 120, 400))] + [(5000, 1000), (5001, 200), (5002, 100), (1, 30), (1, 30), (6000, 0)]


def _packed(spark, rows):
    got = pack(spark.createDataFrame(rows, "doc_id long, tokens long"), "b", 100).collect()
    assert sum(r.tokens for r in got) == sum(s for _, s in rows)
    size: dict[int, int] = {}
    for r in got:
        size[r.container] = size.get(r.container, 0) + r.tokens
    assert max(size.values()) <= 100
    assert {r.doc_id for r in got if r.piece > 0} <= {i for i, s in rows if s > 100}
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    return got, size


def test_pack_many_rounds(spark, monkeypatch):
    """Partitions of a few containers, so that what is left open is merged over several rounds."""
    monkeypatch.setattr("signalloom.llm.packing.ROWS_PER_PARTITION", 20)
    monkeypatch.setattr("signalloom.llm.packing.FAN_IN", 3)
    _packed(spark, _rows())


def test_pack_fill(spark):
    rows = _rows()
    got, size = _packed(spark, rows)
    assert len(size) <= 1.05 * sum(s for _, s in rows) / 100 + 2
    specs = spark.createDataFrame([("b", 100)], "bin_name string, capacity_tokens long")
    assert fill(spark.createDataFrame(got), specs).first().fill > 0.95
    assert pack(spark.createDataFrame([], "doc_id long, tokens long"), "b", 100).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_permutation(n, key):
    assert sorted(permuted(np.arange(n), n, key)) == list(range(n))


def test_quotas_meet_targets_and_caps():
    size, names, quota = quotas({"a": 1000, "b": 10_000, "c": 0}, [("a", 0.5, 2), ("b", 0.4, 1), ("c", 0.1, 3)])
    total = dict(zip(names, quota))
    assert sum(quota) == size and total["a"] <= 2000 and total["b"] <= 10_000
    assert abs(total["a"] / size - 0.5 / 0.9) < 0.002
    assert quotas({}, [("a", 1.0, 1)])[1] == []


def test_every_slot_is_drawn_once(spark, monkeypatch):
    """Over many shards each source gets its quota, every place of a pass at most once, and no shard is empty."""
    monkeypatch.setattr("signalloom.llm.mixing.SLOTS", 16)
    monkeypatch.setattr("signalloom.llm.mixing.CHUNK", 4)
    have = {"a": 300, "b": 2000}
    size, names, quota = quotas(have, [("a", 0.3, 2), ("b", 0.7, 1)])
    got = slots(spark, have, size, names, quota, 5).collect()
    assert len(got) == size and {n: sum(r.source == n for r in got) for n in names} == dict(zip(names, quota))
    assert len({(r.source, r["pass"], r.block) for r in got}) == size and all(r.block < have[r.source] for r in got)
    assert {r.shard for r in got} == set(range(size // 16))


def test_mix(spark):
    rows = [(i, "token " * (20 + i % 50), "small" if i % 10 == 0 else "big") for i in range(600)] + [(9000, None, "big"), (9001, "", "small"), (9002, "x", None), (9003, "x", "other"), (1, "token", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("small", 0.3, 3), ("big", 0.7, 1), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix = mixed(docs, targets, block=64)
    got = mix.collect()
    uses: dict[tuple, int] = {}
    for r in got:
        uses[r.source, r.doc_id, r.tok_start, r.tok_end, r.block] = uses.get((r.source, r.doc_id, r.tok_start, r.tok_end, r.block), 0) + 1
    assert all(n <= (3 if k[0] == "small" else 1) for k, n in uses.items())
    report = {r.source: r for r in shares(mix, targets).collect()}
    assert abs(report["small"].actual_share - 0.3) < 0.03 and report["none"].tokens == 0
    assert {r.source for r in got} == {"small", "big"}
    assert mixed(docs.limit(0), targets).count() == 0


def test_tokens(spark):
    enc = encoder()
    assert count(None, enc) == count("", enc) == 0 and count("hello world", enc) == 2
    long = "word " * (PART // 4)
    assert count(long, enc) >= len(long.split())
    df = spark.createDataFrame([("<|endoftext|>",), (None,)], "t string")
    assert [r.n for r in df.select(token_count(df.t).alias("n")).collect()][1] == 0
