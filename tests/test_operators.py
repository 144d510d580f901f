import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import feedback, relational, state
from signalloom.operators.relational import numbered
from signalloom.operators.vectors import novelty


def test_novelty_like_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    m[5] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    got = {r.id: r.max_similarity for r in novelty(df.where("id % 10 = 5"), df.where("id % 10 <> 5"), "id", "v").collect()}
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    others = [i for i in range(60) if i % 10 != 5]
    for i in range(5, 60, 10):
        assert got[i] == pytest.approx(float((unit[others] @ unit[i]).max()), abs=1e-5)
    alone = novelty(df.where("id = 1"), df.limit(0), "id", "v").first()
    assert alone.novelty == 1.0


def test_latest_and_first_wins(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, None), (2, 1, "c")], "k int, seq int, v string")
    assert {(r.k, r.v) for r in relational.latest(log, ["k"], ["seq"]).collect()} == {(1, "b"), (2, "c")}
    old = spark.createDataFrame([(1, 0, "x")], "k int, seq int, v string")
    assert {(r.k, r.v) for r in relational.first_wins(old, log, ["k"], ["seq"]).collect()} == {(2, "c")}


def test_upsert_keeps_columns(spark):
    old = spark.createDataFrame([("f", "accepted", 0.5)], "id string, outcome string, confidence double")
    new = spark.createDataFrame([("f", "pending", 0.91), ("g", "pending", 0.4)], "id string, outcome string, confidence double")
    got = {r.id: (r.outcome, r.confidence) for r in relational.upserted(old, new, "id", ["outcome"]).collect()}
    assert got == {"f": ("accepted", 0.91), "g": ("pending", 0.4)}


def test_breaker(spark):
    rows = [("arxiv", i, False) for i in range(10)] + [("arxiv", 10, True), ("arxiv", 11, False)] + [("s2", i, False) for i in range(5)] + [("s2", 5 + i, True) for i in range(3)] + [("oa", 1, False), ("bad", 1, True)]
    df = spark.createDataFrame(rows, "k string, t int, failed boolean")
    got = {r.k: r.consecutive_failures for r in state.failures_in_a_row(df, "k", F.col("t"), F.col("failed"), F.col("t")).collect()}
    assert got == {"arxiv": 0, "s2": 3, "oa": 0, "bad": 1}


def test_budget(spark):
    calls = spark.createDataFrame([("p", i, 4000) for i in range(3)], "p string, i int, cost int")
    assert state.within_budget(calls, "p", [F.col("i")], F.col("cost"), 8500).count() == 2


def test_usefulness_and_dispositions(spark):
    rows = [("good", "accepted")] * 3 + [("good", "rejected"), ("bad", "accepted")] + [("bad", "rejected")] * 3 + [("unknown", "weird")]
    got = {r.k: r.usefulness for r in feedback.useful_by(spark.createDataFrame(rows, "k string, outcome string"), "k").collect()}
    assert got == {"good": round(4 / 6, 6), "unknown": 0.5, "bad": round(2 / 6, 6)}
    d = spark.createDataFrame([(1, "favorable"), (1, "unfavorable"), (2, "unfavorable"), (2, "unfavorable"), (3, "pending"), (3, "unfavorable"), (4, None)], "k int, d string")
    assert {r.k: r.disposition for r in feedback.reduced(d, "k", F.col("d")).collect()} == {1: "favorable", 2: "unfavorable", 3: "pending", 4: "pending"}


def test_watermarks(spark):
    items = spark.createDataFrame([("a", 1), ("a", 5), ("a", None), ("b", 1)], "k string, t int")
    marks = spark.createDataFrame([("a", 3)], "k string, mark int")
    taken = state.past_watermark(items, marks, "k", "t", "mark")
    assert sorted((r.k, r.t or 0) for r in taken.collect()) == [("a", 0), ("a", 5), ("b", 1)]
    assert {r.k: r.mark for r in state.advanced(marks, taken, "k", "t", "mark").collect()} == {"a": 5, "b": 1}


def test_numbered_over_ranges_and_inside_groups(spark):
    rows = [(i % 3 if i < 300 else 0, i * 7 % 401, i) for i in range(400)] + [(None, 5, 900), (None, 4, 901)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(7)
    got = {r.id: r.n for r in numbered(df, [F.asc("v"), F.asc("id")], "n").collect()}
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert got == want
    got = {(r.g, r.id): r.n for r in numbered(df, [F.desc("v"), F.asc("id")], "n", ["g"]).collect()}
    for g in (0, 1, 2, None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[g, r[2]] for r in mine] == list(range(len(mine)))
    assert numbered(df.limit(0), [F.asc("v")], "n").count() == 0


def test_a_query_is_no_prior_of_its_own(spark, monkeypatch):
    monkeypatch.setattr("signalloom.operators.vectors.BLOCK", 3)
    monkeypatch.setattr("signalloom.operators.vectors.SIDE", 2)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 4))
    vectors[7] = vectors[3] * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, [1.0, 0.0])], "k long, v array<double>").repartition(3)
    got = {r.k: r.max_similarity for r in novelty(df.where("k % 2 = 1 or k = 90"), df, "k", "v").collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    assert got.pop(90) == 0 and got == pytest.approx({i: s[i].max() for i in range(1, 40, 2)}) and got[7] == pytest.approx(1)
