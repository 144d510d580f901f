from datetime import datetime

from signalloom.streaming.ingest import Breaker, WatermarkIngest, drain, windowed_counts

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string"


def stream(spark, tmp_path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")


def at(day):
    return datetime(2024, 1, day)


def test_ingest_drops_old_items(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 1, at(5), "view")], [(1, 2, at(4), "view"), (1, 3, at(6), "view"), (2, 4, at(1), "view"), (1, 5, None, "view")])
    assert {r.event_id for r in WatermarkIngest(spark, "user_id", "ts").run(s).collect()} == {1, 3, 4, 5}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_ingest_survives_replay(spark, tmp_path):
    """A batch that is run again, also by another object on the same folder, leaves what it left before."""
    folder = f"file://{tmp_path}/ingest"
    first, second = frame(spark, [(1, 1, at(5), "view")]), frame(spark, [(1, 2, at(4), "view"), (1, 3, at(6), "view")])
    ingest = WatermarkIngest(spark, "user_id", "ts", folder)
    ingest(first, 0)
    ingest(first, 0)
    ingest(second, 1)
    again = WatermarkIngest(spark, "user_id", "ts", folder)
    again(second, 1)
    assert sorted(r.event_id for r in again.rows_log.read(SCHEMA).collect()) == [1, 3]
    assert [r.mark for r in again.marks(second, 2).collect()] == [at(6)]


def test_ingest_goes_on_after_restart(spark, tmp_path):
    folder = f"file://{tmp_path}/ingest"
    start = spark.createDataFrame([(2, at(9))], "user_id long, mark timestamp")
    s = stream(spark, tmp_path, [(1, 1, at(5), "view"), (2, 7, at(8), "view")])
    assert WatermarkIngest(spark, "user_id", "ts", folder, start).run(s).count() == 1
    frame(spark, [(1, 2, at(4), "view"), (1, 3, at(6), "view")]).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    s = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    got = WatermarkIngest(spark, "user_id", "ts", folder, start).run(s)
    assert sorted(r.event_id for r in got.collect()) == [1, 3]


def test_marks_are_summed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("signalloom.streaming.ingest.COMPACT", 2)
    ingest = WatermarkIngest(spark, "user_id", "ts", f"file://{tmp_path}/ingest")
    for n in range(5):
        for _ in range(2):
            ingest(frame(spark, [(n % 2, n, at(10 + n), "view"), (n % 2, 100 + n, at(9 + n - 1), "view")]), n)
    assert {r.user_id: r.mark for r in ingest.marks(frame(spark, []), 5).collect()} == {0: at(14), 1: at(13)}
    assert (tmp_path / "ingest/marks/sum/batch=4").exists() and len(list((tmp_path / "ingest/marks/each").glob("batch=*"))) == 5


def test_breaker_keeps_state(spark, tmp_path, monkeypatch):
    batches = [[(1, 1, at(1), "error"), (1, 2, at(2), "error")], [(1, 3, at(3), "error"), (2, 9, at(3), "error")], [(2, 10, at(5), "error"), (2, 4, at(4), "view")], [(3, 5, at(6), "view")]]
    breaker = Breaker(spark, "user_id", "ts", "event_id", "event_type = 'error'", f"file://{tmp_path}/breaker")
    got = breaker.run(stream(spark, tmp_path, *batches))
    assert {tuple(r) for r in got.collect()} == {(1, 3, True), (2, 1, False), (3, 0, False)}
    # The same where sums are made in between and batches are run twice.
    monkeypatch.setattr("signalloom.streaming.ingest.COMPACT", 2)
    other = Breaker(spark, "user_id", "ts", "event_id", "event_type = 'error'", f"file://{tmp_path}/other")
    for n, rows in enumerate(batches):
        other(frame(spark, rows), n)
        other(frame(spark, rows), n)
    state = other._fold(other.log.up_to(other._schema({"user_id": "bigint"}), 3))
    assert {(r.user_id, r.failures) for r in state.collect()} == {(1, 3), (2, 1), (3, 0)}


def test_windows(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 1, at(1), "view"), (1, 2, at(1), "view")], [(1, 3, at(9), "view")])
    assert ("view", 2) in {(r.event_type, r.n) for r in drain(windowed_counts(s, "ts"), "w").collect()}
