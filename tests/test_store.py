import pytest
from pyspark.sql import types as T

from signalloom.sources.schemas import OF_PROFILE, TABLES, delete_profiles, store_table
from signalloom.sources.store import Table


def test_changes(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}", "items", "id int, kind string, v double", ["id"])
    assert t.rows().count() == 0
    row = lambda *r: spark.createDataFrame(list(r), "id int, kind string, v double, extra string")
    t.upsert(row((1, "a", 1.0, None), (2, "b", None, "x")))
    t.upsert(row((1, "c", 2.0, "x"), (1, "c", 2.0, "x")))
    t.insert_or_ignore(row((2, "z", 9.0, "x"), (3, "late", 3.0, "x"), (3, "early", 3.0, "x")), ["kind"])
    assert {tuple(r) for r in t.rows().collect()} == {(1, "c", 2.0), (2, "b", None), (3, "early", 3.0)}
    t.delete(row((1, None, None, None)))
    assert {r.id for r in t.rows().collect()} == {2, 3}
    t.upsert(row((1, "again", 0.0, None)))
    again = Table(spark, f"file://{tmp_path}", "items", "id int, kind string, v double", ["id"])
    assert {r.id for r in again.rows().collect()} == {1, 2, 3}


def test_half_written_change_does_not_count(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}", "items", "id int", ["id"])
    t.upsert(spark.createDataFrame([(1,)], "id int"))
    (tmp_path / "items" / "rows" / "2-lost").mkdir()
    assert [r.id for r in t.rows().collect()] == [1]


def test_two_writers_erase_nothing(spark, tmp_path):
    make = lambda: Table(spark, f"file://{tmp_path}", "items", "id int, v int", ["id"])
    a, b = make(), make()
    a._changes = lambda: []  # both saw the table empty
    b._changes = lambda: []
    a.upsert(spark.createDataFrame([(1, 1)], "id int, v int"))
    b.upsert(spark.createDataFrame([(2, 2)], "id int, v int"))
    assert {r.id for r in make().rows().collect()} == {1, 2}


def test_keyed_changes(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}", "items", "id int, v int, revision int", ["id"])
    row = lambda *r: spark.createDataFrame(list(r), "id int, v int")
    t.insert(row((1, 1), (2, 2)))
    for bad in (row((1, 5)), row((7, 1), (7, 2))):
        with pytest.raises(ValueError, match="duplicate key"):
            t.insert(bad)
    t.update(row((1, 9), (5, 9)), "revision")
    t.update(row((1, None)), "revision")
    assert {tuple(r) for r in t.rows().collect()} == {(1, None, 2), (2, 2, None)}
    assert [r.v for r in t.get(2).collect()] == [2] and t.get(5).count() == 0
    t.upsert(spark.createDataFrame([(3, 1, 1), (3, 2, 0)], "id int, v int, seq int"), ["seq"])
    assert t.get(3).first().v == 1
    before = sorted(map(tuple, t.rows().collect()), key=str)
    t.compact()
    assert len(t._changes()) == 1 and sorted(map(tuple, t.rows().collect()), key=str) == before
    assert [r.id for r in t.ordered().collect()] == [1, 2, 3]


def test_older_files_lack_a_column(spark, tmp_path):
    Table(spark, f"file://{tmp_path}", "items", "id int", ["id"]).insert(spark.createDataFrame([(1,)], "id int"))
    assert [tuple(r) for r in Table(spark, f"file://{tmp_path}", "items", "id int, embedding array<float>", ["id"]).rows().collect()] == [(1, None)]


def test_profiles_go_with_all_that_is_theirs(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name in ("profiles", *OF_PROFILE):
        t = store_table(spark, folder, name)
        key = [c for c in t.key if c != "profile_id"]
        who = "id" if name == "profiles" else "profile_id"
        t.insert(spark.createDataFrame([(p, *["x" + p] * len([k for k in key if k != who])) for p in ("a", "b")], ", ".join(f"{c} string" for c in [who, *[k for k in key if k != who]])))
    delete_profiles(spark, folder, ["a"])
    for name in ("profiles", *OF_PROFILE):
        assert store_table(spark, folder, name).rows().count() == 1


def test_every_table_has_its_key():
    assert len(TABLES) == 13 and all(set(k) <= set(T.StructType.fromDDL(s).names) for s, k in TABLES.values())
