import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.operators.packed import explode_packed, split


def values(text, people=False):
    parent, pos, val = split(pa.array(["", text, None]), people)
    assert list(pos) == list(range(1, len(val) + 1)) and set(parent) <= {1}
    return val.to_pylist()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a,b , c", ["a", "b", "c"]),
        (";a; ; b;", ["a", "b"]),
        ('["x, y","i/o","m, \\"s\\""]', ["x, y", "i/o", 'm, "s"']),
        ("['a', 'b c']", ["a", "b c"]),
        ('"m, ""s""",b', ['m, "s"', "b"]),
        ("learning\\, federated,rust", ["learning, federated", "rust"]),
        ("#c++ #i/o #long_x", ["c++", "i/o", "long_x"]),
        ("ci/cd / r&d", ["ci/cd", "r&d"]),
        ("a·b", ["a", "b"]),
        ("a；b", ["a", "b"]),
        ("a\r\nb\n", ["a", "b"]),
        ("a\tb", ["a", "b"]),
        ("a; b | c,d", ["a", "b", "c", "d"]),
        ("one", ["one"]),
        ("a,a", ["a", "a"]),
        ("[]", []),
        ("  ", []),
        (None, []),
        ('["donn\\u00e9es"]', ["données"]),
        ('a "quoted', ['a "quoted']),
    ],
)
def test_tags(text, want):
    assert values(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ada Bo, Cy Du and Eve Fo", ["Ada Bo", "Cy Du", "Eve Fo"]),
        ("Bo, Ada", ["Bo, Ada"]),
        ("Bo, A., van Du, C., Fo-Gu, E.", ["Bo, A.", "van Du, C.", "Fo-Gu, E."]),
        ("Bo, A. and Du, C.", ["Bo, A.", "Du, C."]),
        ("Bo, Ada; Du, Cy;", ["Bo, Ada", "Du, Cy"]),
        ("Ada Bo, Cy Du, Jr.", ["Ada Bo", "Cy Du, Jr."]),
        ("Ada Bo, Cy Du et al.", ["Ada Bo", "Cy Du"]),
        ("Ada Bo and others", ["Ada Bo"]),
        ("Ada Bo und Cy Du", ["Ada Bo", "Cy Du"]),
        ("Du Center for Soil and Water Computing", ["Du Center for Soil and Water Computing"]),
        ('"Bo, A.", "Du, C."', ["Bo, A.", "Du, C."]),
        ('["Ada Bo", "Cy Du"]', ["Ada Bo", "Cy Du"]),
    ],
)
def test_people(text, want):
    assert values(text, True) == want


plain = st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cc", "Zs", "Zl", "Zp"), exclude_characters="\"'#\\[]{}-*•·；，、｜"), min_size=1, max_size=6).map(lambda s: "v" + s + "v")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(plain, max_size=5), max_size=6))
def test_json_round_trip(rows):
    parent, pos, val = split(pa.array([json.dumps(r) for r in rows], pa.string()))
    got = [[] for _ in rows]
    for p, v in zip(parent, val.to_pylist()):
        got[p].append(v)
    assert got == rows


def test_frame(spark):
    df = spark.createDataFrame([("k1", "a,b", 1), ("k1", "a,b", 1), ("k2", None, 2), ("k3", "x" * 200_000, 3), (None, "z", 4)], "id string, tags string, val int")
    got = sorted((r.row_key or "", r.pos, len(r.val)) for r in explode_packed(df, "id", "tags").collect())
    assert got == [("", 1, 1), ("k1", 1, 1), ("k1", 1, 1), ("k1", 2, 1), ("k1", 2, 1), ("k3", 1, 200_000)]
    assert explode_packed(df.limit(0), "id", "tags").count() == 0
