import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalloom.functions import display as D
from signalloom.functions import scoring as S
from signalloom.functions import text as X


def val(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    ("content", "summary", "keywords", "negatives", "want"),
    [
        ("Grids of solar cells store heat", None, ["solar", "heat"], [], 1.0),
        ("Solar cells at night", None, ["solar", "heat", "wind"], [], 1 / 3),
        ("Solar heat in a storm", None, ["solar", "heat"], ["storm"], 0.0),
        ("Nothing is asked for", None, [], [], 0.0),
        ("A note without them", "Solar cells store heat", ["solar", "heat"], [], 1.0),
        ("Windows and rewinding", None, ["wind"], [], 0.0),
        ("Offshore wind farm plans", None, ["wind farm"], [], 1.0),
        ("The wind over a farm", None, ["wind farm"], [], 0.0),
        ("An off-grid-ready pump", None, ["off-grid-ready"], [], 1.0),
        ("Unheated rooms are heated", None, ["heated"], ["heat"], 1.0),
        (None, None, ["solar"], [], 0.0),
        ("", "", ["solar", ""], [], 0.0),
    ],
)
def test_keyword_score(spark, content, summary, keywords, negatives, want):
    r = val(spark, S.keyword_score(F.col("c"), F.col("s"), keywords, negatives), c=content, s=summary)
    assert r == pytest.approx(want)
    df = spark.createDataFrame([(content, summary)], "c string, s string")
    assert S.with_keyword_score(df, "c", "s", keywords, negatives).first().score == pytest.approx(want)


def test_repetition_and_both_fields(spark):
    one = val(spark, S.keyword_score(F.col("c"), F.col("s"), ["ai", "x", "y"]), c="ai", s=None)
    many = val(spark, S.keyword_score(F.col("c"), F.col("s"), ["ai", "x", "y"]), c="ai ai ai ai", s=None)
    both = val(spark, S.keyword_score(F.col("c"), F.col("s"), ["ai", "x", "y"]), c="ai", s="ai")
    assert many == pytest.approx(one * 1.2) and both == pytest.approx(one * 1.15)


def test_overlapping_phrases(spark):
    assert val(spark, X.count_phrase(X.token_text(F.col("c")), "a a"), c="a a a b a a") == 3


@pytest.mark.parametrize(("text", "limit", "dots", "want"), [("a warm deep well", 13, False, "a warm deep"), ("pump", 11, False, "pump"), ("ééééé", 5, False, "éé"), ("a warm deep well", 12, True, "a warm..."), ("日本語です", 7, False, "日本"), (None, 5, False, None), ("", 5, True, "")])
def test_truncated(spark, text, limit, dots, want):
    assert val(spark, X.truncated(F.col("t"), limit, dots), t=text) == want


def test_text(spark):
    assert val(spark, X.squeezed(F.lit("  a \n  b "))) == "a b"
    assert val(spark, X.plain_doi(F.lit("https://doi.org/10.1/x"))) == "10.1/x"
    assert val(spark, X.arxiv_from_doi(F.lit("10.48550/arXiv.1907.40123"))) == "1907.40123"
    assert val(spark, X.arxiv_from_doi(F.lit("10.1/x"))) is None
    index = F.create_map(F.lit("one"), F.array(F.lit(0), F.lit(3)), F.lit("pump"), F.array(F.lit(1)), F.lit("feeds"), F.array(F.lit(2)), F.lit("well"), F.array(F.lit(4)))
    assert val(spark, X.from_inverted(index)) == "one pump feeds one well"
    assert val(spark, X.from_inverted(F.lit(None).cast("map<string,array<int>>"))) is None


def test_scalars(spark):
    assert [val(spark, S.backoff_seconds(F.lit(n))) for n in (0, 4, 5, 6, 9)] == [0, 0, 30, 60, 300]
    assert [val(spark, S.disposition_class(F.lit(s))) for s in (" Applied", "blocked", "", "weird")] == ["favorable", "unfavorable", "pending", "pending"]
    assert val(spark, S.adjusted(F.lit(0.8), F.lit(-0.3), F.lit(True))) == pytest.approx(0.25)
    assert val(spark, S.budget_allows(F.lit(1000), F.lit(2000))) and not val(spark, S.budget_allows(F.lit(1500), F.lit(2000)))
    v = lambda *x: F.array(*[F.lit(float(i)).cast("float") for i in x])
    assert val(spark, S.cosine(v(1, 0), v(1, 0))) == pytest.approx(1) and val(spark, S.cosine(v(1, 0), v(0, 1))) == 0
    assert val(spark, S.cosine(v(1, 0), v(1))) == 0 and val(spark, S.cosine(v(0, 0), v(1, 0))) == 0


def test_local_embeddings(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r.embedding for r in S.local_embeddings(df, "id", "t", 32).collect()}
    assert math.sqrt(sum(x * x for x in got[1])) == pytest.approx(1, abs=1e-5)
    assert got[2] == [0.0] * 32 == got[3]


@given(st.text(alphabet="ab é日\n", max_size=40), st.integers(4, 30))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_truncated_like_brute_force(spark, text, limit):
    want = max((text[:k] for k in range(len(text) + 1) if len(text[:k].encode()) <= limit), key=len)
    if len(text.encode()) > limit:
        cut = [i for i, c in enumerate(want) if c.isspace()]
        want = want[: cut[-1]] if cut and cut[-1] else want
    else:
        want = text
    assert val(spark, X.truncated(F.col("t"), limit), t=text) == want


def test_display(spark):
    assert [val(spark, D.colour(F.lit(x))) for x in (0.95, 0.7, 0.5, 0.1)] == [0xFF0000, 0xFF8C00, 0xFFD700, 0x808080]
    assert val(spark, D.percent(F.lit(0.125))) == "12%" and val(spark, D.percent(F.lit(0.375))) == "38%"
    assert val(spark, D.domain_slug(F.lit("Data Bases"))) == "data-bases"
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    assert val(spark, D.limited_until(F.lit("HTTP 429"), now).cast("string")) == "2024-01-01 00:20:00" and val(spark, D.limited_until(F.lit("gone"), now)) is None
    assert val(spark, D.limited_until(F.lit("Rate Limit hit"), now, 5).cast("string")) == "2024-01-01 00:15:00"
    assert val(spark, D.should_poll(now, F.lit(None).cast("timestamp"), 60)) and not val(spark, D.should_poll(now, now, 0)) and not val(spark, D.should_poll(now, F.lit("2024-01-01 00:09:30").cast("timestamp"), 60))
    assert val(spark, D.experiment(F.lit("X"))).endswith(": X") and "JSON" in val(spark, D.scoring_prompt(F.lit("p"), F.array(F.lit("a"), F.lit("b")), F.lit("t")))
    assert "Claim: c" in val(spark, D.critique_prompt(F.lit("t"), F.lit("c")))
