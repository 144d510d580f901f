"""Timestamps against the standard library, value by value."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.operators.timestamps import normalise, parse, transitions, zone_table, zone_version


def one(value, zone="UTC", order="dmy"):
    r = parse(pd.Series([value]), pd.Series([zone]), pd.Series([order]))[0]
    return None if pd.isna(r) else int(r)


def us(*a, tz=timezone.utc):
    return int((datetime(*a, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


@pytest.mark.parametrize(
    ("value", "zone", "order", "want"),
    [
        ("2020-05-06", "Asia/Tokyo", "ymd", us(2020, 5, 6)),
        ("05/06/2020", "UTC", "mdy", us(2020, 5, 6)),
        ("05/06/2020", "UTC", "dmy", us(2020, 6, 5)),
        ("2020-07-01 12:00:00", "America/New_York", "mdy", us(2020, 7, 1, 16)),
        ("2020-11-01 01:30", "America/New_York", "mdy", us(2020, 11, 1, 5, 30)),
        ("2021-03-28 02:30", "Europe/Berlin", "dmy", us(2021, 3, 28, 1, 30)),
        ("2020-07-01T12:00:00.25+05:30", "UTC", "dmy", us(2020, 7, 1, 6, 30, 0, 250000)),
        ("Aug 14, 2023 09:27 PM EDT", "UTC", "mdy", us(2023, 8, 15, 1, 27)),
        ("12/01/2021 12:05 AM", "UTC", "mdy", us(2021, 12, 1, 0, 5)),
        ("2019-07-07 18:07:19 Europe/Berlin", "Asia/Tokyo", "ymd", us(2019, 7, 7, 16, 7, 19)),
        ("16. März 2022", "UTC", "dmy", us(2022, 3, 16)),
        ("1er août 2015", "UTC", "dmy", us(2015, 8, 1)),
        ("2020-W53-5", "UTC", "dmy", us(2021, 1, 1)),
        ("02-FEB-19", "UTC", "dmy", us(2019, 2, 2)),
        ("1415573404", "Asia/Tokyo", "ymd", 1415573404000000),
        ("1567176790550", "UTC", "dmy", 1567176790550000),
        (" 20190519T134842Z", "UTC", "dmy", us(2019, 5, 19, 13, 48, 42)),
        ("2020-12-31T24:00:00Z", "UTC", "dmy", us(2021, 1, 1)),
    ],
)
def test_forms(value, zone, order, want):
    assert one(value, zone, order) == want


@pytest.mark.parametrize("value", [None, "", " ", "n.d.", "-", "TBA", "2021", "2021-05", "Q3 2021", "Spring 2019", "Sep 2018", "2023-02-30", "0000-00-00", "2021-W54-1", "31/31/2020", "2020-01-01T25:00", "12 Foo 2020", "x" * 100_000, "2020-01-01 10:00 Nowhere/City"])
def test_no_instant(value):
    assert one(value) is None


@settings(max_examples=60, deadline=None)
@given(st.datetimes(datetime(1971, 1, 2), datetime(2037, 12, 30)), st.sampled_from(["UTC", "America/New_York", "Europe/London", "Asia/Kolkata", "Australia/Sydney"]))
def test_local_times_like_zoneinfo(t, zone):
    want = int((t.replace(tzinfo=ZoneInfo(zone), fold=0) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
    assert one(t.strftime("%Y-%m-%dT%H:%M:%S.%f"), zone) == want


def test_unknown_zone_and_version():
    assert transitions("No/Such") is None
    assert one("2020-01-01 10:00", "No/Such") == us(2020, 1, 1, 10)
    assert zone_version()


def test_frame(spark):
    clocks = spark.createDataFrame([("a", "Asia/Tokyo", "ymd"), ("a", "Asia/Tokyo", "ymd"), ("b", None, None)], "collector string, zone_name string, day_order string")
    rows = [(1, "a", "2020-01-01 09:00", "x"), (2, "b", "2020-01-01 09:00", "y"), (3, None, "2020-01-01 09:00", None), (4, "a", None, "z"), (1, "a", "2020-01-01 09:00", "x")]
    # A column of the input is called like one of the clocks'.
    df = spark.createDataFrame(rows, "rec_id long, collector string, value string, zone_name string")
    got = sorted((r.rec_id, r.utc_us, r.zone_name or "") for r in normalise(df, "value", clocks).collect() if r.utc_us is not None)
    assert got == [(1, us(2020, 1, 1), "x"), (1, us(2020, 1, 1), "x"), (2, us(2020, 1, 1, 9), "y"), (3, us(2020, 1, 1, 9), "")]
    assert normalise(df.limit(0), "value", clocks).count() == 0
    assert zone_table(spark, ["Europe/Berlin"]).count() > 100
