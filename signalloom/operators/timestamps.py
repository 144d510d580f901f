"""Mixed timestamp formats and zones -> one UTC instant (microseconds).

Each value is reduced to a *shape mask* (digits -> ``9``, letters -> ``a``, the
rest as it is).  A distinct mask is compiled to a field layout once; because a
mask fixes the offset of every field, all values sharing it are then converted
together with numpy slices.  Local times go through zone transition tables that
carry the version of the zone database they were made from.

Defined results (see tests/test_timestamps.py):
* null, empty, placeholders, impossible dates, values without a day -> null;
* a bare date is 00:00 UTC; a time without zone is local to the given zone,
  or UTC where the zone is null or unknown;
* a local time that occurs twice is the first one; one that is skipped is read
  with the offset in force before the change;
* numeric day/month order follows ``day_order`` (mdy, else day first);
* values over ``MAX_LEN`` characters hold no timestamp -> null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LEN = 64
NONE = np.iinfo(np.int64).min
DAY_US = 86_400_000_000

# Month names and their abbreviations, English, German, French, Spanish.
MONTHS = {
    1: "jan january januar janvier janv enero ene jänner",
    2: "feb february februar février févr fév febrero",
    3: "mar march märz mrz mars marzo",
    4: "apr april avril avr abril abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet juil julio",
    8: "aug august août agosto ago",
    9: "sep sept september septembre septiembre",
    10: "oct october oktober okt octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dezember dez décembre déc diciembre dic",
}
# Zone abbreviations whose offset does not depend on the collector, in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "CST": -360, "CDT": -300, "EST": -300, "EDT": -240, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "AWST": 480, "NZST": 720, "NZDT": 780,
}
MONTH_NO = {w: n for n, words in MONTHS.items() for w in words.split()}

_ZONE = r"(?: ?(?P<off>[+\-−]99(?::?99)?)| ?(?P<zn>a+(?:[/_\-+]a+)*))?"
_TIME = r"(?:(?P<sep>a|,? )(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?(?: ?(?P<ap>aa(?![a/_])))?" + _ZONE + ")?"
_FORMS = [
    r"(?P<y>9999)(?P<p>[-/.])(?P<m>9{1,2})(?P=p)(?P<d>9{1,2})" + _TIME,
    r"(?P<n1>9{1,2})(?P<p>[-/.])(?P<n2>9{1,2})(?P=p)(?P<y>9999)" + _TIME,
    r"(?P<y>9999)(?P<m>99)(?P<d>99)" + _TIME,
    r"(?P<y>9999)(?P<m>99)(?P<d>99)(?P<sep>a| )(?P<H>99)(?P<M>99)(?P<S>99)?(?:[.,](?P<f>9{1,9}))?" + _ZONE,
    r"(?:a{2,}\.?,? )?(?P<d>9{1,2})(?:aa|\.)?[ -](?P<mon>a{3,})\.?,?[ -](?P<y>9999)" + _TIME,
    r"(?P<d>9{1,2})-(?P<mon>aaa)-(?P<yy>99)" + _TIME,
    r"(?P<y>9999)[- ](?P<mon>a{3,})[- ](?P<d>9{1,2})" + _TIME,
    r"(?:a{2,}\.?,? )?(?P<mon>a{3,})\.? (?P<d>9{1,2})(?:aa)?,? (?P<y>9999)" + _TIME,
    r"(?P<iy>9999)-?(?P<w>a)(?P<iw>99)-?(?P<iwd>9)" + _TIME,
    r"(?P<y>9999)-(?P<doy>999)" + _TIME,
    r"(?P<sec>9{9,10})(?:\.(?P<f>9{1,9}))?",
    r"(?P<ms>9{12,13})",
    r"(?P<us>9{15,16})",
]
_FORMS_RE = [re.compile(f) for f in _FORMS]


@lru_cache(maxsize=8192)
def layout(mask: str) -> dict[str, tuple[int, int]] | None:
    """The fields of a shape mask as (start, end), or None if it names no day."""
    for form in _FORMS_RE:
        if m := form.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None and k != "p"}
    return None


@lru_cache(maxsize=1)
def zone_version() -> str:
    """Version of the zone database in use."""
    try:
        with open("/usr/share/zoneinfo/tzdata.zi") as f:
            return f.readline().split()[-1]
    except OSError:
        try:
            import tzdata

            return tzdata.IANA_VERSION
        except ImportError:
            return "unknown"


@lru_cache(maxsize=1024)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray, dict[str, int]] | None:
    """(UTC second of each change, offsets in seconds with one more element, offset of each abbreviation); None for an unknown zone."""
    from zoneinfo import ZoneInfo

    try:
        z = ZoneInfo(zone)
    except Exception:  # noqa: BLE001 - any malformed key is an unknown zone
        return None

    def at(s: int) -> tuple[int, str]:
        t = datetime.fromtimestamp(s, timezone.utc).astimezone(z)
        return int(t.utcoffset().total_seconds()), t.tzname()

    step, first, last = 7 * 86_400, -631_152_000, 4_102_444_800  # 1950 to 2100
    names: dict[str, int] = {}
    when, offs, prev = [], [at(first)[0]], at(first)
    for s in range(first + step, last, step):
        now = at(s)
        if now[0] != prev[0]:
            lo, hi = s - step, s
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid)[0] == prev[0] else (lo, mid)
            when.append(hi)
            offs.append(now[0])
        if s > 0:
            names[now[1]] = now[0]
        prev = now
    return np.array(when, np.int64), np.array(offs, np.int64), names


def to_utc(local_us: np.ndarray, zone: str | None) -> np.ndarray:
    """Local wall time in microseconds -> UTC; the first of two, UTC where the zone is unknown."""
    table = transitions(zone) if zone else None
    if table is None:
        return local_us
    when, offs, _ = table
    limit = (when + np.maximum(offs[:-1], offs[1:])) * 1_000_000
    return local_us - offs[np.searchsorted(limit, local_us, side="right")] * 1_000_000


def zone_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    """The transition tables of some zones: zone, version, utc_from (seconds; null for the first), offset_s."""
    rows = []
    for zone in zones:
        if (t := transitions(zone)) is not None:
            rows += [(zone, zone_version(), None if i == 0 else int(t[0][i - 1]), int(o)) for i, o in enumerate(t[1])]
    return spark.createDataFrame(rows, "zone string, version string, utc_from long, offset_s int")


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of valid dates; NONE for impossible ones."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)
    mm = np.where(ok, m, 1)
    start = ((np.where(ok, y, 1970) - 1970) * 12 + mm - 1).astype("datetime64[M]")
    length = ((start + 1).astype("datetime64[D]") - start.astype("datetime64[D]")).astype(np.int64)
    return np.where(ok & (d <= length), start.astype("datetime64[D]").astype(np.int64) + d - 1, NONE)


def _words(sub: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, list[str]]:
    """Codes and the distinct texts of one field."""
    w = np.ascontiguousarray(sub[:, span[0] : span[1]]).view(f"U{span[1] - span[0]}").ravel()
    distinct, codes = np.unique(w, return_inverse=True)
    return codes, [str(x) for x in distinct]


def _convert(sub: np.ndarray, at: dict[str, tuple[int, int]], zone: np.ndarray, mdy: np.ndarray) -> np.ndarray:
    n = len(sub)
    bad = np.zeros(n, bool)

    def num(k: str, default: int = 0) -> np.ndarray:
        if k not in at:
            return np.full(n, default, np.int64)
        out = np.zeros(n, np.int64)
        for c in range(*at[k]):
            out = out * 10 + (sub[:, c].astype(np.int64) - 48)
        return out

    def micros() -> np.ndarray:
        if "f" not in at:
            return np.zeros(n, np.int64)
        width = at["f"][1] - at["f"][0]
        return num("f") * 10 ** (6 - width) if width <= 6 else num("f") // 10 ** (width - 6)

    for k, scale in (("sec", 1_000_000), ("ms", 1000), ("us", 1)):
        if k in at:
            return num(k) * scale + micros()
    if "iy" in at:
        codes, distinct = _words(sub, at["w"])
        bad |= ~np.array([w in "Ww" for w in distinct])[codes]
        y, w, wd = num("iy"), num("iw"), num("iwd")
        jan4 = _days(y, np.full(n, 1), np.full(n, 4))
        week1 = jan4 - (jan4 + 3) % 7
        nxt = _days(y + 1, np.full(n, 1), np.full(n, 4))
        weeks = (nxt - (nxt + 3) % 7 - week1) // 7
        bad |= (y < 1) | (w < 1) | (w > weeks) | (wd < 1) | (wd > 7)
        days = week1 + (w - 1) * 7 + wd - 1
    elif "doy" in at:
        y, doy = num("y"), num("doy")
        first, nxt = (_days(y + k, np.full(n, 1), np.full(n, 1)) for k in (0, 1))
        bad |= (y < 1) | (doy < 1) | (doy > nxt - first)
        days = first + doy - 1
    else:
        if "mon" in at:
            codes, distinct = _words(sub, at["mon"])
            m = np.array([MONTH_NO.get(w.lower(), 0) for w in distinct], np.int64)[codes]
        elif "n1" in at:
            m = np.where(mdy, num("n1"), num("n2"))
        else:
            m = num("m")
        d = np.where(mdy, num("n2"), num("n1")) if "n1" in at else num("d")
        y = num("yy") if "yy" in at else num("y")
        if "yy" in at:
            y = np.where(y < 69, 2000 + y, 1900 + y)
        days = _days(y, m, d)
    bad |= days == NONE
    days = np.where(bad, 0, days)
    if "H" not in at:
        return np.where(bad, NONE, days * DAY_US)

    H, M, S, f = num("H"), num("M"), num("S"), micros()
    if at["sep"][1] - at["sep"][0] == 1:
        codes, distinct = _words(sub, at["sep"])
        bad |= ~np.array([w in " Tt" for w in distinct])[codes]
    zn = "zn" in at and _words(sub, at["zn"])
    if "ap" in at:
        codes, distinct = _words(sub, at["ap"])
        kind = np.array([{"AM": 1, "PM": 2}.get(w.upper(), 0) for w in distinct])[codes]
        if zn or "off" in at:
            bad |= kind == 0
        elif (kind == 0).all():
            zn, kind = (codes, distinct), None
        else:
            bad |= kind == 0
        if kind is not None:
            bad |= (H < 1) | (H > 12)
            H = H % 12 + np.where(kind == 2, 12, 0)
    bad |= (H > 24) | (M > 59) | (S > 60) | ((H == 24) & ((M > 0) | (S > 0) | (f > 0)))
    local = days * DAY_US + ((H * 60 + M) * 60 + S) * 1_000_000 + f
    if "off" in at:
        a, b = at["off"]
        digits = [c for c in range(a + 1, b) if c != a + 3 or b - a != 6]
        v = [sub[:, c].astype(np.int64) - 48 for c in digits]
        hh, mi = v[0] * 10 + v[1], (v[2] * 10 + v[3]) if len(v) == 4 else np.zeros(n, np.int64)
        bad |= (hh > 18) | (mi > 59)
        sign = np.where(sub[:, a] == ord("+"), 1, -1)
        utc = local - sign * (hh * 60 + mi) * 60_000_000
    else:
        utc = np.empty(n, np.int64)
        codes, distinct = zn if zn else (np.zeros(n, np.int64), [""])
        zcode, zones = pd.factorize(zone, use_na_sentinel=False)
        for i, z in enumerate(zones):
            home = None if pd.isna(z) else str(z)
            for j, name in enumerate(distinct):
                at_ij = (zcode == i) & (codes == j)
                if not at_ij.any():
                    continue
                if not name:
                    utc[at_ij] = to_utc(local[at_ij], home)
                    continue
                own = transitions(home) if home else None
                fixed = own[2].get(name) if own else None
                if fixed is None and (known := ABBREVIATIONS.get(name.upper())) is not None:
                    fixed = known * 60
                if fixed is not None:
                    utc[at_ij] = local[at_ij] - fixed * 1_000_000
                elif transitions(name) is not None:
                    utc[at_ij] = to_utc(local[at_ij], name)
                else:
                    bad[at_ij] = True
    return np.where(bad, NONE, utc)


def parse(values: pd.Series, zone: pd.Series, day_order: pd.Series) -> pd.Series:
    """UTC microseconds of a batch of values, null where they name no instant."""
    n = len(values)
    out = np.full(n, NONE, np.int64)
    text = values.fillna("").astype(str).str.strip()
    use = np.flatnonzero(((text != "") & (text.str.len() <= MAX_LEN)).to_numpy())
    if len(use):
        arr = text.to_numpy()[use].astype(str)
        chars = np.ascontiguousarray(arr).view(np.uint32).reshape(len(arr), -1)
        distinct, inv = np.unique(chars, return_inverse=True)
        classes = np.array([57 if c < 128 and chr(c).isdigit() else 97 if c and chr(c).isalpha() else c for c in distinct], np.uint32)
        masks = np.ascontiguousarray(classes[inv.reshape(chars.shape)]).view(arr.dtype).ravel()
        each, codes = np.unique(masks, return_inverse=True)
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(each) + 1))
        zones, mdy = zone.to_numpy()[use], (day_order.fillna("").to_numpy() == "mdy")[use]
        for k, mask in enumerate(each):
            if (at := layout(str(mask))) is not None:
                rows = order[bounds[k] : bounds[k + 1]]
                out[use[rows]] = _convert(chars[rows], at, zones[rows], mdy[rows])
    return pd.Series(pd.array(np.where(out == NONE, 0, out), dtype="Int64")).mask(out == NONE)


def utc_micros(value: Column, zone: Column, day_order: Column) -> Column:
    """Column of UTC microseconds for a column of timestamps as received.

    All rows are converted through one version of the zone tables, the driver's; an
    executor that has another one fails instead of giving other instants.
    """
    version = zone_version()

    @F.pandas_udf(T.LongType())
    def convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if zone_version() != version:
            raise RuntimeError(f"zone tables of version {zone_version()} here, {version} at the driver")
        for v, z, o in batches:
            yield parse(v, z, o)

    return convert(value, zone, day_order)


def normalise(df: DataFrame, value: str, clocks: DataFrame, key: str = "collector", out: str = "utc_us") -> DataFrame:
    """Add ``out`` to every row of ``df``; clocks: one row per ``key`` with zone_name and day_order.

    The clocks are a small fixed table (one row per collector); they are
    broadcast only by the optimiser, which checks their size.
    """
    c = clocks.dropDuplicates([key]).select(F.col(key).alias("_ck"), F.col("zone_name").alias("_cz"), F.col("day_order").alias("_co"))
    joined = df.join(c, df[key] == F.col("_ck"), "left")
    return joined.withColumn(out, utc_micros(df[value], F.col("_cz"), F.col("_co"))).drop("_ck", "_cz", "_co")
