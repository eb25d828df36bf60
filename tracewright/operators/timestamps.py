"""Mixed timestamp notations to one instant (int64 microseconds since 1970, UTC).

A text is reduced to its shape mask (digit -> ``9``, letter -> ``a``, white space ->
blank). Each distinct mask is compiled once, by :func:`compile_mask`, to the places
of its fields; all texts of a mask are then cut and converted together as arrays,
and wall times go through versioned zone transition tables.

Defined results:

* null, blank, unknown shape, impossible fields (month 13, 25 h, day 31 in June): null;
* a text with zone, offset or a count from a fixed epoch means just that;
* year-month-day with dashes or compact, without zone: UTC;
* anything else without zone: wall time of the row's zone, day and month in the order
  of its locale; null if the zone is unknown. A repeated wall time means the first, a
  skipped one is read with the offset before the jump;
* digits finer than a microsecond are cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracewright.functions.entities import host_form
from tracewright.functions.zones import transitions, tz_version, wall_to_utc
from tracewright.session import broadcast_if_small, fresh

#: No notation is longer, white space runs apart; longer texts have no instant.
MAX_CHARS = 96
#: Locales that write the month before the day.
MONTH_FIRST = ("en-us", "en-ph", "es-pa", "es-pr")
#: More host rows than this are joined by shuffle instead of broadcast.
BROADCAST_HOSTS = 200_000
#: More distinct zone names than this cannot be IANA names.
MAX_ZONES = 2_000
ISO_EXACT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$"
# Texts that certainly carry their own zone or are UTC by agreement; all others may need the host.
_OWN_ZONE = r"^(\d{4}-\d|\d{8})|[zZ]$|[+-]\d\d:?\d\d$"

MONTHS = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}
#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_CLOCK = r"(?P<h>9{1,2})(?P<sep>[:.])(?P<mi>99)(?:(?P=sep)(?P<s>99)(?:[.,](?P<f>9{1,12}))?)?(?: (?P<ampm>aa)(?!a))?"
_ZONE = r"(?: ?(?P<off>[+-]99(?::?99)?)| ?(?P<abbr>a{1,5})| (?P<iana>a+/[a_]+(?:/[a_]+)?))?"
#: (shape, whether a text of it without zone is UTC); the first that fits the whole mask counts.
_SHAPES = [
    (r"(?P<y>9999)-(?P<mo>9{1,2})-(?P<d>9{1,2})(?:(?P<t>a)| +)" + _CLOCK + _ZONE, True),
    (r"(?P<y>9999)(?P<mo>99)(?P<d>99)(?:(?P<t>a)| ?)(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,](?P<f>9{1,12}))?(?:(?P<cim>[+-]999)|" + _ZONE + ")", True),
    (r"(?P<y>9999)/(?P<mo>9{1,2})/(?P<d>9{1,2}) +" + _CLOCK + _ZONE, False),
    (r"(?P<d1>9{1,2})(?P<ds>[./-])(?P<d2>9{1,2})(?P=ds)(?P<y>9999),? +" + _CLOCK + _ZONE, False),
    (r"(?:aaa, )?(?P<d>9{1,2})[- ](?P<mon>aaa)[- ](?P<y>9999) +" + _CLOCK + _ZONE, False),
    (r"(?P<mon>aaa) +(?P<d>9{1,2}), (?P<y>9999),? +" + _CLOCK + _ZONE, False),
    (r"aaa (?P<mon>aaa) +(?P<d>9{1,2}) " + _CLOCK + r" (?P<y>9999)", False),
]
_SHAPES = [(re.compile(p), utc) for p, utc in _SHAPES]
#: All-digit texts by length: units a second; FILETIME and tick counts by size.
_EPOCH_UNITS = {10: 1, 13: 1_000, 16: 1_000_000, 19: 1_000_000_000}

# Character classes of the Basic Multilingual Plane: 9, a, blank, or the character itself if ASCII, else ?.
_CLASS = np.full(0x10000, ord("?"), np.uint8)
_CLASS[:128] = np.arange(128)
_CLASS[0] = 0
_CLASS[48:58] = ord("9")
_CLASS[65:91] = _CLASS[97:123] = ord("a")
for _c in (9, 10, 11, 12, 13, 32, 0xA0, 0x2007, 0x2009, 0x202F):
    _CLASS[_c] = 32


@dataclass(frozen=True)
class Layout:
    """Where the fields of a shape mask stand."""

    utc: bool = False
    digits: int = 0
    at: dict = field(default_factory=dict)


@lru_cache(maxsize=65536)
def compile_mask(mask: str) -> Layout | None:
    """Layout of a shape mask, None if no known notation has that shape."""
    if mask and not mask.strip("9") and (len(mask) in _EPOCH_UNITS or len(mask) == 18):
        return Layout(digits=len(mask))
    for shape, utc in _SHAPES:
        if m := shape.fullmatch(mask):
            return Layout(utc=utc, at={k: m.span(k) for k, v in m.groupdict().items() if v is not None and k not in ("sep", "ds")})
    return None


def _codes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row a text (zero-filled), and which texts are usable."""
    stripped = [x.strip() if isinstance(x, str) else "" for x in texts]
    stripped = [x if len(x) <= MAX_CHARS else " ".join(x.split()) for x in stripped]
    ok = np.array([0 < len(x) <= MAX_CHARS and "\0" not in x for x in stripped], bool)
    kept = [x if k else "" for x, k in zip(stripped, ok)]
    width = max(1, *map(len, kept)) if kept else 1  # as wide as the longest text of the batch
    return np.array(kept, dtype=f"U{width}").view(np.uint32).reshape(len(kept), width), ok


def _masks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    classes = np.where(codes < 0x10000, _CLASS[np.minimum(codes, 0xFFFF)], ord("?")).astype(np.uint8)
    return np.unique(np.ascontiguousarray(classes).view(f"S{classes.shape[1]}").ravel(), return_inverse=True)


def _number(codes: np.ndarray, a: int, b: int) -> np.ndarray:
    out = np.zeros(len(codes), np.int64)
    for i in range(a, b):
        out = out * 10 + (codes[:, i].astype(np.int64) - 48)
    return out


def _word(codes: np.ndarray, a: int, b: int) -> list[str]:
    return [x.upper() for x in np.ascontiguousarray(codes[:, a:b]).view(f"U{b - a}").ravel().tolist()]


def _days(y: np.ndarray, mo: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (y >= 1) & (y <= 9999) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= 31)
    months = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, mo, 1) - 1
    first = months.astype("M8[M]").astype("M8[D]").astype(np.int64)
    after = (months + 1).astype("M8[M]").astype("M8[D]").astype(np.int64)
    days = first + np.where(ok, d, 1) - 1
    return days, ok & (days < after)


def _epoch(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    v = _number(codes, 0, n)
    if n == 18:  # 100 ns since 1601 or, from 5e17 on, since the year 1
        us = np.where(v < 500_000_000_000_000_000, v // 10 - 11_644_473_600_000_000, v // 10 - 62_135_596_800_000_000)
    elif n == 19:
        us = v // 1000
    else:
        us = v * (1_000_000 // _EPOCH_UNITS[n])
    return us, np.ones(len(v), bool)


def parse(texts: Iterable[str | None], zones: Iterable[str | None], month_first: Iterable[bool | None], tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, resolved) of each text; ``tables``: zone name -> transition arrays."""
    codes, usable = _codes(texts)
    zones, month_first = np.asarray(list(zones), object), np.array([x is True or x == 1 for x in month_first], bool)
    out, done = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    masks, which = _masks(codes)
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(len(masks) + 1))
    for k, raw in enumerate(masks):
        rows = order[bounds[k] : bounds[k + 1]]
        rows = rows[usable[rows]]
        layout = compile_mask(raw.decode("ascii"))
        if layout is None or not len(rows):
            continue
        c = codes[rows]
        if layout.digits:
            out[rows], done[rows] = _epoch(c, layout.digits)
            continue
        at = layout.at
        num = {f: _number(c, *at[f]) for f in ("y", "mo", "d", "d1", "d2", "h", "mi", "s") if f in at}
        ok = np.ones(len(rows), bool)
        if "t" in at:
            ok &= np.isin(c[:, at["t"][0]], (84, 116))
        if "mon" in at:
            num["mo"] = np.array([MONTHS.get(x, 0) for x in _word(c, *at["mon"])], np.int64)
        if "d1" in at:
            first = month_first[rows]
            num["mo"], num["d"] = np.where(first, num["d1"], num["d2"]), np.where(first, num["d2"], num["d1"])
        h, s = num["h"], num.get("s", np.zeros(len(rows), np.int64))
        if "ampm" in at:
            half = _word(c, *at["ampm"])
            pm = np.array([x == "PM" for x in half], bool)
            ok &= np.array([x in ("AM", "PM") for x in half], bool) & (h >= 1) & (h <= 12)
            h = h % 12 + 12 * pm
        days, real = _days(num["y"], num["mo"], num["d"])
        ok &= real & (h <= 23) & (num["mi"] <= 59) & (s <= 59)
        seconds = days * 86400 + h * 3600 + num["mi"] * 60 + s
        micros = np.zeros(len(rows), np.int64)
        if "f" in at:
            a, b = at["f"]
            n = min(b - a, 6)
            micros = _number(c, a, a + n) * 10 ** (6 - n)
        if "cim" in at or "off" in at:
            a, b = at["cim"] if "cim" in at else at["off"]
            sign = np.where(c[:, a] == 45, -1, 1)
            if "cim" in at:
                shift = _number(c, a + 1, b)
            else:
                mm = _number(c, b - 2, b) if b - a > 3 else 0
                shift = _number(c, a + 1, a + 3) * 60 + mm
                ok &= mm <= 59
            ok &= shift <= 18 * 60
            seconds = seconds - sign * shift * 60
        elif "abbr" in at:
            shift = [ABBREVIATIONS.get(x) for x in _word(c, *at["abbr"])]
            ok &= np.array([x is not None for x in shift], bool)
            seconds = seconds - np.array([x or 0 for x in shift], np.int64) * 60
        elif "iana" in at or not layout.utc:
            named = np.ascontiguousarray(c[:, slice(*at["iana"])]).view(f"U{at['iana'][1] - at['iana'][0]}").ravel().astype(object) if "iana" in at else zones[rows]
            seconds, known = _from_walls(seconds, named, tables)
            ok &= known
        out[rows], done[rows] = seconds * 1_000_000 + micros, ok
    return out, done


def _from_walls(seconds: np.ndarray, zones: np.ndarray, tables: dict) -> tuple[np.ndarray, np.ndarray]:
    known, out = np.zeros(len(seconds), bool), seconds.copy()
    for z in {z for z in zones if isinstance(z, str)}:
        table = tables.get(z)
        if table is None:  # named in a text and in no row of the zone table
            if tables.get("#version", tz_version()) != tz_version():
                raise RuntimeError(f"zone data {tz_version()} here, {tables['#version']} on the driver")
            table = transitions(z)
        if table is not None:
            rows = np.flatnonzero(zones == z)
            out[rows], known[rows] = wall_to_utc(seconds[rows], table), True
    return out, known


def zone_tables(zones: DataFrame, zone: str = "time_zone") -> dict:
    """Transition tables of all zones named in ``zones``; under the key ``#version`` the version of the zone data, which the tasks' own must be.

    The number of distinct zone names is bounded by the zone data base itself; more than
    ``MAX_ZONES`` names mean that the column holds something else.
    """
    names = [r[0] for r in zones.select(zone).where(F.col(zone).isNotNull()).distinct().limit(MAX_ZONES + 1).collect()]
    if len(names) > MAX_ZONES:
        raise ValueError(f"{zone} holds more than {MAX_ZONES} distinct names")
    return {"#version": tz_version()} | {n: t for n in names if (t := transitions(n)) is not None}


def instant(text: Column, zone: Column, locale: Column, tables: dict) -> Column:
    """int64 microseconds of ``text``; null where it has no instant."""

    @pandas_udf("long")
    def convert(t: pd.Series, z: pd.Series, m: pd.Series) -> pd.Series:
        us, ok = parse(t.tolist(), z.tolist(), m.tolist(), tables)
        return pd.Series(us, dtype="Int64").mask(~ok)

    return convert(text, zone, F.coalesce(F.lower(F.trim(locale)).isin(*MONTH_FIRST), F.lit(False)))


def host_zone_lookup(zones: DataFrame) -> DataFrame:
    """One row a host (normal form): ``__host, __zone, __locale``; of contradicting rows the smallest."""
    return (
        zones.select(host_form(F.col("computer")).alias("__host"), F.struct(F.col("time_zone").alias("z"), F.col("locale").alias("l")).alias("s"))
        .where(F.col("__host").isNotNull() & F.col("s.z").isNotNull())
        .groupBy("__host")
        .agg(F.min("s").alias("s"))
        .select("__host", F.col("s.z").alias("__zone"), F.col("s.l").alias("__locale"))
    )


def with_instant(df: DataFrame, text: str, host: Column, zones: DataFrame, out: str = "utc_us") -> DataFrame:
    """``df`` plus ``out``; ``host`` gives the row's host in normal form (null: unknown).

    All columns of ``df`` are kept; a column of the name ``out`` is a clash that the caller must resolve.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} is there already")
    key, zone, locale = (fresh(df.columns, n) for n in ("__h", "__z", "__l"))
    lookup = broadcast_if_small(host_zone_lookup(zones), BROADCAST_HOSTS).toDF(key, zone, locale)
    joined = df.withColumn(key, host).join(lookup, key, "left")
    return joined.withColumn(out, instant(F.col(text), F.col(zone), F.col(locale), zone_tables(zones))).select(*[F.col(f"`{c}`") for c in df.columns], out)


def needs_host(text: Column) -> Column:
    """False only if the text certainly has its own zone or is UTC by agreement."""
    return ~F.coalesce(F.trim(text).rlike(_OWN_ZONE), F.lit(True))


def resolved_notations(logs: DataFrame, instances: DataFrame, zones: DataFrame) -> DataFrame:
    """(table_name, row_key, utc_us) of each row of either table whose text is not in the exact ISO form and has an instant.

    Exact copies count once. Instances reach their host through the record they name; only
    those whose text may need it take part in the join, the others spread over all tasks.
    """
    odd = lambda c: c.isNotNull() & (F.trim(c) != "") & ~c.rlike(ISO_EXACT)
    a = logs.where(odd(F.col("TimeCreated"))).select(F.lit("canonical_logs").alias("table_name"), F.col("RecordID").alias("row_key"), F.col("TimeCreated").alias("text"), host_form(F.col("Computer")).alias("host"))
    record = logs.select(F.col("RecordID").alias("__record"), host_form(F.col("Computer")).alias("host")).where("host is not null and __record is not null").groupBy("__record").agg(F.min("host").alias("host"))
    t = instances.where(odd(F.col("time_created_utc"))).select(F.col("instance_id").cast("string").alias("row_key"), F.col("time_created_utc").alias("text"), F.col("event_record_id"))
    t = t.withColumn("__record", F.when(needs_host(F.col("text")) & F.col("event_record_id").isNotNull(), F.col("event_record_id")).otherwise(F.concat(F.lit("\0"), F.coalesce("row_key", F.lit("")), F.coalesce("text", F.lit("")))))
    b = t.join(record, "__record", "left").select(F.lit("template_instances").alias("table_name"), "row_key", "text", "host")
    return with_instant(a.unionByName(b).distinct(), "text", F.col("host"), zones).where("utc_us is not null").select("table_name", "row_key", "utc_us").distinct()
