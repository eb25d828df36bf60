from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions.entities import host_form, utc_micros
from tracewright.functions.zones import transitions, tz_version, wall_to_utc
from tracewright.operators.timestamps import compile_mask, parse, resolved_notations, with_instant, zone_tables

UTC = timezone.utc


def us(*a: int) -> int:
    return int((datetime(*a, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def one(text, zone=None, month_first=False):
    v, ok = parse([text], [zone], [month_first], {})
    return int(v[0]) if ok[0] else None


CASES = [
    ("2014-10-06T00:03:07.892Z", None, False, us(2014, 10, 6, 0, 3, 7, 892000)),
    ("2014-10-06t00:03:07z", None, False, us(2014, 10, 6, 0, 3, 7)),
    (" 2014-10-06 00:03:24,532Z ", None, False, us(2014, 10, 6, 0, 3, 24, 532000)),
    ("2014-10-06 00:03:11.186", None, False, us(2014, 10, 6, 0, 3, 11, 186000)),
    ("20141006T000319Z", None, False, us(2014, 10, 6, 0, 3, 19)),
    ("20141006T000319", None, False, us(2014, 10, 6, 0, 3, 19)),
    ("2014-10-06T00:03:14.4959722+00:00", None, False, us(2014, 10, 6, 0, 3, 14, 495972)),
    ("2014-10-06 01:08:00.077+0100", None, False, us(2014, 10, 6, 0, 8, 0, 77000)),
    ("2014-10-05T20:06:42-04:00", None, False, us(2014, 10, 6, 0, 6, 42)),
    ("20141006010542.173220+060", None, False, us(2014, 10, 6, 0, 5, 42, 173220)),
    ("20141005200434.958239-240", None, False, us(2014, 10, 6, 0, 4, 34, 958239)),
    ("1412553796", None, False, 1412553796 * 10**6),
    ("1412553864854", None, False, 1412553864854 * 1000),
    ("130570274029917461", None, False, 130570274029917461 // 10 - 11644473600 * 10**6),
    ("Fri, 07 Nov 2014 02:10:16 +0000", None, False, us(2014, 11, 7, 2, 10, 16)),
    ("2014-10-05 20:05:46 EDT", None, False, us(2014, 10, 6, 0, 5, 46)),
    ("2014-10-06 02:03:16 CEST", None, False, us(2014, 10, 6, 0, 3, 16)),
    ("2014-10-08 01:31:22,131 UTC", None, False, us(2014, 10, 8, 1, 31, 22, 131000)),
    ("01.11.2014 02:28:11", "Europe/Berlin", False, us(2014, 11, 1, 1, 28, 11)),
    ("2.11.2014 03.14.34", "Europe/Helsinki", False, us(2014, 11, 2, 1, 14, 34)),
    ("10/11/2014 1:06:53 PM", "America/New_York", True, us(2014, 10, 11, 17, 6, 53)),
    ("10/11/2014 12:06:53 AM", "Europe/London", True, us(2014, 10, 10, 23, 6, 53)),
    ("10/11/2014 13:06:53.250", "Asia/Kolkata", False, us(2014, 11, 10, 7, 36, 53, 250000)),
    ("2014/10/07 03:16:11", "Asia/Tokyo", False, us(2014, 10, 6, 18, 16, 11)),
    ("01-Nov-2014 01:56:17", "Australia/Sydney", False, us(2014, 10, 31, 14, 56, 17)),
    ("26.10.2014 02:30:00", "Europe/Berlin", False, us(2014, 10, 26, 0, 30)),  # occurs twice: the first
    ("30.03.2014 02:30:00", "Europe/Berlin", False, us(2014, 3, 30, 1, 30)),  # never occurs: offset before the jump
    ("01.11.2014 02:28:11", None, False, None),
    ("01.11.2014 02:28:11", "Nowhere/Town", False, None),
    ("2014-13-40T25:61:00Z", None, False, None),
    ("0000-00-00 00:00:00", None, False, None),
    ("2014-02-29 00:00:00", None, False, None),
    ("2014-10-05 20:05:46 QQQ", None, False, None),
    ("pending", None, False, None),
    ("", None, False, None),
    (None, None, False, None),
    ("1" * 70, None, False, None),
    ("7/4/1968 12:00:00 PM", "America/New_York", True, us(1968, 7, 4, 16)),
    ("7/4/2101 12:00:00 PM", "America/New_York", True, us(2101, 7, 4, 16)),
    ("1/4/2101 12:00:00 PM", "America/New_York", True, us(2101, 1, 4, 17)),
    ("7/4/2950 12:00:00 PM", "Europe/Berlin", True, us(2950, 7, 4, 10)),
    ("2014-10-06" + " " * 90 + "00:03:07", None, False, us(2014, 10, 6, 0, 3, 7)),
    ("2014-10-06T00:03:07.123456789012 America/Argentina/ComodRivadavia", None, False, us(2014, 10, 6, 3, 3, 7, 123456)),
    ("x" * 5000, None, False, None),
    ("13/13/2014 00:00:00", "UTC", True, None),
]


@pytest.mark.parametrize("text,zone,month_first,expected", CASES)
def test_notation(text, zone, month_first, expected):
    assert one(text, zone, month_first) == expected


def test_rows_do_not_mix():
    texts = [c[0] for c in CASES] * 3
    v, ok = parse(texts, [c[1] for c in CASES] * 3, [c[2] for c in CASES] * 3, {})
    assert [int(a) if b else None for a, b in zip(v, ok)] == [c[3] for c in CASES] * 3


def test_each_mask_is_compiled_once():
    compile_mask.cache_clear()
    parse([f"2014-10-06 00:00:{i:02d}" for i in range(60)], [None] * 60, [False] * 60, {})
    assert compile_mask.cache_info().misses == 1


@settings(max_examples=200, deadline=None)
@given(st.integers(-4 * 10**9, 4 * 10**10), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Africa/Casablanca", "UTC"]))
def test_wall_times_like_the_zone_library(s, zone):
    wall = (datetime(1970, 1, 1) + timedelta(seconds=s)).replace(tzinfo=ZoneInfo(zone))
    assert int(wall_to_utc(np.array([s]), transitions(zone))[0]) == s - int(wall.utcoffset().total_seconds())


def test_tables_are_versioned(spark):
    t = zone_tables(spark.createDataFrame([("Europe/Berlin",), (None,), ("No/Such",)], "time_zone string"))
    assert t["#version"] == tz_version() and "Europe/Berlin" in t and "No/Such" not in t
    named = "2014-10-06 00:00:00 Asia/Tokyo"
    assert parse([named], [None], [False], t)[1][0]
    with pytest.raises(RuntimeError):
        parse([named], [None], [False], t | {"#version": "other"})


ZONES = [("H1", "Europe/Berlin", "de-DE"), ("h2.corp", "America/New_York", "en-US"), ("h1", "Europe/Berlin", "de-DE"), (None, "UTC", "en-US"), ("h3", None, None)]


def test_operator_keeps_columns_and_names_clashes(spark):
    zones = spark.createDataFrame(ZONES, "computer string, time_zone string, locale string")
    df = spark.createDataFrame([("a", "01.11.2014 02:28:11", "h1.corp ", 1), ("b", "10/11/2014 1:06:53 PM", "H2", 2), ("c", "01.11.2014 02:28:11", None, 3), ("d", None, "h1", 4), ("e", "01.11.2014 02:28:11", "h3", 5)], "id string, t string, __host string, __zone int")
    out = with_instant(df, "t", host_form(F.col("__host")), zones)
    assert out.columns == [*df.columns, "utc_us"]
    assert {r["id"]: r["utc_us"] for r in out.collect()} == {"a": us(2014, 11, 1, 1, 28, 11), "b": us(2014, 10, 11, 17, 6, 53), "c": None, "d": None, "e": None}
    with pytest.raises(ValueError):
        with_instant(out, "t", F.lit(None), zones)


def test_found_over_both_tables(spark):
    zones = spark.createDataFrame(ZONES, "computer string, time_zone string, locale string")
    logs = spark.createDataFrame([("1", "01.11.2014 02:28:11", "H1"), ("1", "01.11.2014 02:28:11", "H1"), ("2", "2014-11-01T00:00:00Z", "H1"), (None, "2014-11-01 00:00:00", None)], "RecordID string, TimeCreated string, Computer string")
    inst = spark.createDataFrame([(1, "1", "01.11.2014 02:28:11"), (2, "9", "01.11.2014 02:28:11"), (3, None, "1412553796"), (3, None, "1412553796"), (4, "2", None)], "instance_id long, event_record_id string, time_created_utc string")
    got = sorted(map(tuple, resolved_notations(logs, inst, zones).collect()), key=str)
    t = us(2014, 11, 1, 1, 28, 11)
    assert got == sorted([("canonical_logs", "1", t), ("canonical_logs", None, us(2014, 11, 1)), ("template_instances", "1", t), ("template_instances", "3", 1412553796 * 10**6)], key=str)
    assert resolved_notations(logs.limit(0), inst.limit(0), zones.limit(0)).count() == 0


def test_utc_by_agreement(spark):
    df = spark.createDataFrame([("2014-10-06T00:03:07.892Z",), ("2014-10-06 00:03:07.892123",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(utc_micros(F.col("t"))).collect()] == [us(2014, 10, 6, 0, 3, 7, 892000), us(2014, 10, 6, 0, 3, 7, 892123), None, None]
