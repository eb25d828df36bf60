"""Versioned zone transition tables, built once on the driver and shipped as plain arrays."""

from __future__ import annotations

from calendar import isleap
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np

#: Tables span these years. Before the first of them zones have one offset; beyond the last a year is read as an
#: earlier one that begins on the same weekday and is as long, as all rules are by then the same from year to year.
FIRST_YEAR, LAST_YEAR = 1840, 2128
#: The first year that may stand for later ones.
CYCLE_YEAR = 2088


def tz_version() -> str:
    """Version of the zone data behind the tables, or ``system`` if it names none."""
    try:
        import tzdata

        return str(tzdata.IANA_VERSION)
    except ImportError:
        return "system"


@lru_cache(maxsize=1024)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants, offsets) in seconds: ``offsets[i]`` holds from ``instants[i-1]`` to ``instants[i]``; None for an unknown zone."""
    try:
        z = ZoneInfo(zone)
    except Exception:  # noqa: BLE001 - a name may be malformed in many ways
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def off(s: int) -> int:
        return int((epoch + timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())

    lo = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    hi = int((datetime(LAST_YEAR, 1, 8, tzinfo=timezone.utc) - epoch).total_seconds())
    step, at, offs = 7 * 86400, [], [off(lo)]
    for a in range(lo, hi, step):
        b, before, after = a + step, offs[-1], off(a + step)
        if before == after:
            continue
        while b - a > 1:
            m = (a + b) // 2
            if off(m) == before:
                a = m
            else:
                b = m
        at.append(b)
        offs.append(after)
    return np.array(at, np.int64), np.array(offs, np.int64)


@lru_cache(maxsize=1)
def _stand_in() -> dict[tuple[int, bool], int]:
    """(weekday of January 1, leap) -> a year of the tables."""
    return {(date(y, 1, 1).weekday(), isleap(y)): y for y in range(LAST_YEAR - 1, CYCLE_YEAR - 1, -1)}


def _brought_back(wall: np.ndarray) -> np.ndarray:
    """Seconds to take off wall times beyond the tables to land in the year that stands for theirs."""
    shift = np.zeros(len(wall), np.int64)
    far = np.flatnonzero(wall >= _LAST)
    if len(far):
        years = wall[far].astype("M8[s]").astype("M8[Y]").astype(np.int64) + 1970
        for y in np.unique(years).tolist():
            first = (np.datetime64(f"{y:04d}-01-01", "D") - np.datetime64("1970-01-01", "D")).astype(int)
            own = _stand_in()[(int(first) + 3) % 7, isleap(y)]
            shift[far[years == y]] = (int(first) - (date(own, 1, 1) - date(1970, 1, 1)).days) * 86400
    return shift


#: Wall times from here on lie beyond the tables, whatever the zone.
_LAST = (date(LAST_YEAR, 1, 1) - date(1970, 1, 1)).days * 86400


def wall_to_utc(wall: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Seconds of wall time to UTC seconds.

    A wall time that occurs twice means the first; one that never occurs is read
    with the offset before the jump.
    """
    at, offs = table
    shift = _brought_back(wall)
    near = wall - shift
    # Wall time at which the offset before each transition stops being the reading: the later
    # of both local readings of the transition, so that repeated hours stay with the first.
    until = at + np.maximum(offs[:-1], offs[1:])
    return wall - offs[np.searchsorted(until, near, side="right")]
