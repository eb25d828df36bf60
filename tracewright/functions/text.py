"""Text expressions: null words, trimming, masks, identifiers and display forms."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.schema import EVENT_DESCRIPTIONS, EVENT_FAMILIES, MASKS, NULL_WORDS, NULL_WORDS_WIDE


def is_nullish(c: Column, wide: bool = True) -> Column:
    """Null, blank or a word that stands for no value."""
    return c.isNull() | F.lower(F.trim(c)).isin(*(NULL_WORDS_WIDE if wide else ["", *NULL_WORDS]))


def or_null(c: Column) -> Column:
    """The trimmed text, null if :func:`is_nullish`."""
    return F.when(~is_nullish(c), F.trim(c))


def strip_dot0(c: Column) -> Column:
    """``672.0`` -> ``672``."""
    return F.regexp_replace(F.trim(c), r"\.0$", "")


def capitalize(c: Column) -> Column:
    """First character upper case, all others lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def collapse(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def shorten(c: Column, n: int, mark: str = "...") -> Column:
    """At most n characters, with a mark if something was cut off."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def mask(c: Column) -> Column:
    """Variable parts (hex codes, addresses, SIDs, GUIDs, paths, times) replaced by their names."""
    return reduce(lambda x, m: F.regexp_replace(x, m[0], m[1]), MASKS, c)


def signature(c: Column) -> Column:
    """Masked text in which further tokens with figures are wild cards."""
    return F.regexp_replace(mask(collapse(c)), r"(?<!\S)[^\s<>]*\d[^\s<>]*(?!\S)", "<*>")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*pairs.items())])


def family_label(event_id: Column, source: Column | None = None) -> Column:
    """``Event 4625: Failed Logon``; without a family name ``Security Event 9`` or ``Event 9``."""
    e = F.trim(event_id)
    known = F.element_at(literal_map(EVENT_FAMILIES), e)
    plain = F.concat(F.lit("Event "), e)
    other = plain if source is None else F.when(F.coalesce(source, F.lit("")) != "", F.concat(source, F.lit(" "), plain)).otherwise(plain)
    return F.when(known.isNotNull(), F.concat(plain, F.lit(": "), known)).otherwise(other)


def description(event_id: Column) -> Column:
    """One-line description of an event id, null if there is none."""
    return F.element_at(literal_map(EVENT_DESCRIPTIONS), strip_dot0(event_id))


# Fixed value: the DNS name space of UUID version 5.
_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(seed: Column) -> Column:
    """Version 5 UUID of a text in the DNS name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), F.encode(seed, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def delta_text(seconds: Column) -> Column:
    """``+14s``, ``-2m 5s``, ``+3h 0m``; fractions are cut off."""
    n = F.floor(F.abs(seconds)).cast("long")
    text = (
        F.when(n < 60, F.concat(n.cast("string"), F.lit("s")))
        .when(n < 3600, F.concat(F.floor(n / 60).cast("string"), F.lit("m "), (n % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(n / 3600).cast("string"), F.lit("h "), F.floor((n % 3600) / 60).cast("string"), F.lit("m")))
    )
    return F.concat(F.when(seconds >= 0, F.lit("+")).otherwise(F.lit("-")), text)


def duration_text(seconds: Column) -> Column:
    """Length of a span: ``42s``, ``3m 5s``, ``2h 10m`` or ``4d 6h``."""
    n = seconds.cast("long")

    def two(big: int, a: str, small: int, b: str) -> Column:
        return F.concat(F.floor(n / big).cast("string"), F.lit(a + " "), F.floor((n % big) / small).cast("string"), F.lit(b))

    return F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).when(n < 3600, two(60, "m", 1, "s")).when(n < 86400, two(3600, "h", 60, "m")).otherwise(two(86400, "d", 3600, "h"))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, one at least, 0 for empty or null text."""
    n = F.length(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def token_count(c: Column, encode) -> Column:
    """Tokens by any ``encode(text) -> sequence`` that can be sent to the executors; 0 for null or empty text."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def count(t: pd.Series) -> pd.Series:
        return pd.Series([len(encode(x)) if x else 0 for x in t], dtype="int32")

    return count(c)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def basename(c: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.element_at(F.split(c, r"[\\/]"), -1)


def cell(c: Column) -> Column:
    """Text for a table cell: line breaks to blanks, bars escaped."""
    return F.replace(F.regexp_replace(c, r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))


def utc_second(ts: Column) -> Column:
    """``2026-09-14T08:00:10Z`` of a timestamp, whatever the session's zone."""
    n = F.floor(F.unix_micros(ts) / 1_000_000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    of_day = F.pmod(n, F.lit(86400))
    day = F.date_from_unix_date(F.floor(n / 86400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), two(F.floor(of_day / 3600)), F.lit(":"), two(F.floor(of_day / 60) % 60), F.lit(":"), two(of_day % 60), F.lit("Z"))


def display_time(ts: Column) -> Column:
    """``9/14/26, 8:00:10 AM``."""
    return F.date_format(ts, "M/d/yy, h:mm:ss a")


def sequence_text(c: Column, width: int = 4) -> Column:
    return F.lpad(c.cast("string"), width, "0")
