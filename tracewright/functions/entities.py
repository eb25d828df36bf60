"""Normal forms shared by the entity and record operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that name no entity.
NO_ENTITY = [
    "0x0", "0x3e7", "0", "999", "0x0:0x0", "127.0.0.1", "::1", "-", "0.0.0.0",
    "localhost", "none", "null", "nan", "00000000-0000-0000-0000-000000000000",
]
# The names of the Sysmon channel after normalisation.
SYSMON = ["microsoft-windows-sysmon/operational", "sysmon"]

_BLANK = r"^[\s ]+|[\s ]+$"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.regexp_replace(c, _BLANK, "")


def entity_form(c: Column) -> Column:
    """Trimmed, lower case, without one pair of enclosing braces."""
    t = F.lower(F.trim(c))
    t = F.when(F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")), F.trim(F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))))).otherwise(t)
    return t


def is_entity(normal: Column) -> Column:
    """False for null, blank and placeholder values (``normal`` as from :func:`entity_form`)."""
    return F.coalesce((normal != "") & ~normal.isin(NO_ENTITY), F.lit(False))


def host_form(c: Column) -> Column:
    """First label of a computer name, trimmed and lower-cased; null if nothing is left."""
    return F.nullif(F.lower(F.trim(F.substring_index(F.trim(c), ".", 1))), F.lit(""))


def integer_form(c: Column) -> Column:
    """Integer behind spellings such as ``' 4624'``, ``'4624.0'`` or ``'0x1210'``; null if there is none."""
    t = F.regexp_replace(F.trim(c), r"\.0*$", "")
    return F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).try_cast("bigint")).otherwise(t.try_cast("bigint"))


def utc_micros(c: Column) -> Column:
    """Microseconds since 1970 of a text that is UTC by agreement, with or without ``T`` and ``Z``; finer digits are cut off, null if unreadable."""
    t = F.translate(F.trim(c), "tz", "TZ")
    # Read with Z and not as an offset: the cast knows it without looking up a zone.
    return F.unix_micros(F.when(F.endswith(t, F.lit("Z")), t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp"))
