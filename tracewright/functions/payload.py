"""Values inside JSON payloads; text that is not JSON gives null, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import collapse, is_nullish
from tracewright.schema import PAYLOAD_KEYS


def parsed(payload: Column) -> Column:
    """The payload as a variant; null unless all of it is valid JSON. Where many members are read, keep this in a column of its own."""
    return F.try_parse_json(payload)


def member(variant: Column, key: str) -> Column:
    """Text of a top-level member of a parsed payload."""
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(variant, f"$['{quoted}']", "string")


def field(payload: Column, key: str) -> Column:
    """Text of a top-level member; null unless the whole payload is valid JSON (a cut-off payload has no members)."""
    return member(parsed(payload), key)


def keys_of(name: str, event_id: str | None = None) -> list[str]:
    """Payload keys of a logical field, those of the event id if it has its own; an unknown field is its own key."""
    known = PAYLOAD_KEYS.get(name.lower().replace(" ", "_").replace("-", "_"))
    if known is None:
        return [name]
    return known.get((event_id or "").strip(), known[""])


def equals(payload: Column, name: str, value: str, event_id: str | None = None) -> Column:
    """Any key of the field holds ``value``, whatever the case; false for null and for text that is no JSON."""
    wanted = F.lit(value.strip().lower())
    # A payload can hold the value only if its text does, or if something in it is escaped: most are never parsed.
    may = F.coalesce(F.contains(F.lower(payload), wanted) | F.contains(payload, F.lit("\\")), F.lit(False))
    return may & reduce(lambda a, b: a | b, [F.coalesce(F.lower(field(payload, k)) == wanted, F.lit(False)) for k in keys_of(name, event_id)])


def as_map(payload: Column) -> Column:
    """Payload as a map: an object's members, a list as Data1..n, other text as Data1; null if there is nothing."""
    t = F.when(parsed(payload).isNotNull() | ~F.trim(payload).rlike(r"^[\[{]"), F.trim(payload))  # null: looks like JSON, but is none
    listed = F.from_json(t, "array<string>")
    numbered = F.map_from_arrays(F.transform(listed, lambda _, i: F.concat(F.lit("Data"), (i + 1).cast("string"))), listed)
    whole = F.create_map(F.lit("Data1"), F.trim(payload))
    return F.when(is_nullish(payload), None).when(t.isNull(), whole).when(F.startswith(t, F.lit("{")), F.coalesce(F.from_json(t, "map<string,string>"), F.create_map(F.lit("Data1"), t))).when(F.startswith(t, F.lit("[")) & listed.isNotNull(), numbered).otherwise(F.create_map(F.lit("Data1"), t))


def summary(event_data: Column, message: Column, user_data: Column, task: Column) -> Column:
    """One line about an event: payload as ``k=v`` pairs, else the message, else the second payload, else the task, else ``-``."""

    def pairs(c: Column) -> Column:
        m = F.filter(F.map_entries(as_map(c)), lambda e: ~is_nullish(e["value"]))
        text = F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
        return F.nullif(collapse(text), F.lit(""))

    told = F.when(~is_nullish(message), F.nullif(collapse(message), F.lit("")))
    return F.coalesce(pairs(event_data), told, pairs(user_data), F.when(~is_nullish(task), F.concat(F.lit("Task: "), F.trim(task))), F.lit("-"))
