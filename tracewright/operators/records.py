"""Records: clean values, one-line and document forms, and rows from nested raw events."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tracewright.functions.text import collapse, is_nullish, or_null, shorten, uuid5
from tracewright.schema import CANONICAL, CANONICAL_SCHEMA, LEVEL_NAMES, NULL_WORDS

EMPTY = "LogRecord: [Empty attributes]"
#: Payload columns, cut to a length in documents.
LONG = ["Message", "EventData", "UserData"]
# Order of the columns in a row document; others follow in their own order.
DOCUMENT_ORDER = [
    "TimeCreated", "RecordID", "EventID", "LevelName", "Level", "Channel", "Computer", "UserID", "Provider", "Task",
    "Opcode", "Keywords", "ProcessID", "ThreadID", "EventSourceName", "ActivityID", "RelatedActivityID", "Version",
    "Qualifiers", "Message", "EventData", "UserData",
]


def without_nulls(text: str | None) -> str | None:
    """JSON text with nulls and null words as empty texts; anything else as it is."""
    try:
        v = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return text

    def walk(x: object) -> object:
        if isinstance(x, dict):
            return {k: walk(y) for k, y in x.items()}
        if isinstance(x, list):
            return [walk(y) for y in x]
        return "" if x is None or isinstance(x, str) and x.strip().lower() in NULL_WORDS else x

    return json.dumps(walk(v), ensure_ascii=False).encode("utf-8", "replace").decode()


def clean(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All canonical columns (and those of ``keep`` as they are) as trimmed text, missing ones and null words as empty text; in the payload columns also inside JSON.

    Only payloads that look like JSON and hold a null word somewhere are read.
    """
    have = {c.lower(): c for c in df.columns}

    @pandas_udf("string")
    def emptied(t: pd.Series) -> pd.Series:
        return t.map(without_nulls)

    def one(c: str) -> Column:
        if c.lower() not in have:
            return F.lit("").alias(c)
        t = F.trim(F.col(f"`{have[c.lower()]}`").cast("string"))
        plain_text = F.when(is_nullish(t, wide=False), F.lit("")).otherwise(t)
        if c not in LONG:
            return plain_text.alias(c)
        return F.when(t.rlike(r"(?is)^[\[{].*(null|none|nan)"), emptied(F.when(t.rlike(r"(?is)^[\[{].*(null|none|nan)"), t))).otherwise(plain_text).alias(c)

    return df.select(*[one(c) for c in CANONICAL], *(keep or []))


def semantic_line(at: dict[str, Column], details: int = 300) -> Column:
    """``[time] host | channel | EventID: n (level) | User: u | Details: d``; what is null drops out with its mark.

    ``at``: columns by the names time, computer, channel, event_id, level, user_id, message.
    """
    v = {k: or_null(at[k]) if k in at else F.lit(None).cast("string") for k in ("time", "computer", "channel", "event_id", "level", "user_id", "message")}
    eid = F.when(v["event_id"].contains("#text"), F.coalesce(F.nullif(F.regexp_extract(v["event_id"], r"#text['\"]?\s*:\s*['\"]?(\d+)", 1), F.lit("")), v["event_id"])).otherwise(v["event_id"])
    stamp = F.concat(F.lit("["), v["time"], F.lit("]"))
    head = F.nullif(F.concat_ws(" ", stamp, v["computer"]), F.lit(""))
    event = F.coalesce(F.concat(F.lit("EventID: "), eid, F.lit(" ("), v["level"], F.lit(")")), F.concat(F.lit("EventID: "), eid), F.concat(F.lit("Level: "), v["level"]))
    text = F.concat_ws(" | ", head, v["channel"], event, F.concat(F.lit("User: "), v["user_id"]), F.concat(F.lit("Details: "), F.substring(collapse(v["message"]), 1, details)))
    return F.when(text == "", F.lit(EMPTY)).otherwise(text)


def document(columns: list[str], payload_chars: int = 300) -> Column:
    """``column: value`` of all columns that hold something; payloads and custom columns are cut."""
    order = [c for c in DOCUMENT_ORDER if c in columns] + [c for c in columns if c not in DOCUMENT_ORDER and c not in ("row_id", "chunk_id")]
    parts = []
    for c in order:
        t = collapse(F.col(f"`{c}`").cast("string"))
        t = shorten(t, payload_chars) if c in LONG or c not in DOCUMENT_ORDER else t
        parts.append(F.when(~is_nullish(F.col(f"`{c}`").cast("string")), F.concat(F.lit(f"{c}: "), t)))
    text = F.concat_ws(" | ", *parts)
    return F.when(text == "", F.lit(EMPTY)).otherwise(text)


def documents(df: DataFrame, id_column: str | None = None, payload_chars: int = 300) -> DataFrame:
    """(row_id, chunk_id, text, host, start_time, event_ids, levels) of each row.

    The id is that of the named column, else RecordID, else row_id, else a UUID of host,
    time and the row's own content.
    """
    have = set(df.columns)
    col = lambda c: or_null(F.col(f"`{c}`").cast("string")) if c in have else F.lit(None).cast("string")
    host, time = F.coalesce(col("Computer"), col("host")), F.coalesce(col("TimeCreated"), col("timestamp"))
    body = document(df.columns, payload_chars)
    seed = F.concat_ws(":", F.coalesce(host, F.lit("HOST")), F.coalesce(time, F.lit("TIME")), F.sha1(body))
    ids = [col(c) for c in ([id_column] if id_column else []) + ["RecordID", "row_id"]]
    row_id = F.coalesce(*ids, uuid5(seed))
    listed = lambda c: F.array_compact(F.array(c))
    return df.select(row_id.alias("row_id"), row_id.alias("chunk_id"), body.alias("text"), host.alias("host"), time.alias("start_time"), listed(col("EventID")).alias("event_ids"), listed(F.coalesce(col("LevelName"), col("level"))).alias("levels"))


# Nested raw events. Their shape is open, so rows are made on the executors, batch by batch.

#: Attributes that stand for a value, best first.
ATTRIBUTES = ["SystemTime", "Name", "Value", "UserID", "ProcessID", "ThreadID", "Guid", "ActivityID"]


def _word(s: str) -> str:
    s = s.strip()
    return "" if s.lower() in NULL_WORDS else s


def scalar(v: object) -> str:
    """One text for a value of any shape; null words are empty."""
    match v:
        case None:
            return ""
        case str():
            m = re.search(r"#text['\"]?\s*:\s*['\"]?([^'\"}]+)", v) if v.lstrip().startswith("{") else None
            return _word(m.group(1) if m else v)
        case list():
            return ", ".join(t for t in map(scalar, v) if t)
        case dict():
            if "#text" in v:
                return scalar(v["#text"])
            attributes = v.get("#attributes")
            if isinstance(attributes, dict):
                for a in ATTRIBUTES:
                    if a in attributes:
                        return scalar(attributes[a])
            if "Name" in v:
                value = scalar(v.get("Value"))
                return f"{v['Name']}={value}" if value else scalar(v["Name"])
            if len(v) == 1:
                return scalar(*v.values())
            return json.dumps({str(k): scalar(x) for k, x in v.items()}, ensure_ascii=False)
        case _:
            return str(v)


def _named(x: object) -> tuple[str, object] | None:
    """(name, value) of an item like ``{"#attributes": {"Name": ..}, "#text": ..}``."""
    if not isinstance(x, dict):
        return None
    attributes = x.get("#attributes")
    name = attributes.get("Name") if isinstance(attributes, dict) else None
    name = x.get("Name") if name is None else name
    return None if name is None else (str(name), x.get("#text", x.get("Value")))


def plain(v: object) -> object:
    """A payload without wrappers: named items become members, attributes join their element, nulls are empty text."""
    if v is None:
        return ""
    if isinstance(v, str):
        return _word(v)
    if isinstance(v, list):
        pairs = [_named(x) for x in v]
        if v and all(p is not None for p in pairs):
            return {k: plain(x) for k, x in pairs}
        return [plain(x) for x in v]
    if isinstance(v, dict):
        if set(v) == {"Data"}:
            return plain(v["Data"])
        own = _named(v) if "#attributes" in v and ("#text" in v or "Value" in v) else None
        if own:
            return {own[0]: plain(own[1])}
        out: dict = {}
        for k, x in v.items():
            if k == "#attributes" and isinstance(x, dict):
                out |= {a: plain(b) for a, b in x.items() if not a.startswith("xmlns")}
            else:
                out["Value" if k == "#text" else k] = plain(x)
        return out
    return v


def payload_text(v: object) -> str:
    p = plain(v)
    if p in ("", {}, []):
        return ""
    return json.dumps(p, ensure_ascii=False) if isinstance(p, (dict, list)) else str(p)


#: Column -> (element below System, attribute or None for its value).
_SYSTEM = {
    "RecordID": ("EventRecordID", None), "TimeCreated": ("TimeCreated", None), "EventID": ("EventID", None), "Qualifiers": ("EventID", "Qualifiers"),
    "Level": ("Level", None), "Channel": ("Channel", None), "Provider": ("Provider", "Name"), "ProviderGuid": ("Provider", "Guid"),
    "EventSourceName": ("Provider", "EventSourceName"), "Task": ("Task", None), "Opcode": ("Opcode", None), "Keywords": ("Keywords", None),
    "Computer": ("Computer", None), "UserID": ("Security", "UserID"), "ProcessID": ("Execution", "ProcessID"), "ThreadID": ("Execution", "ThreadID"),
    "Version": ("Version", None), "ActivityID": ("Correlation", "ActivityID"), "RelatedActivityID": ("Correlation", "RelatedActivityID"),
}


def row_of(event: dict) -> dict[str, str]:
    """The canonical columns of one raw event (with or without an ``Event`` root)."""
    event = event.get("Event", event)
    system = event.get("System") if isinstance(event.get("System"), dict) else {}
    row = dict.fromkeys(CANONICAL, "")
    for column, (element, attribute) in _SYSTEM.items():
        v = system.get(element)
        if attribute and isinstance(v, dict):
            held = v.get("#attributes")
            v = (held.get(attribute) if isinstance(held, dict) else None) or v.get(attribute)
        elif attribute and column not in ("Provider", "UserID"):
            v = None
        row[column] = scalar(v)
    row["LevelName"] = LEVEL_NAMES.get(int(row["Level"]), "") if row["Level"].isdigit() else ""
    row["EventData"], row["UserData"] = payload_text(event.get("EventData")), payload_text(event.get("UserData"))
    rendered = event.get("RenderingInfo")
    row["Message"] = scalar(rendered.get("Message")) if isinstance(rendered, dict) else ""
    return row


def from_json_events(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Canonical rows from one raw event a line (with the columns of ``keep``); lines that are no JSON object are left out."""
    keep = keep or []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t, *rest in f.itertuples(index=False):
                try:
                    e = json.loads(t)
                except (TypeError, ValueError):
                    continue
                if isinstance(e, dict):
                    rows.append([*row_of(e).values(), *rest])
            yield pd.DataFrame(rows, columns=[*CANONICAL, *keep], dtype=object)

    return lines.select(column, *keep).mapInPandas(run, T.StructType([*CANONICAL_SCHEMA.fields, *[lines.schema[c] for c in keep]]))
