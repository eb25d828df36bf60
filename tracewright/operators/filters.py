"""One predicate from a structured question, keyword and facet filters, candidate and point look-ups."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import payload
from tracewright.functions.entities import host_form, integer_form
from tracewright.functions.text import strip_dot0
from tracewright.operators.timestamps import with_instant
from tracewright.schema import ACCOUNT_FORMS, LEVEL_FORMS, resolve_columns
from tracewright.session import fresh


@dataclass
class TimeRange:
    start_utc: str
    end_utc: str
    is_relative: bool = False
    raw_expression: str = ""
    outside_coverage: bool = False


@dataclass
class EntityFilters:
    process_id: str | None = None
    thread_id: str | None = None
    user_id: str | None = None
    logon_id: str | None = None
    computer: str | None = None
    ip_address: str | None = None
    event_record_id: str | None = None
    process_name: str | None = None
    provider: str | None = None
    status_code: str | None = None

    def any(self) -> bool:
        return any(asdict(self).values())


@dataclass
class QueryFilter:
    time_range: TimeRange | None = None
    source_type: str | None = None
    entity_filters: EntityFilters = field(default_factory=EntityFilters)
    event_id: str | None = None
    level: str | None = None
    semantic_query: str = ""
    intent: str = "ambiguous"
    raw_query: str = ""
    clarifying_question: str | None = None


def _low(c: Column) -> Column:
    return F.lower(c.cast("string"))


def same_number(c: Column, value: str) -> Column:
    """Equal as an integer, or as text without ``.0``."""
    n = int(value) if value.isdigit() else None
    text = F.coalesce(strip_dot0(c.cast("string")) == value, F.lit(False))
    return text if n is None else F.coalesce(integer_form(c.cast("string")) == n, F.lit(False)) | text


def process_forms(value: str) -> tuple[str, str]:
    """(decimal, hexadecimal) of a process id given in either form; a value that is no number twice as it is."""
    v = value.strip().lower()
    try:
        n = int(v, 16) if v.startswith("0x") else int(v)
    except ValueError:
        return v, v
    return str(n), hex(n)


def like_any(c: Column, value: str) -> Column:
    """``%value%`` whatever the case; ``_`` and ``%`` in the value stay wild cards."""
    return F.coalesce(_low(c).like(f"%{value.strip().lower()}%"), F.lit(False))


def _entity_predicates(e: EntityFilters, event_id: str | None, at: dict[str, Column]) -> list[Column]:
    body, out = at["event_data"], []

    def own(name: str) -> Column | None:
        return at.get(name)

    def held(name: str, value: str) -> Column:
        return payload.equals(body, name, value, event_id)

    if e.process_id:
        dec, hexa = process_forms(e.process_id)
        p = held("process_id", dec) | held("process_id", hexa)
        if own("process_id") is not None:
            p = p | same_number(own("process_id"), dec) | (_low(own("process_id")) == e.process_id.strip().lower())
        out.append(p)
    if e.process_name:
        p = held("process_name", e.process_name)
        out.append(p | like_any(payload.field(body, "NewProcessName"), e.process_name) | like_any(payload.field(body, "ProcessName"), e.process_name))
    if e.provider and own("provider") is not None:
        out.append(like_any(own("provider"), e.provider))
    if e.status_code:
        out.append(held("status_code", e.status_code))
    if e.thread_id and own("thread_id") is not None:
        out.append(same_number(own("thread_id"), e.thread_id.strip()))
    if e.computer:
        p = held("computer", e.computer)
        out.append(p if own("computer") is None else p | like_any(own("computer"), e.computer))
    if e.user_id:
        forms = ACCOUNT_FORMS.get(e.user_id.strip().lower(), [e.user_id.strip()])
        p = reduce(lambda a, b: a | b, [held("user_id", f) for f in forms])
        out.append(p if own("user_id") is None else p | _low(own("user_id")).isin([f.lower() for f in forms]))
    for name in ("ip_address", "logon_id"):
        if getattr(e, name):
            out.append(held(name, getattr(e, name)))
    if e.event_record_id:
        out.append(strip_dot0(at["record_id"].cast("string")) == e.event_record_id.strip())
    return out


def predicate(q: QueryFilter, columns: list[str], instant: str | None = None) -> Column:
    """All conditions of a question as one boolean column, so that they reach the scan together.

    ``instant`` names a timestamp column for the time range; a range cannot be asked of text.
    """
    at = {k: F.col(f"`{c}`") for k, c in resolve_columns(columns).items()}
    at.setdefault("event_data", F.lit(None).cast("string"))
    parts: list[Column] = []
    if q.time_range:
        if instant is None:
            raise ValueError("a time range needs a column of instants")
        low, high = (F.lit(parse_instant(x)).cast("timestamp") for x in (q.time_range.start_utc, q.time_range.end_utc))
        parts.append(F.col(f"`{instant}`").between(low, high))
    if q.source_type:
        parts.append(_low(at["channel"]) == q.source_type.lower())
    if q.event_id:
        parts.append(same_number(at["event_id"], str(q.event_id).strip()))
    if q.level:
        forms = LEVEL_FORMS.get(q.level.strip().lower(), [q.level.strip().lower()])
        parts.append(F.lower(strip_dot0(at["level"].cast("string"))).isin(forms))
    parts += _entity_predicates(q.entity_filters, q.event_id, at)
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(True))


def parse_instant(text: str) -> datetime:
    """A bound of a range; without zone it is UTC."""
    t = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def with_instants(df: DataFrame, zones: DataFrame | None, out: str) -> DataFrame:
    """``df`` plus ``out`` (timestamp): its time column in any notation, by the zones of its hosts; null where a row has no instant."""
    at, us = resolve_columns(df.columns), fresh(df.columns, "__us")
    zones = df.sparkSession.createDataFrame([], "computer string, time_zone string, locale string") if zones is None else zones
    host = host_form(F.col(f"`{at['computer']}`")) if "computer" in at else F.lit(None).cast("string")
    return with_instant(df, at["time"], host, zones, us).withColumn(out, F.timestamp_micros(us)).drop(us)


def run(df: DataFrame, q: QueryFilter, candidates: DataFrame | None = None, limit: int | None = None, instant: str | None = None, zones: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Matching rows by instant and record, rows without instant last (in no order unless ``ordered``, and then no instant is read for a question without time). ``candidates``: one column of record ids to stay within (None: no bound, empty: no rows).

    ``instant`` names a timestamp column; without it instants are read from the time column,
    whatever its notation, with ``zones`` (computer, time_zone, locale) for wall times.
    """
    columns, at = df.columns, resolve_columns(df.columns)
    ordered = ordered or limit is not None
    if instant is None and (ordered or q.time_range):
        # What needs no instant is filtered first: times are read for the rows that are left.
        df = df.where(predicate(replace(q, time_range=None), columns))
        instant = fresh(columns, "__instant")
        df = with_instants(df, zones, instant)
    out = df.where(predicate(q, columns, instant))
    if candidates is not None:
        ids = candidates.select(strip_dot0(F.col(candidates.columns[0]).cast("string")).alias("__id")).distinct()
        out = out.withColumn("__r", strip_dot0(F.col(f"`{at['record_id']}`").cast("string"))).join(ids, F.col("__r") == F.col("__id"), "left_semi").drop("__r")
    if ordered:
        out = out.orderBy(F.col(f"`{instant}`").asc_nulls_last(), F.col(f"`{at['record_id']}`"))
    return (out.limit(limit) if limit else out).select(*[F.col(f"`{c}`") for c in columns])


def keyword(df: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns contains the word, literally, whatever the case."""
    w = F.lit(word.lower())
    hits = [F.coalesce(F.contains(F.lower(F.col(f"`{c}`").cast("string")), w), F.lit(False)) for c in columns if c in df.columns]
    return df.where(reduce(lambda a, b: a | b, hits, F.lit(False)))


def facets(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Rows whose columns hold one of the chosen values; an empty choice is no bound."""
    for c, values in chosen.items():
        if values:
            df = df.where(F.col(f"`{c}`").isin(values))
    return df


def where_ids(df: DataFrame, expression: str, id_column: str) -> DataFrame:
    """Ids of the rows that a SQL expression of a trusted caller selects."""
    return df.where(expression).select(id_column)


def fetch(df: DataFrame, id_column: str, ids: list) -> DataFrame:
    """Rows of the given ids."""
    return df.where(F.col(f"`{id_column}`").isin(ids))


def template_keyword(templates: DataFrame, word: str) -> DataFrame:
    """Templates whose text, or event id, is like ``%word%``."""
    return templates.where(like_any(F.col("template_string"), word) | F.col("event_id").like(f"%{word}%"))


def overlapping(templates: DataFrame, first: str, last: str, start: str, end: str) -> Column:
    """Condition that ``[first, last]`` of a row and ``[start, end]`` meet."""
    return (F.col(last) >= F.lit(start)) & (F.col(first) <= F.lit(end))


# Fixed values: (words of the topic, event ids that answer it, tactic, name, threat level); the first topic with a word in the question counts.
HUNTS = [
    (["failed logon", "fail", "bad password", "brute force", "4625", "auth fail", "logon error"], ["4625", "4740", "4776"], "Credential Access (TA0006) - T1110: Brute Force", "Authentication Failure & Password Spray Analysis", "High"),
    (["privilege", "escalation", "admin", "4672", "special privilege", "token", "seimpersonate"], ["4672", "4673", "4674"], "Privilege Escalation (TA0004) - T1078.002: Domain/Local Admin Privileges", "Special Privilege Assignment & Token Analysis", "Medium"),
    (["successful logon", "valid logon", "logon type", "4624"], ["4624"], "Initial Access / Lateral Movement (TA0008) - T1078: Valid Accounts", "Successful User Authentication Trace", "Informational"),
    (["process", "powershell", "cmd", "execution", "command", "4688", "4104"], ["4688", "4104", "4103", "1"], "Execution (TA0002) - T1059: Command and Scripting Interpreter", "Process Creation & Script Execution Audit", "Medium"),
    (["service", "persistence", "7045", "4697", "installed"], ["7045", "4697"], "Persistence (TA0003) - T1543.003: Windows Service Creation", "New Service Creation / Persistence Artifacts", "High"),
    (["clear", "cleared", "tamper", "audit log", "1102", "104", "evasion"], ["1102", "104"], "Defense Evasion (TA0005) - T1070.001: Clear Windows Event Logs", "Event Log Deletion & Defense Evasion", "Critical"),
    (["user create", "account create", "password reset", "lockout", "4720", "4724", "4740", "group"], ["4720", "4722", "4724", "4728", "4738", "4740"], "Persistence / Impact - T1136: Create Account", "Account Management & Modification Tracking", "Medium"),
]


def hunt(question: str) -> dict:
    """Event ids, tactic, name and threat level for a question: the first topic that fits, plus any four-digit ids named."""
    q = question.lower()
    topic = next((h for h in HUNTS if any(w in q for w in h[0])), None)
    ids = list(topic[1]) if topic else []
    ids += [n for n in re.findall(r"\b\d{4}\b", q) if n not in ids]
    return {"event_ids": ids, "tactic": topic[2] if topic else None, "technique": topic[3] if topic else "", "threat_level": topic[4] if topic else "Informational"}


# Words that a fallback search leaves out.
STOP_WORDS = ["show", "find", "were", "what", "when", "where", "from", "with", "have", "been", "that", "this", "events", "logs"]


def search_terms(question: str, terms: int | None = None) -> list[str]:
    """What a question names: its IPv4 addresses and hex codes, else its words of four characters and more that are no stop words; ``terms`` bounds their number."""
    words = ["".join(c for c in w if c.isalnum() or c in "_.-").strip(".-") for w in question.lower().split()]
    dotted = lambda w: w.count(".") == 3 and all(p.isdigit() and len(p) < 4 for p in w.split("."))
    hexa = lambda w: w.startswith("0x") and len(w) > 2 and all(c in "0123456789abcdef" for c in w[2:])
    named = [w for w in words if dotted(w) or hexa(w)]
    return (named or [w for w in words if len(w) >= 4 and w not in STOP_WORDS])[:terms]


def fallback_search(df: DataFrame, question: str, columns: list[str], order: list[str], level: str | None = None, limit: int = 50, terms: int | None = 5) -> DataFrame:
    """Rows with one of the question's terms (:func:`search_terms`; the first five unless ``terms`` says otherwise, None: all).

    Without such terms: rows of the level that the question names, else the first ``limit``
    rows in the given order, as an excerpt to look at.
    """
    wanted = search_terms(question, terms)
    if wanted:
        hits = [F.coalesce(F.contains(F.lower(F.col(f"`{c}`")), F.lit(t)), F.lit(False)) for t in wanted for c in columns]
        return df.where(reduce(lambda a, b: a | b, hits))
    for word, forms in (("error", ["error", "critical"]), ("warning", ["warning"])):
        if level and word in question.lower():
            return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(level)), F.lit(x)) for x in forms]))
    return df.orderBy(*order).limit(limit)
