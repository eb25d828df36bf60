"""From a question to cited context: parse, candidates, filter, links, batches, answer, audit."""

from __future__ import annotations

import json
import os
import re
import socket
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import collapse, strip_dot0, utc_second
from tracewright.operators import correlate, filters, vectors
from tracewright.operators.filters import QueryFilter
from tracewright.plans.parser import QueryParser


@dataclass
class PipelineConfig:
    top_templates: int = 5
    context_rows: int = 50
    batch_rows: int = 15
    frequent_template: int = 20
    least_weight: float = 0.2
    always_correlate: bool = False


@dataclass
class Answer:
    text: str
    citations: list[str]
    model_name: str = "mock"
    model_version: str = "1"
    backend: str = "mock"
    latency_ms: float = 0.0


class Backend(Protocol):
    """Anything that answers from a system prompt, a question and context batches."""

    def generate(self, system: str, question: str, batches: list[str]) -> Answer: ...


_CITED = re.compile(r"RecordID=(\S+) \|.*?\| Channel=([\w\-/]+)")
CITATION = re.compile(r"\[Record #(\S+), Channel: ([^\]]+)\]")
NOTHING = "The requested information was not found in the provided records."


class MockBackend:
    """Deterministic: names the first records of the context, or says that there are none."""

    def generate(self, system: str, question: str, batches: list[str]) -> Answer:
        began = time.perf_counter()
        cited = list(dict.fromkeys(_CITED.findall("\n".join(batches))))
        if not cited:
            return Answer(NOTHING, [], latency_ms=(time.perf_counter() - began) * 1e3)
        lines = [f"Event [Record #{r}, Channel: {c}] matches the question." for r, c in cited[:5]]
        text = "\n".join(lines + [f"{len(cited)} records are in the context."])
        return Answer(text, [m[0] for m in CITATION.findall(text)], latency_ms=(time.perf_counter() - began) * 1e3)


class ServerBackend:
    """Asks a model server on the network by HTTP: one JSON post of model and chat messages, answered with ``message.content`` or ``choices[0].message.content``."""

    def __init__(self, url: str, model: str, timeout: float = 120.0):
        self.url, self.model, self.timeout = url, model, timeout

    def reachable(self) -> bool:
        host = urllib.parse.urlsplit(self.url)
        try:
            socket.create_connection((host.hostname, host.port or (443 if host.scheme == "https" else 80)), 2).close()
        except OSError:
            return False
        return True

    def generate(self, system: str, question: str, batches: list[str]) -> Answer:
        began = time.perf_counter()
        body = {"model": self.model, "stream": False, "messages": [{"role": "system", "content": system}, {"role": "user", "content": question + "\n\n" + "\n\n".join(batches)}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            told = json.load(r)
        message = told["choices"][0]["message"] if "choices" in told else told["message"]
        text = message["content"]
        return Answer(text, [m[0] for m in CITATION.findall(text)], self.model, str(told.get("model", self.model)), "server", (time.perf_counter() - began) * 1e3)


#: Back ends by name; a caller may add its own.
BACKENDS: dict[str, Callable[..., Backend]] = {"mock": MockBackend, "server": ServerBackend}
#: Environment: address and model of a server that ``auto`` takes if it answers.
SERVER_VARIABLE, MODEL_VARIABLE = "TRACEWRIGHT_MODEL_URL", "TRACEWRIGHT_MODEL_NAME"


def backend(kind: str = "auto", **options: object) -> Backend:
    """A back end by name. ``auto``: the server that the environment names, if it is there, else the deterministic one."""
    if kind == "auto":
        url = os.environ.get(SERVER_VARIABLE)
        server = ServerBackend(url, os.environ.get(MODEL_VARIABLE, "default")) if url else None
        return server if server and server.reachable() else MockBackend()
    if kind not in BACKENDS:
        raise ValueError(f"no such backend here: {kind}")
    return BACKENDS[kind](**options)


SYSTEM_PROMPT = """You analyse Windows event logs and answer from the given records only.
1. Cite the record behind every statement as [Record #<id>, Channel: <channel>].
2. Speak of frequent templates as aggregates; do not claim to have looked at each occurrence.
3. If the records do not hold the answer, say that it was not found in the provided records.
4. Tell linked events in the order of their times, with the distances between them.
5. Call links of low confidence possibly related, not certain.
"""


def user_prompt(question: str, q: QueryFilter) -> str:
    lines = [f'QUESTION: "{question}"', f"INTENT: {q.intent.upper()}"]
    if q.time_range:
        lines.append(f"TIME RANGE: {q.time_range.start_utc} to {q.time_range.end_utc} (UTC)")
    for name, v in (("CHANNEL", q.source_type), ("EVENT ID", q.event_id), ("LEVEL", q.level)):
        if v:
            lines.append(f"{name}: {v}")
    named = {k: v for k, v in asdict(q.entity_filters).items() if v}
    if named:
        lines.append(f"ENTITIES: {named}")
    return "\n".join(lines)


def context_line(at: dict[str, Column]) -> Column:
    """One line of context for a record."""
    v = lambda k: F.coalesce(at.get(k, F.lit(None).cast("string")).cast("string"), F.lit(""))
    body = F.when(~F.trim(v("event_data")).isin("", "{}"), v("event_data")).otherwise(v("message"))
    named = [("RecordID", strip_dot0(v("record_id"))), ("TimeCreated", v("time")), ("Channel", v("channel")), ("EventID", v("event_id")), ("Level", v("level")), ("Provider", v("provider")), ("Computer", v("computer")), ("UserID", v("user_id")), ("ProcessID", strip_dot0(v("process_id"))), ("ThreadID", strip_dot0(v("thread_id"))), ("EventData", F.substring(collapse(body), 1, 140))]
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{n}="), c) for n, c in named])


# Lines of the context that a model is shown.
EMPTY_CONTEXT = "TOTAL_RECORDS: 0\nNo canonical log records matched the retrieval criteria."
SUMMARY_LINE = "### TEMPLATE AGGREGATE SUMMARY:"
TEMPLATE_LINE = '- Template `{template_id}`: Total Occurrences={total_count:,} (First Seen: {first_seen_utc}, Last Seen: {last_seen_utc}) | Pattern: "{template_string}"'
BATCH_LINE = "--- BATCH {} OF {} (Chronological Window: {} -> {} UTC) ---"
SCHEMA_LINE = "Schema: RecordID | TimeCreated (UTC) | Channel | EventID | Level | Provider | Computer | UserID | ProcessID | ThreadID | Payload / Relation"
LINK_MARK = " [Correlation: Δt={}, Confidence={}, Reason={}]"
CAP_NOTE = "[NOTE: Context capped at {} representative records out of {:,} total matches in scope. The analysis must summarize high-frequency templates in aggregate rather than claiming individual inspection of every row.]"


def batches_of(lines: list[tuple[str, str]], templates: list[dict], total: int, config: PipelineConfig) -> list[str]:
    """Text batches of (time, line) pairs in order, after a card of frequent templates; ``total`` rows matched in all."""
    if not lines:
        return [EMPTY_CONTEXT]
    frequent = [TEMPLATE_LINE.format(**t) for t in templates if t["total_count"] >= config.frequent_template]
    out = ["\n".join([SUMMARY_LINE, *frequent])] if frequent else []
    parts = [lines[i : i + config.batch_rows] for i in range(0, len(lines), config.batch_rows)]
    for n, p in enumerate(parts, 1):
        out.append("\n".join([BATCH_LINE.format(n, len(parts), p[0][0], p[-1][0]), SCHEMA_LINE, *(x for _, x in p)]))
    if total > len(lines):
        out.append(CAP_NOTE.format(len(lines), total))
    return out


AUDIT = "query_id string, asked_at timestamp, user_query string, intent string, filter string, template_ids array<string>, direct_record_ids array<string>, correlated_record_ids array<string>, final_record_ids array<string>, citations array<string>, answer string, model_name string, model_version string, backend string, latency_ms double"


@dataclass
class Result:
    query_id: str
    filter: QueryFilter
    records: DataFrame
    linked: list[dict]
    batches: list[str]
    answer: Answer
    audit: DataFrame
    direct_ids: list[str] = field(default_factory=list)
    final_ids: list[str] = field(default_factory=list)


class Pipeline:
    """Runs questions over records with an ``instant`` column, and optional templates, instances and entity index."""

    def __init__(self, records: DataFrame, instant: str, record_id: str, templates: DataFrame | None = None, instances: DataFrame | None = None, index: DataFrame | None = None, config: PipelineConfig | None = None, llm: Backend | None = None, embedder: vectors.Embedder | None = None):
        self.records, self.instant, self.record_id = records, instant, record_id
        self.templates, self.instances, self.index = templates, instances, index
        self.config, self.llm, self.embedder = config or PipelineConfig(), llm or MockBackend(), embedder or vectors.HashingEmbedder()

    def bounds(self) -> tuple[str, str] | None:
        lo, hi = self.records.agg(utc_second(F.min(self.instant)), utc_second(F.max(self.instant))).first()
        return (lo, hi) if lo else None

    def candidates(self, q: QueryFilter) -> list[dict]:
        """Templates nearest to the question's words, among those that its channel, level, event id and time allow."""
        if self.templates is None:
            return []
        t = self.templates
        for column, v in (("source_type", q.source_type), ("level", q.level), ("event_id", q.event_id)):
            if v:
                t = t.where(F.lower(column) == v.lower())
        if q.time_range:
            t = t.where(filters.overlapping(t, "first_seen_utc", "last_seen_utc", q.time_range.start_utc, q.time_range.end_utc))
        wanted = [float(x) for x in vectors.query_vector(self.embedder, q.semantic_query)]
        scored = vectors.embedded(t, "template_string", self.embedder).withColumn("score", F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in wanted])), 6))
        return [r.asDict() for r in scored.where("score > 0").orderBy(F.desc("score"), "template_id").limit(self.config.top_templates).drop("embedding").collect()]

    def direct(self, q: QueryFilter, templates: list[dict]) -> DataFrame:
        """Matching records; candidates narrow them only if there are any and the question names no entity."""
        chosen = None
        if templates and self.instances is not None and not q.entity_filters.any():
            chosen = self.instances.where(F.col("template_id").isin([t["template_id"] for t in templates])).select("event_record_id")
        return filters.run(self.records, q, chosen, None, self.instant)

    def ask(self, question: str, reference: datetime | None = None) -> Result:
        began = time.perf_counter()
        bounds = self.bounds()
        q = QueryParser().parse(question, reference, bounds)
        templates = self.candidates(q)
        matched = self.direct(q, templates)
        limit = 10 if q.intent == "pattern_or_aggregate" else self.config.context_rows
        first = [r[0] for r in matched.select(strip_dot0(F.col(self.record_id).cast("string"))).limit(limit).collect()]
        linked: list[dict] = []
        anchor = q.entity_filters.event_record_id or (first[0] if first else None)
        if self.index is not None and anchor and (q.intent == "correlation" or self.config.always_correlate or q.entity_filters.event_record_id):
            linked = [r.asDict() for r in correlate.linked_to(self.index, anchor, least_weight=self.config.least_weight, limit=50).collect()]
        ids = list(dict.fromkeys(first + [r["event_record_id"] for r in linked]))
        from tracewright.schema import resolve_columns

        at = {k: F.col(f"`{c}`") for k, c in resolve_columns(self.records.columns).items()}
        rows = self.records.where(strip_dot0(F.col(self.record_id).cast("string")).isin(ids))
        shown = rows.orderBy(F.col(self.instant).asc_nulls_last(), self.record_id).limit(self.config.context_rows).select(utc_second(F.col(self.instant)).alias("t"), strip_dot0(F.col(self.record_id).cast("string")).alias("r"), context_line(at).alias("line")).collect()
        why = {r["event_record_id"]: LINK_MARK.format(r["time_delta"], r["confidence"], r["relation"]) for r in linked}
        known = templates
        if not known and self.templates is not None and q.event_id:
            known = [r.asDict() for r in self.templates.where(F.col("event_id") == q.event_id).orderBy(F.desc("total_count"), "template_id").limit(5).collect()]
        batches = batches_of([(s["t"], s["line"] + why.get(s["r"], "")) for s in shown], known, len(ids), self.config)
        answer = self.llm.generate(SYSTEM_PROMPT, user_prompt(question, q), batches)
        qid = f"QID_{uuid.uuid4().hex[:12].upper()}"
        row = (qid, datetime.now(timezone.utc), question, q.intent, json.dumps(asdict(q)), [t["template_id"] for t in known], first, [r["event_record_id"] for r in linked], ids, answer.citations, answer.text, answer.model_name, answer.model_version, answer.backend, (time.perf_counter() - began) * 1e3)
        audit = self.records.sparkSession.createDataFrame([row], AUDIT)
        return Result(qid, q, rows, linked, batches, answer, audit, first, ids)


def append_audit(audit: DataFrame, path: str) -> None:
    """Add an audit row to a parquet folder."""
    audit.write.mode("append").parquet(path)


#: Channels that a diagnosis names.
SHOWN_CHANNELS = 50


def diagnose(records: DataFrame, q: QueryFilter, bounds: tuple[str, str] | None) -> list[str]:
    """Why a question found nothing: a channel that is not there, a process id that does not occur (with the five most frequent), a time outside the data."""
    from tracewright.schema import resolve_columns

    at, out = resolve_columns(records.columns), []
    if q.source_type and "channel" in at:
        named = F.lower(F.trim(F.col(f"`{at['channel']}`")))
        if records.where(named == q.source_type.strip().lower()).limit(1).count() == 0:
            most = records.where(named.isNotNull()).groupBy(F.col(f"`{at['channel']}`").alias("c")).count().orderBy(F.desc("count"), "c").limit(SHOWN_CHANNELS).collect()
            out.append(f"channel {q.source_type} does not occur; most frequent: {[r['c'] for r in most]}")
    if q.entity_filters.process_id and "process_id" in at:
        pid = strip_dot0(F.col(at["process_id"]))
        if records.where(pid == q.entity_filters.process_id).limit(1).count() == 0:
            most = records.where(pid.isNotNull()).groupBy(pid.alias("pid")).count().orderBy(F.desc("count"), "pid").limit(5).collect()
            out.append(f"process id {q.entity_filters.process_id} does not occur; most frequent: {[r['pid'] for r in most]}")
    if q.time_range and q.time_range.outside_coverage and bounds:
        out.append(f"the time range lies outside the data ({bounds[0]} to {bounds[1]})")
    return out
