"""Figures and pages for viewers: counts, tops, spans, facets, batches of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import payload
from tracewright.functions.text import basename, cell, description, duration_text, is_nullish, or_null, strip_dot0, utc_second
from tracewright.operators.order import numbered_rows
from tracewright.schema import resolve_columns


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row with the number of distinct non-null values of each column, and the rows in all."""
    how = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[how(F.col(f"`{c}`")).alias(f"n_{c}") for c in columns])


def top(df: DataFrame, column: Column, name: str, k: int) -> DataFrame:
    """The k most frequent values with their counts; equal counts by value. Null words are no values."""
    g = df.select(column.alias(name)).where(~is_nullish(F.col(name))).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), name).limit(k)


def distribution(df: DataFrame, column: Column, name: str) -> DataFrame:
    """All values with count and share of the rows that have one."""
    g = df.select(column.alias(name)).where(~is_nullish(F.col(name))).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def span(df: DataFrame, ts: str) -> DataFrame:
    """First and last time, seconds between, and the span in words."""
    g = df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    seconds = F.floor((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1_000_000)
    return g.withColumn("seconds", seconds).withColumn("duration", duration_text(F.col("seconds")))


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page of rows in order; numbers out of range are brought into it. ``df`` is counted for that."""
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def record_order(record_id: Column) -> Column:
    """Numeric record id, 0 for anything else."""
    return F.coalesce(strip_dot0(record_id).try_cast("bigint"), F.lit(0))


def pick_list(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not null words, in order."""
    return df.select(F.trim(F.col(f"`{column}`")).alias("value")).where(~is_nullish(F.col("value"))).distinct().orderBy("value")


# Payload keys of each facet, and values that a facet leaves out.
FACETS = {
    "users": (["TargetUserName", "SubjectUserName", "UserName", "AccountName"], []),
    "processes": (["ProcessName", "NewProcessName", "Image"], []),
    "services": (["ServiceName", "Service"], []),
    "statuses": (["Status", "SubStatus", "ErrorCode"], ["0x0"]),
    "addresses": (["IpAddress", "SourceAddress", "ClientAddress"], ["-", "127.0.0.1", "::1"]),
}


def payload_facets(df: DataFrame, body: Column) -> DataFrame:
    """(facet, value, n): values of the payload keys of each facet over all rows, with their numbers of rows."""
    cells = []
    for facet, (keys, none) in FACETS.items():
        for k in keys:
            v = or_null(payload.member(F.col("v"), k))
            v = basename(v) if facet == "processes" else v
            cells.append(F.struct(F.lit(facet).alias("facet"), F.when(~v.isin(none) if none else v.isNotNull(), v).alias("value")))
    found = F.array_distinct(F.filter(F.array(*cells), lambda c: c["value"].isNotNull()))
    return df.select(payload.parsed(body).alias("v")).select(F.explode(found).alias("c")).groupBy("c.facet", "c.value").agg(F.count(F.lit(1)).alias("n"))


def findings(df: DataFrame, ts: str, scope: int | None = None, templates: int = 0) -> dict:
    """Figures of a card about matching records: count, span, hosts, users, levels, most frequent events with descriptions, payload values, shares.

    Each figure is an aggregate with a bounded answer; no record reaches the driver.
    """
    at = {k: F.col(f"`{c}`") for k, c in resolve_columns(df.columns).items()}
    none = F.lit(None).cast("string")
    col = lambda k: at.get(k, none)
    first = span(df, ts).withColumns({"first_ts": utc_second(F.col("first_ts")), "last_ts": utc_second(F.col("last_ts"))}).first()
    n = df.count()
    most = [(r["v"], r["n"], r["d"]) for r in top(df, strip_dot0(col("event_id")), "v", 3).withColumn("d", description(F.col("v"))).collect()]
    values = payload_facets(df, col("event_data"))
    place = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    shown = values.withColumn("r", F.row_number().over(place)).where("r <= 3").orderBy("facet", "r").collect()
    return {
        "records": n, "first": first["first_ts"], "last": first["last_ts"], "duration": first["duration"], "hosts": [r["v"] for r in top(df, col("computer"), "v", 2).collect()], "users": [r["v"] for r in top(df, col("user_id"), "v", 3).collect()],
        "levels": {r["v"]: r["n"] for r in top(df, col("level"), "v", 20).collect()}, "events": most, "providers": [r["v"] for r in top(df, col("provider"), "v", 3).collect()],
        "payload": {f: [r["value"] for r in shown if r["facet"] == f] for f in FACETS}, "scope_percent": round(n / scope * 100, 2) if scope else 100.0, "dedup_percent": round(dedup_ratio(n, templates), 2),
    }


def card(question: str, f: dict) -> str:
    """A card in words."""
    if not f["records"]:
        return f"### Findings\n\nNo records match: {question.strip()}"
    events = "; ".join(f"Event {e}{f' ({d})' if d else ''}: {n:,}" for e, n, d in f["events"])
    lines = [f"Question: {question.strip()}", f"Records: {f['records']:,} ({f['scope_percent']:.2f} % of the scope)", f"Span: {f['first']} to {f['last']} ({f['duration']})", f"Hosts: {', '.join(f['hosts']) or 'N/A'}", f"Users: {', '.join(f['users']) or 'N/A'}", "Levels: " + ", ".join(f"{k}: {v:,}" for k, v in f["levels"].items()), f"Events: {events or 'N/A'}"]
    lines += [f"{k.capitalize()}: {', '.join(v)}" for k, v in f["payload"].items() if v]
    return "### Findings\n\n" + "\n".join(f"- {x}" for x in lines)


def converter_order(record_id: Column, time: Column) -> list[Column]:
    """Order of converted files: numeric record id; others count as 0 and go by time."""
    n = strip_dot0(record_id).try_cast("bigint")
    return [F.coalesce(n, F.lit(0)), F.when(n.isNull(), time)]


def dedup_ratio(records: int, templates: int) -> float:
    """Share of records that templates save, in percent."""
    return max(0.0, 1.0 - templates / records) * 100.0 if records and templates else 0.0


def markdown_batches(df: DataFrame, order: list[Column], columns: list[str], size: int = 15, limit: int | None = None) -> DataFrame:
    """(batch, text): tables of ``size`` rows in order, each with its own header.

    Batches need positions over all rows; for more than a screenful give a ``limit``. Rows
    are numbered by a sort over partitions and offsets of partitions, not in one task.
    """
    rows = df.orderBy(*order).limit(limit) if limit else df
    total = rows.count()
    numbered = numbered_rows(rows, order)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(cell(F.col(f"`{c}`").cast("string")), F.lit("None")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join(["---"] * len(columns)) + " |"
    b = F.floor(F.col("__n") / size)
    g = numbered.select(b.alias("batch"), F.col("__n"), line.alias("line")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("__n", "line"))).alias("rows"))  # size rows a group
    first, last = F.col("batch") * size + 1, F.least((F.col("batch") + 1) * size, F.lit(total))
    title = F.concat(F.lit("### LOG BATCH ["), first.cast("string"), F.lit(" to "), last.cast("string"), F.lit(f" of {total}]\nColumns: {', '.join(columns)}\n\n{head}\n"))
    return g.select("batch", F.concat(title, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))
