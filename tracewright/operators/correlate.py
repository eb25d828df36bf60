"""Entities of records, and records linked through them within the time window of the entity's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import payload
from tracewright.functions.entities import host_form
from tracewright.functions.text import delta_text, strip_dot0
from tracewright.operators.order import numbered_rows
from tracewright.schema import LINK_DEFAULT, LINK_RULES, resolve_columns
from tracewright.session import broadcast_if_small, fresh

# Per entity type the values that are none, and the payload keys in order.
NO_LOGON = ["0x0", "0x3e7", "0", "999", "0x0:0x0"]
NO_ADDRESS = ["127.0.0.1", "::1", "-", "0.0.0.0", "localhost"]
NO_USER = ["-", "none", "null", "nan"]
LOGON_KEYS = ["TargetLogonId", "SubjectLogonId", "LogonId", "TargetLinkedLogonId"]
NAME_KEYS = ["TargetUserName", "SubjectUserName", "UserName", "AccountName"]
SID_KEYS = ["TargetUserSid", "SubjectUserSid", "UserSid"]
ADDRESS_KEYS = ["IpAddress", "SourceAddress", "ClientAddress", "SourceIP", "ClientIP"]
#: More entities of an anchor than this are joined by shuffle.
ANCHOR_ROWS = 50_000
#: Events that start a process.
STARTS = ["1", "4688"]


def with_last_start(df: DataFrame, at_us: str, out: str, block_us: int = 3_600_000_000) -> DataFrame:
    """``df`` plus the latest start, not after the row's own instant, of the same process id on the same host, as its record writes it (null: none).

    Hosts are compared in normal form and times as instants; of starts at one instant the
    greater text wins. Rows are looked at per (host, process id, time block); what a block
    does not know itself is the last start of the blocks before, of which a process has few.
    """
    at = {k: F.col(f"`{c}`") for k, c in resolve_columns(df.columns).items()}
    h, p, b, s, before = (fresh(df.columns, n) for n in ("__h", "__p", "__b", "__s", "__before"))
    t = F.col(f"`{at_us}`")
    begun = F.coalesce(payload.field(at["event_data"], "UtcTime"), at["time"])
    start = F.when(strip_dot0(at["event_id"]).isin(STARTS) & t.isNotNull(), F.struct(t.alias("t"), begun.alias("text")))
    rows = df.withColumns({h: host_form(at["computer"]), p: strip_dot0(at["process_id"]), b: F.floor(t / block_us), s: start})
    ends = rows.where(F.col(b).isNotNull() & F.col(p).isNotNull()).groupBy(h, p, b).agg(F.max(s).alias(s))
    earlier = Window.partitionBy(h, p).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    keys = [fresh(df.columns, n) for n in ("__h2", "__p2", "__b2")]
    known = ends.withColumn(before, F.max(s).over(earlier)).where(F.col(before).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip((h, p, b), keys)], before)
    rows = rows.join(known, F.col(h).eqNullSafe(F.col(keys[0])) & (F.col(p) == F.col(keys[1])) & (F.col(b) == F.col(keys[2])), "left")
    within = Window.partitionBy(h, p, b).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max(s).over(within), F.col(before))["text"]
    return rows.withColumn(out, F.when(t.isNotNull() & F.col(p).isNotNull(), last)).drop(h, p, b, s, before, *keys)


#: A rule: window in seconds, or (window, label, weight).
Rule = int | tuple[int, str, float]


def link_rules(overrides: dict[str, Rule] | None = None) -> dict[str, tuple[int, str, float]]:
    """The rule of each entity type, with those of the caller; a type that is new takes label and weight of ``LINK_DEFAULT`` if only its window is given."""
    out = dict(LINK_RULES)
    for t, rule in (overrides or {}).items():
        out[t] = (int(rule), *out.get(t, LINK_DEFAULT)[1:]) if isinstance(rule, int) else (int(rule[0]), str(rule[1]), float(rule[2]))
    return out


def extract(df: DataFrame, started: str | None = None, overrides: dict[str, Rule] | None = None) -> DataFrame:
    """Entity rows of all records: record_id, source_type, event_id, provider, time, seq, entity_type, entity_value, confidence, weight.

    ``started`` names a column with the start of the row's process, if known. A record has
    each (type, value), compared without case, once: the first in the order of the sources.
    Null or non-JSON payloads only lack what the payload would give.
    """
    at = {k: F.col(f"`{c}`") for k, c in resolve_columns(df.columns).items()}
    none = F.lit(None).cast("string")
    variant = fresh(df.columns, "__payload")
    df = df.withColumn(variant, payload.parsed(at.get("event_data", none)))
    col = lambda n: at.get(n, none)
    key = lambda k: F.trim(payload.member(F.col(variant), k))
    by_name = {c.lower(): c for c in df.columns}
    named = lambda *n: F.coalesce(*[F.nullif(F.trim(F.col(f"`{by_name[x]}`")), F.lit("")) for x in n if x in by_name], none)
    found: list[tuple[str, Column]] = []
    for k in LOGON_KEYS:
        found.append(("logon_id", F.when(~F.lower(key(k)).isin(NO_LOGON), key(k))))
    for own, k in ((("activityid", "activity_id"), "ActivityID"), (("relatedactivityid", "related_activity_id"), "RelatedActivityID")):
        v = F.coalesce(named(*own), key(k))
        found.append(("activity_id", F.when(F.regexp_replace(v, "[-0{}]", "") != "", v)))
    found.append(("user_id", F.when(~F.lower(F.trim(col("user_id"))).isin(NO_USER), F.trim(col("user_id")))))
    for k in NAME_KEYS:
        found.append(("user_id", F.when(~F.lower(key(k)).isin(NO_USER) & ~F.endswith(key(k), F.lit("$")), key(k))))
    for k in SID_KEYS:
        found.append(("user_id", F.when(F.startswith(key(k), F.lit("S-1-")), key(k))))
    for k in ADDRESS_KEYS:
        found.append(("ip_address", F.when(~key(k).isin(NO_ADDRESS), key(k))))
    pid = strip_dot0(F.coalesce(F.nullif(F.trim(col("process_id")), F.lit("")), key("ProcessId"), key("NewProcessId")))
    pid = F.when(pid != "0", pid)
    begun = F.when(strip_dot0(col("event_id")).isin(STARTS), F.coalesce(key("UtcTime"), col("time")))
    if started:
        begun = F.coalesce(begun, F.col(f"`{started}`"))
    found.append(("process_id_disambiguated", F.when(begun.isNotNull(), F.concat(F.lit("PID:"), pid, F.lit("@"), begun))))
    found.append(("process_id", F.when(begun.isNull(), pid)))
    tid = strip_dot0(col("thread_id"))
    found.append(("thread_id", F.when(tid != "0", tid)))
    host = F.coalesce(F.nullif(F.trim(col("computer")), F.lit("")), key("WorkstationName"), key("ComputerName"))
    found.append(("computer", F.when(~host.isin("-", "None", "null"), host)))
    known = link_rules(overrides)
    rules = {t: known.get(t, LINK_DEFAULT) for t, _ in found}
    cells = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(t).alias("entity_type"), v.alias("entity_value"), F.lit(rules[t][1]).alias("confidence"), F.lit(rules[t][2]).alias("weight")) for i, (t, v) in enumerate(found)])
    good = F.filter(cells, lambda e: e["entity_value"].isNotNull() & (e["entity_value"] != "") & ~F.lower(e["entity_value"]).isin("nan", "none", "null"))
    # Of equal entities of a record the first stays: no shuffle, the record has them all.
    # The list is a column of its own, built once a record and not once an element.
    first = F.filter("found", lambda e: ~F.exists("found", lambda o: (o["seq"] < e["seq"]) & (o["entity_type"] == e["entity_type"]) & (F.lower(o["entity_value"]) == F.lower(e["entity_value"]))))
    head = [strip_dot0(col("record_id")).alias("record_id"), col("channel").alias("source_type"), strip_dot0(col("event_id")).alias("event_id"), col("provider").alias("provider"), col("time").alias("time")]
    return df.select(*head, good.alias("found")).select("record_id", "source_type", "event_id", "provider", "time", F.explode(first).alias("e")).select("record_id", "source_type", "event_id", "provider", "time", "e.seq", "e.entity_type", "e.entity_value", "e.confidence", "e.weight")


def build_index(records: DataFrame, stored: DataFrame | None = None, overrides: dict[str, Rule] | None = None) -> DataFrame:
    """Index rows of the records that ``stored`` has none of: correlation_id (numbered on from the stored ones), entity_type, entity_value, event_record_id, source_type, event_id, provider, time_created_utc, confidence, confidence_weight."""
    # Exact copies of a record give its entities once.
    found = extract(records, overrides=overrides).distinct().withColumnRenamed("record_id", "event_record_id").withColumnRenamed("time", "time_created_utc").withColumnRenamed("weight", "confidence_weight")
    start = 0
    if stored is not None:
        found = found.join(stored.select("event_record_id").where("event_record_id is not null").distinct(), "event_record_id", "left_anti")
        start = stored.agg(F.max("correlation_id")).first()[0] or 0
    found = numbered_rows(found, [F.col("event_record_id"), F.col("seq"), F.col("entity_value")], "n")
    return found.select((F.col("n") + start + 1).alias("correlation_id"), "entity_type", "entity_value", "event_record_id", "source_type", "event_id", "provider", "time_created_utc", "confidence", "confidence_weight")


#: Least weights that an explorer offers.
LEAST_WEIGHTS = {"all": 0.2, "high": 0.95, "medium-high": 0.75, "medium": 0.55}


def annotate(records: DataFrame, record_id: str, links: DataFrame) -> DataFrame:
    """``records`` plus link_delta, link_confidence and link_relation of a link to them, null without one."""
    marks = links.select(F.col("event_record_id").alias("__r"), F.col("time_delta").alias("link_delta"), F.col("confidence").alias("link_confidence"), F.col("relation").alias("link_relation"))
    return records.join(marks, strip_dot0(F.col(f"`{record_id}`").cast("string")) == F.col("__r"), "left").drop("__r")


def rule_table(spark, overrides: dict[str, Rule] | None = None) -> DataFrame:
    """(entity_type, window_s, label, weight), one row a type."""
    return spark.createDataFrame([(t, *rule) for t, rule in link_rules(overrides).items()], "entity_type string, window_s int, label string, rule_weight double")


def linked_to(index: DataFrame, anchor: str, overrides: dict[str, Rule] | None = None, types: list[str] | None = None, least_weight: float = 0.2, trivial: bool = False, limit: int = 100) -> DataFrame:
    """Records linked to one anchor: best link of each (weight, then entity order), by weight and distance.

    ``index``: event_record_id, source_type, event_id, provider, ts (timestamp), entity_type,
    entity_value, confidence, confidence_weight, correlation_id. The anchor's own rows are
    broadcast if they are few, as they should be; an unknown anchor gives no rows.
    """
    rules = F.broadcast(rule_table(index.sparkSession, overrides))
    mine = index.where(F.col("event_record_id") == anchor).groupBy("entity_type", F.lower("entity_value").alias("v")).agg(F.min("correlation_id").alias("entity_order"), F.min("ts").alias("anchor_ts"))
    mine = mine.join(rules, "entity_type", "left").withColumn("window_s", F.coalesce("window_s", F.lit(LINK_DEFAULT[0]))).withColumn("rule_weight", F.coalesce("rule_weight", F.lit(LINK_DEFAULT[2])))
    if types:
        mine = mine.where(F.col("entity_type").isin(types))
    if not trivial:
        mine = mine.where(F.col("rule_weight") >= least_weight)
    # One anchor has one time: the first of its rows.
    mine = mine.withColumn("anchor_ts", F.min("anchor_ts").over(Window.partitionBy(F.lit(1))))
    other = index.where(F.col("event_record_id") != anchor).withColumn("v", F.lower("entity_value"))
    met = other.join(broadcast_if_small(mine, ANCHOR_ROWS), ["entity_type", "v"]).withColumn("delta_s", (F.unix_micros("ts") - F.unix_micros("anchor_ts")) / 1e6).where(F.abs("delta_s") <= F.col("window_s"))
    best = Window.partitionBy("event_record_id").orderBy(F.desc("confidence_weight"), "entity_order", F.abs("delta_s"), "correlation_id")
    out = met.withColumn("n", F.row_number().over(best)).where("n = 1")
    out = out.withColumn("time_delta", delta_text(F.col("delta_s"))).withColumn("relation", F.concat(F.lit("Shared "), F.initcap(F.replace(F.col("entity_type"), F.lit("_"), F.lit(" "))), F.lit(": `"), "entity_value", F.lit("` ("), "time_delta", F.lit(" in "), F.coalesce("source_type", F.lit("None")), F.lit(")")))
    return out.orderBy(F.desc("confidence_weight"), F.abs("delta_s"), "event_record_id").limit(limit).select("event_record_id", "source_type", "event_id", "entity_type", "entity_value", "confidence", "confidence_weight", "delta_s", "time_delta", "relation")


#: Parts of a window that the counts of an entity are cut into.
PARTS = 12


def link_counts(index: DataFrame, types: list[str], overrides: dict[str, Rule] | None = None) -> DataFrame:
    """(event_record_id, entity_type, entity_value, n_linked): for every record, how many other records of the entity lie within its window.

    No pair is listed. The rows up to a time are counted twice for each row, at both ends of
    its window; the difference is the number inside. Times and window ends run through a
    cumulative count per (entity, time block), on top of the count of the blocks before, so
    that an entity of any size is spread over its blocks and the work grows with its rows.
    """
    w_us, rules = F.lit(None).cast("long"), link_rules(overrides)
    for t in types:
        w_us = F.when(F.col("entity_type") == t, F.lit(rules.get(t, LINK_DEFAULT)[0] * 1_000_000)).otherwise(w_us)
    key, row = ["entity_type", "entity_value"], ["event_record_id", "t_us"]
    rows = index.where(F.col("entity_type").isin(types)).select(*key, *row).where("t_us is not null").distinct().withColumn("w", w_us)
    point = lambda at, side, sign: F.struct(at.alias("at"), F.lit(side).alias("side"), F.lit(sign).alias("sign"))
    # At one time: lower ends first, then the rows themselves, then upper ends; so both ends are inclusive.
    points = F.array(point(F.col("t_us") - F.col("w"), 0, -1), point(F.col("t_us"), 1, 0), point(F.col("t_us") + F.col("w"), 2, 1))
    p = rows.withColumn("p", F.explode(points)).select(*key, *row, "p.at", "p.side", "p.sign", F.floor(F.col("p.at") / F.greatest(F.floor(F.col("w") / PARTS), F.lit(1))).alias("block"))
    is_row = F.when(F.col("sign") == 0, 1).otherwise(0)
    run = Window.partitionBy(*key, "block").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = p.groupBy(*key, "block").agg(F.sum(is_row).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counted = p.withColumn("upto", F.sum(is_row).over(run)).where("sign <> 0").join(offsets, [*key, "block"])
    total = counted.groupBy(*key, *row).agg(F.sum(F.col("sign") * (F.col("upto") + F.col("offset"))).alias("n"))
    return total.select("event_record_id", *key, "t_us", (F.col("n") - 1).alias("n_linked"))
