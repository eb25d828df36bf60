"""Templates of repetitive messages, with every record traceable to its template.

:func:`mine` clusters by a fixed-depth parse tree (as published for online log parsing). Two
steps make it a distributed job. Distinct masked texts are counted first and each visits the
tree once, in order of first appearance; a text that comes again therefore stays with its
first cluster, where a strictly sequential run might move it to one that has grown since. And
as the tree's first level is the number of tokens, texts of different lengths never meet:
each (channel, token count) streams through a tree of its own. Trees can go on where they
stopped (:func:`walk`): their clusters are a table.
"""

from __future__ import annotations

import configparser
import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracewright.functions.text import capitalize, collapse, family_label, mask, or_null, sequence_text, strip_dot0
from tracewright.operators.order import numbered_within
from tracewright.schema import LEVEL_RANK, resolve_columns
from tracewright.session import broadcast_if_small, cut

WILD = "<*>"


@dataclass
class Settings:
    """Similarity that joins a cluster, depth of the tree, children of a node, clusters of a tree (None: any number), and whether tokens with figures are wild cards to the tree."""

    similarity: float = 0.4
    depth: int = 4
    max_children: int = 100
    max_clusters: int | None = 10_000
    numbers_are_wild: bool = True

    @classmethod
    def from_ini(cls, path: str) -> Settings:
        """Settings of a file with a section ``DRAIN``; what it does not name keeps its default."""
        ini = configparser.ConfigParser(interpolation=None)
        with open(path, encoding="utf-8") as f:
            ini.read_file(f)
        own, at = cls(), ini["DRAIN"] if ini.has_section("DRAIN") else {}
        return cls(
            float(at.get("sim_th", own.similarity)), int(at.get("depth", own.depth)), int(at.get("max_children", own.max_children)), int(at.get("max_clusters", own.max_clusters)),
            str(at.get("parametrize_numeric_tokens", own.numbers_are_wild)).strip().lower() in ("true", "1", "yes", "on"),
        )


@dataclass
class Cluster:
    tokens: list[str]
    first: int
    opener: str
    keys: list[str]


@dataclass
class _Node:
    below: dict = field(default_factory=dict)
    clusters: list = field(default_factory=list)


class Tree:
    """Parse tree for texts of one length; the root already stands for the token count.

    Beyond ``max_clusters`` the cluster that was joined longest ago leaves the tree: texts it
    has keep it, but no other joins it any more.
    """

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.root = _Node()
        self.clusters: list[Cluster] = []
        self.live: OrderedDict[int, None] = OrderedDict()  # least recently joined first

    def _key(self, token: str) -> str:
        return WILD if self.settings.numbers_are_wild and any(ch.isdigit() for ch in token) else token

    def _path(self, tokens: list[str]) -> list[str]:
        """Keys from the root down, for a new cluster."""
        node, keys = self.root, []
        for token in tokens[: max(0, self.settings.depth - 2)]:
            key = self._key(token)
            # One place is kept for the wild card once a node runs full.
            if node is not None and key not in node.below and key != WILD and len(node.below) + (WILD not in node.below) >= self.settings.max_children:
                key = WILD
            keys.append(key)
            node = node.below.get(key) if node is not None else None
        return keys

    def _leaf(self, tokens: list[str]) -> _Node | None:
        node = self.root
        for token in tokens[: max(0, self.settings.depth - 2)]:
            node = node.below.get(self._key(token)) or node.below.get(WILD)
            if node is None:
                return None
        return node

    def put(self, cluster: Cluster) -> int:
        """Add a cluster at its keys, as the one joined last; number of the cluster."""
        node = self.root
        for key in cluster.keys:
            node = node.below.setdefault(key, _Node())
        n = len(self.clusters)
        self.clusters.append(cluster)
        node.clusters.append(n)
        self.live[n] = None
        if self.settings.max_clusters is not None and len(self.live) > self.settings.max_clusters:
            self.live.popitem(last=False)
        return n

    def add(self, tokens: list[str], seq: int, text: str = "") -> int:
        """Number of the cluster that the text joins or opens."""
        leaf = self._leaf(tokens)
        best, score = None, (-1.0, -1)
        for n in leaf.clusters if leaf else []:
            if n not in self.live:
                continue
            mine = self.clusters[n].tokens
            wild = sum(a == WILD for a in mine)
            same = sum(a == b for a, b in zip(mine, tokens) if a != WILD)
            s = (same / len(mine) if mine else 1.0, wild)
            if s > score:
                best, score = n, s
        if best is not None and score[0] >= self.settings.similarity:
            c = self.clusters[best]
            c.tokens = [a if a == b else WILD for a, b in zip(c.tokens, tokens)]
            self.live.move_to_end(best)
            return best
        return self.put(Cluster(list(tokens), seq, text, self._path(tokens)))


def log_text(message: Column, payload: Column, event_id: Column, provider: Column) -> Column:
    """What is mined: message and payload, either of them, or a stand-in from id and provider."""
    m, p = F.nullif(F.trim(message), F.lit("")), F.nullif(F.trim(payload), F.lit(""))
    both = F.when(m != p, F.concat(m, F.lit(" | Payload: "), p))
    return F.coalesce(both, m, p, F.concat(F.lit("EventID "), F.coalesce(event_id, F.lit("0")), F.lit(" from "), F.coalesce(provider, F.lit("Unknown"))))


def prepared(df: DataFrame, seq: Column, payload_too: bool = True) -> DataFrame:
    """record_id, seq, channel, provider, event_id, level, time, masked: what templating needs of the records, whatever their column names."""
    at = {k: F.col(f"`{c}`") for k, c in resolve_columns(df.columns).items()}
    none = F.lit(None).cast("string")
    col = lambda n: at.get(n, none)
    text = log_text(col("message"), col("event_data") if payload_too else none, col("event_id"), col("provider"))
    return df.select(
        col("record_id").alias("record_id"), seq.cast("long").alias("seq"), capitalize(F.coalesce(or_null(col("channel")), F.lit("Unknown"))).alias("channel"), F.coalesce(or_null(col("provider")), F.lit("Unknown")).alias("provider"),
        F.coalesce(or_null(strip_dot0(col("event_id"))), F.lit("0")).alias("event_id"), capitalize(F.coalesce(or_null(col("level")), F.lit("Information"))).alias("level"), F.trim(col("time")).alias("time"), mask(collapse(text)).alias("masked"),
    )


#: What a tree remembers of a cluster: where it hangs, its text now, and its place in the order of joining (null: it has left the tree).
CLUSTERS = "channel string, n_tokens int, opener string, opened long, keys array<string>, template_string string, used int"
_WALKED = f"is_text boolean, masked string, {CLUSTERS}"
#: More distinct masked texts than this are joined to the records by shuffle.
BROADCAST_TEXTS = 200_000


def walk(texts: DataFrame, clusters: DataFrame | None = None, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Send new texts (channel, masked, first) through the trees that ``clusters`` (see ``CLUSTERS``) left behind.

    Gives (channel, masked, opener, opened) of each text and the clusters of all trees that
    got a text. A cluster is known by the text that opened it. Texts of a tree stream through
    in order of first appearance, behind its clusters.
    """
    settings = settings or Settings()
    n = F.size(F.split("masked", " ")).alias("n_tokens")
    rows = texts.select(F.lit(True).alias("is_text"), "masked", "channel", n, F.col("masked").alias("opener"), F.col("first").alias("opened"), F.lit(None).cast("array<string>").alias("keys"), F.col("masked").alias("template_string"), F.lit(None).cast("int").alias("used"))
    if clusters is not None:
        touched = rows.select("channel", "n_tokens").distinct()
        old = clusters.join(touched, ["channel", "n_tokens"], "left_semi")
        rows = rows.unionByName(old.withColumns({"is_text": F.lit(False), "masked": F.lit(None).cast("string")}))
    # Clusters come first, in the order in which they were opened; then texts.
    rows = rows.select(*[c.split()[0] for c in _WALKED.split(", ")]).repartition("channel", "n_tokens").sortWithinPartitions("channel", "n_tokens", "is_text", "opened", "opener")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, held, order = None, None, [], {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _WALKED.split(", ")])

        def done() -> Iterator[pa.RecordBatch]:
            used = {c: i for i, c in enumerate(tree.live)}
            found = [(True, m, *now, tree.clusters[c].opener, tree.clusters[c].first, None, None, None) for m, c in held]
            found += [(False, None, *now, c.opener, c.first, c.keys, " ".join(c.tokens), used.get(i)) for i, c in enumerate(tree.clusters)]
            for k in range(0, len(found), 20_000):
                yield out(found[k : k + 20_000])

        def settle() -> None:
            """Bring restored clusters into the order in which they were joined; those that had left stay outside."""
            tree.live = OrderedDict.fromkeys(sorted((c for c in order if order[c] is not None), key=order.get))

        for b in batches:
            for is_text, masked, channel, n_tokens, opener, opened, keys, text, used in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                if (channel, n_tokens) != now:
                    if tree is not None:
                        yield from done()
                    now, tree, held, order = (channel, n_tokens), Tree(settings), [], {}
                if not is_text:
                    order[tree.put(Cluster(text.split(" "), opened, opener, keys))] = used
                    continue
                if order:
                    settle()
                    order = {}
                held.append((masked, tree.add(masked.split(" "), opened, masked)))
        if tree is not None:
            yield from done()

    walked = cut(rows.mapInArrow(run, _WALKED))
    return walked.where("is_text").select("channel", "masked", "opener", "opened"), walked.where("not is_text").drop("is_text", "masked")


def _text_key(masked: Column) -> list[Column]:
    """128 bits that stand for a text where rows are moved."""
    return [F.xxhash64(masked).alias("__h1"), F.xxhash64(F.lit(1), masked).alias("__h2")]


def mine(records: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``records`` (as from :func:`prepared`, exact copies once) plus cluster (number within the channel, by first appearance) and template_string, without the masked text.

    Texts are moved once, to their tree. Records find their cluster by a key of the text.
    """
    found, clusters = walk(records.groupBy("channel", "masked").agg(F.min("seq").alias("first")), None, settings)
    numbered = numbered_within(clusters.select("channel", "opener", "opened", "template_string"), "channel", ["opened", "opener"], "cluster").drop("opened")
    found = found.join(numbered.drop("template_string"), ["channel", "opener"]).select("channel", *_text_key(F.col("masked")), "cluster")
    small = records.select(*[c for c in records.columns if c != "masked"], *_text_key(F.col("masked")))
    # A frequent text is the hottest key of a log: where the texts are few they go to the records.
    mined = small.join(broadcast_if_small(found, BROADCAST_TEXTS), ["channel", "__h1", "__h2"]).drop("__h1", "__h2").distinct()
    return mined.join(broadcast_if_small(numbered.select("channel", "cluster", "template_string"), BROADCAST_TEXTS), ["channel", "cluster"])


def signatures(records: DataFrame) -> DataFrame:
    """``records`` plus cluster and template_string, one cluster for each masked text of a channel: templating without a tree, for checks and first looks."""
    texts = records.groupBy("channel", "masked").agg(F.min("seq").alias("opened"))
    texts = numbered_within(texts, "channel", ["opened", "masked"], "cluster").drop("opened")
    return records.join(texts, ["channel", "masked"]).withColumn("template_string", F.col("masked"))


def template_id(channel: Column, event_id: Column, cluster: Column) -> Column:
    """``TPL_SECURITY_4625_0001``."""
    bare = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    event = F.when(bare(event_id) == "", F.lit("0")).otherwise(bare(event_id))
    return F.concat(F.lit("TPL_"), F.upper(bare(channel)), F.lit("_"), event, F.lit("_"), F.when(cluster < 10_000, sequence_text(cluster)).otherwise(cluster.cast("string")))


def instances(mined: DataFrame) -> DataFrame:
    """instance_id, event_record_id, template_id, time_created_utc: one row a record."""
    return mined.select(F.col("seq").alias("instance_id"), F.col("record_id").alias("event_record_id"), template_id(F.col("channel"), F.col("event_id"), F.col("cluster")).alias("template_id"), F.col("time").alias("time_created_utc"))


def _rank(level: Column) -> Column:
    out = F.lit(1)
    for name, n in LEVEL_RANK.items():
        out = F.when(level == name, F.lit(n)).otherwise(out)
    return out


def rollup(mined: DataFrame) -> DataFrame:
    """One row a template: provider of the first record, highest level, last text, first and last time, count."""
    m = mined.withColumn("template_id", template_id(F.col("channel"), F.col("event_id"), F.col("cluster")))
    seen = F.nullif(F.col("time"), F.lit(""))
    return m.groupBy("template_id").agg(
        F.min("channel").alias("source_type"), F.min_by("provider", "seq").alias("provider"), F.min("event_id").alias("event_id"), F.max_by("level", F.struct(_rank(F.col("level")), -F.col("seq"))).alias("level"),
        F.max_by("template_string", "seq").alias("template_string"), F.min(seen).alias("first_seen_utc"), F.max(seen).alias("last_seen_utc"), F.count(F.lit(1)).alias("total_count"),
    )


def merge(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Stored and new roll-ups as one: counts add up, times widen, the higher level stays, the newer text wins."""
    both = stored.withColumn("age", F.lit(0)).unionByName(added.withColumn("age", F.lit(1)))
    return both.groupBy("template_id").agg(
        F.min_by("source_type", "age").alias("source_type"), F.min_by("provider", "age").alias("provider"), F.min_by("event_id", "age").alias("event_id"), F.max_by("level", F.struct(_rank(F.col("level")), -F.col("age"))).alias("level"),
        F.max_by("template_string", "age").alias("template_string"), F.min("first_seen_utc").alias("first_seen_utc"), F.max("last_seen_utc").alias("last_seen_utc"), F.sum("total_count").alias("total_count"),
    )


def integrity(records: DataFrame, instances_: DataFrame, templates: DataFrame) -> DataFrame:
    """One row: are all records mapped, and do the templates' counts add up to them?"""
    one = lambda df, what, name: df.agg(what.alias(name))
    parts = [one(records, F.count(F.lit(1)), "v").withColumn("k", F.lit("canonical_count")), one(instances_, F.count(F.lit(1)), "v").withColumn("k", F.lit("instance_count")), one(templates, F.coalesce(F.sum("total_count"), F.lit(0)), "v").withColumn("k", F.lit("template_sum_count")), one(templates, F.count(F.lit(1)), "v").withColumn("k", F.lit("template_count"))]
    flat = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    names = ["canonical_count", "instance_count", "template_sum_count", "template_count"]
    row = flat.agg(*[F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names])
    return row.withColumn("integrity_valid", (F.col("canonical_count") == F.col("instance_count")) & (F.col("canonical_count") == F.col("template_sum_count")))


def unmapped(records: DataFrame, record_key: str, instances_: DataFrame, instance_key: str = "instance_id") -> DataFrame:
    """Records without an instance yet."""
    keys = instances_.select(F.col(instance_key).alias("__k")).where("__k is not null").distinct()
    return records.join(keys, F.col(f"`{record_key}`") == F.col("__k"), "left_anti")


def records_of(records: DataFrame, record_key: str, instances_: DataFrame, ids: list[str], instance_key: str = "instance_id") -> DataFrame:
    """Full rows of the given templates, each with its template_id: an equi-join on the row key, so equal record ids do not multiply."""
    chosen = instances_.where(F.col("template_id").isin(ids)).select(F.col(instance_key).alias("__k"), "template_id")
    return records.join(chosen, F.col(f"`{record_key}`") == F.col("__k")).drop("__k")


def representative(templates: DataFrame, with_family_key: bool = True) -> DataFrame:
    """template_id, text, total_count: one text to embed a template, most frequent first."""
    level = capitalize(F.coalesce(F.col("level"), F.lit("Information")))
    family = family_label(F.col("event_id"), F.col("source_type"))
    event = F.concat(F.lit("[EventID: "), "event_id", F.lit("] [Family: "), family, F.lit("]")) if with_family_key else F.concat(F.lit("[EventID: "), "event_id", F.lit(" - "), family, F.lit("]"))
    text = F.concat(F.lit("[Source: "), "source_type", F.lit("] [Level: "), level, F.lit("] "), event, F.lit(" [Provider: "), "provider", F.lit("] Template: "), "template_string")
    return templates.select("template_id", text.alias("text"), "total_count").orderBy(F.desc("total_count"), "template_id")


def variables(template: Column, body: Column) -> Column:
    """JSON object of what stands in ``body`` for the wild cards and masks of ``template``, by position; ``{}`` if it does not fit."""

    @pandas_udf("string")
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([extracted(a, b) for a, b in zip(t, s)])

    return run(template, body)


@lru_cache(maxsize=65536)
def _pattern(template: str) -> re.Pattern:
    return re.compile("(.+?)".join(re.escape(p) for p in re.split(r"<\*>|<[A-Z]+>", template)), re.S)


def extracted(template: str | None, body: str | None) -> str:
    m = _pattern(" ".join(template.split())).fullmatch(" ".join(body.split())) if template is not None and body is not None else None
    return json.dumps({str(i): v for i, v in enumerate(m.groups())} if m else {}, ensure_ascii=False)
