"""Nested JSON payloads to flat, linked tables by columnar shredding.

:func:`shred` dissects each payload into columns, one per leaf path, and writes for every
column the sequence of repetition and definition levels (and values) of the record.
:func:`rebuild_nodes` and :func:`rebuild_fields` get the tables of the repeated objects
back from nothing but those level sequences.

Model. A path is the payload's name followed by ``.key`` and ``[]`` steps. For each
place where a value of the path could stand, its column has one entry:

* repetition level: how many ``[]`` steps deep the step is that repeats (0: first of the record);
* definition level: how many steps of the path are there, where an array element that is an
  object counts one more, and a scalar at the end (not null) as well.

So the column of a leaf tells of every repeated object above it whether it is there, and of
all columns below a repeated object the first one stands for it. A repeated object without
any leaf in the record has a column of its own, which ends at the object. Columns that a
record does not have at all are left out.

Defined results: null, empty and invalid payloads (also ``NaN`` and cut-off text) give no
rows; a string that holds an object or array is read as that value; of equal keys in one
object the last counts; nesting may be as deep as ``DEEPEST`` steps, deeper payloads count as
invalid (their paths alone would take gigabytes); records without id keep a null id; exact
copies count once; other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

import json
import json.scanner
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = "record_id string, path string, max_def int, nodes array<int>, rep array<int>, def array<int>, value array<string>"
#: Between the steps of a path: the payload's name, ``.key``, ``[]``; at the end ``$`` for scalars that are array elements themselves, ``{}`` for objects without leaves.
SEP = "\x1f"
DEEPEST = 100_000
_OPEN = {"{": "}", "[": "]"}
_INTS = pa.list_(pa.int32())
_ARROW = pa.schema([("record_id", pa.string()), ("path", pa.string()), ("max_def", pa.int32()), ("nodes", _INTS), ("rep", _INTS), ("def", _INTS), ("value", pa.list_(pa.string()))])


def _refuse(name: str) -> None:
    raise ValueError(name)


_fast = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_refuse)
# The same without nested C calls, for what is too deep for them.
_deep = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_refuse)
_deep.scan_once = json.scanner.py_make_scanner(_deep)


def _read(text: str) -> object:
    try:
        return _fast.decode(text)
    except RecursionError:
        pass
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 4 * DEEPEST))
    try:
        return _deep.decode(text)
    finally:
        sys.setrecursionlimit(before)


def read_json(text: str | None) -> object:
    """The value of a payload; a string that holds an object or array, at any depth of encoding, counts as it. None if there is none."""
    v: object = text
    while isinstance(v, str):
        t = v.strip()
        if len(t) < 2 or not (t[-1] == _OPEN.get(t[0]) or t[0] == t[-1] == '"'):
            return None
        try:
            v = _read(t)
        except (ValueError, RecursionError):
            return None
    return v


def _held(text: str) -> object:
    """The object or array that a string inside a payload holds, else the string itself."""
    t = text.strip()
    if len(t) >= 2 and t[-1] == _OPEN.get(t[0]):
        try:
            return _read(t)
        except (ValueError, RecursionError):
            pass
    return text


class _Step:
    """A place in the record's own schema; ``depth``: definition level of a value there."""

    __slots__ = ("path", "keys", "items", "item", "leaf", "objects", "group", "rep", "depth", "scalars", "values", "places")

    def __init__(self, path: str, rep: int, depth: int, item: bool = False):
        self.path, self.rep, self.depth, self.item = path, rep, depth, item
        self.leaf = self.objects = self.group = False
        self.keys: dict[str, _Step] = {}
        self.items: _Step | None = None
        self.scalars: list[tuple[int, int]] = []  # entries of the leaf column
        self.values: list[str | None] = []
        self.places: list[tuple[int, int]] = []  # entries of the column of an object without leaves


def _schema(v: object, at: _Step) -> tuple[object, bool]:
    """Grow the schema below ``at`` by ``v``; gives ``v`` with held values read, and whether anything of it is to be shredded."""
    if isinstance(v, str):
        v = _held(v)
    if isinstance(v, dict):
        at.objects = True
        kept = {}
        for k, x in v.items():
            step = at.keys.get(k)
            if step is None:
                step = _Step(f"{at.path}{SEP}.{k.replace(SEP, ' ')}", at.rep, at.depth + 1 + at.item)
            x, wanted = _schema(x, step)
            if wanted:
                kept[k] = x
                at.keys[k] = step
        return kept, bool(kept)
    if isinstance(v, list):
        if at.items is None:
            at.items = _Step(f"{at.path}{SEP}[]", at.rep + 1, at.depth + 1, True)
        return [_schema(x, at.items)[0] for x in v], True
    if v is not None:
        at.leaf = True
        return v, True
    return v, False


def _settle(at: _Step) -> bool:
    """Whether there is a column at or below ``at``; repeated objects without one below get their own."""
    below = False
    for s in at.keys.values():
        below = _settle(s) or below
    at.group = at.item and at.objects and not below
    listed = at.items is not None and _settle(at.items)
    return at.leaf or at.group or below or listed


def _pad(at: _Step, rep: int, depth: int) -> None:
    """Entries of the paths at and below a place that is not there."""
    if at.group:
        at.places.append((rep, depth))
    if at.leaf:
        at.scalars.append((rep, depth))
        at.values.append(None)
    for s in at.keys.values():
        _pad(s, rep, depth)
    if at.items is not None:
        _pad(at.items, rep, depth)


def _write(v: object, at: _Step, rep: int) -> None:
    """Entries of ``v``, whose place is there."""
    is_object = isinstance(v, dict)
    if at.group:
        at.places.append((rep, at.depth + is_object))
    if at.leaf:
        scalar = v is not None and not is_object and not isinstance(v, list)
        at.scalars.append((rep, at.depth + scalar))
        at.values.append((v if isinstance(v, str) else json.dumps(v)) if scalar else None)
    for k, s in at.keys.items():
        if is_object and k in v:
            _write(v[k], s, rep)
        else:
            _pad(s, rep, at.depth + (at.item and is_object))
    if at.items is not None:
        if isinstance(v, list) and v:
            for j, x in enumerate(v):
                _write(x, at.items, at.items.rep if j else rep)
        else:
            _pad(at.items, rep, at.depth)


def _columns(top: _Step) -> Iterator[tuple[str, int, list[int], list, list | None]]:
    """(path, highest definition level, nodes, entries, values) of each column.

    ``nodes``: for each ``[]`` step of the path the definition level from which on its
    element is an object, if this column stands for that object, else 0.
    """
    told: set[int] = set()
    todo = [(top, None)]  # with the repeated objects that the path goes through, as a linked list
    while todo:
        at, through = todo.pop()
        own = (through, at) if at.item else through
        columns = []
        if at.group:
            columns.append((at.path + SEP + "{}", own, at.places, None))
        if at.leaf:
            columns.append((at.path + (SEP + "$" if at.item else ""), through, at.scalars, at.values))
        for path, chain, entries, values in columns:
            nodes = [0] * at.rep
            while chain is not None:
                chain, step = chain
                if id(step) in told:
                    break  # then those above are told as well
                told.add(id(step))
                nodes[step.rep - 1] = step.depth + 1
            yield path, at.depth + 1, nodes, entries, values
        if at.items is not None:
            todo.append((at.items, through))
        todo.extend((s, own) for s in reversed(at.keys.values()))


def shred_value(v: object, root: str) -> list[tuple[str, int, list[int], list[int], list[int], list[str | None] | None]]:
    """(path, highest definition level, nodes, repetition levels, definition levels, values) of each column of one value."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 4 * DEEPEST))
    try:
        top = _Step(root, 0, 0)
        v, _ = _schema(v, top)
        _settle(top)
        _write(v, top, 0)
    finally:
        sys.setrecursionlimit(before)
    return [(path, most, nodes, [r for r, _ in e], [d for _, d in e], val) for path, most, nodes, e, val in _columns(top)]


def shred(df: DataFrame, record_id: str, payloads: list[str], nodes_only: bool = False) -> DataFrame:
    """Level sequences of all payloads: one row per record, payload and column (see ``LEVELS``).

    ``nodes_only`` writes, of all columns, those that stand for a repeated object, without
    their values; payloads without any array are then left out before they reach Python.
    """
    may = lambda c: F.contains(c, F.lit("[")) | F.contains(c, F.lit("\\u005"))
    some = may if nodes_only else (lambda c: c.isNotNull())
    keep = None
    for p in payloads:
        c = F.coalesce(some(F.col(f"`{p}`")), F.lit(False))
        keep = c if keep is None else keep | c
    src = df.where(keep).select(F.col(f"`{record_id}`").cast("string").alias("r"), *[F.when(some(F.col(f"`{p}`")), F.col(f"`{p}`")).alias(f"p{i}") for i, p in enumerate(payloads)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)
            out.clear()
            return rows

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                for name, text in zip(payloads, row[1:]):
                    v = read_json(text)
                    if not isinstance(v, (dict, list)):
                        continue
                    try:
                        found = shred_value(v, name)
                    except RecursionError:
                        continue
                    for path, top, nodes, rep, de, val in found:
                        if nodes_only and not any(nodes):
                            continue
                        texts = None if val is None or nodes_only else [x if x is None else x.encode("utf-8", "replace").decode() for x in val]
                        out.append((row[0], path.encode("utf-8", "replace").decode(), top, nodes, rep, de, texts))
                if len(out) > 20_000:
                    yield batch()
            if out:
                yield batch()

    return src.mapInArrow(run, LEVELS)


def indices(rep: np.ndarray, deepest: int) -> np.ndarray:
    """Index of each entry in each of the ``deepest`` enclosing arrays, from repetition levels alone."""
    out = np.zeros((len(rep), deepest), np.int64)
    for j in range(1, deepest + 1):
        count = np.cumsum(rep == j)
        out[:, j - 1] = count - np.maximum.accumulate(np.where(rep < j, count, 0))
    return out


class _Plan:
    """How the node paths of one column are put together from element indices."""

    def __init__(self, path: str):
        steps = path.split(SEP)
        self.shown = [x.replace("%", "%%") if x != "[]" else "[%d]" for x in steps]
        self.arrays = [i for i, x in enumerate(steps) if x == "[]"]
        # Array elements that are objects, or scalars of their own.
        self.owners = [i for i in self.arrays if i + 1 < len(steps) and steps[i + 1] != "[]"]
        cut = self.owners[-1] if self.owners else 0
        self.owner = self._upto(cut)
        self.field = "".join(x for x in steps[cut + 1 :] if x != "$").lstrip(".")
        self.made: dict[int, tuple] = {}

    def _upto(self, i: int) -> tuple[str, int]:
        """(format, number of indices) of the path up to a step."""
        return "".join(self.shown[: i + 1]), sum(a <= i for a in self.arrays)

    def node(self, level: int) -> tuple[tuple[str, int], tuple[str, int]]:
        """Formats of the element at an array level and of the nearest object around it that is an element, else of the payload."""
        if level not in self.made:
            i = self.arrays[level - 1]
            self.made[level] = self._upto(i), self._upto(max((o for o in self.owners if o < i), default=0))
        return self.made[level]


def _rebuild(levels: DataFrame, fields: bool) -> DataFrame:
    """Columns of ``levels``: record_id, path, max_def, nodes, rep, def (and value for fields)."""
    shown = "record_id string, node_path string, " + ("field string, value string" if fields else "parent_path string")
    names = ["record_id", "node_path", *(("field", "value") if fields else ("parent_path",))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[str, _Plan] = {}
        for b in batches:
            if not b.num_rows:
                continue
            paths = b.column(1).to_pylist()
            mine = [plans.get(p) or plans.setdefault(p, _Plan(p)) for p in paths]
            deepest = max(len(p.arrays) for p in mine)
            rep, de = b.column(4).flatten().to_numpy(), b.column(5).flatten().to_numpy()
            row = np.repeat(np.arange(len(paths)), np.diff(b.column(4).offsets.to_numpy()))
            at = indices(rep, deepest)
            put = lambda form, i: form[0] % tuple(i[: form[1]])
            if fields:
                hit = np.flatnonzero(de == b.column(2).to_numpy()[row])
                each = [mine[r] for r in row[hit].tolist()]
                owners = [put(p.owner, i) for p, i in zip(each, at[hit].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[hit])), pa.array(owners, pa.string()), pa.array([p.field for p in each], pa.string()), b.column(6).flatten().take(pa.array(hit))], names)
                continue
            need = np.zeros((len(paths), deepest), np.int64)
            for r, n in enumerate(b.column(3).to_pylist()):
                need[r, : len(n)] = n
            for level in range(1, deepest + 1):
                # An element begins where nothing deeper than its array repeats.
                hit = np.flatnonzero((need[row, level - 1] > 0) & (rep <= level) & (de >= need[row, level - 1]))
                if len(hit):
                    each = [mine[r].node(level) for r in row[hit].tolist()]
                    i = at[hit].tolist()
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[hit])), pa.array([put(p[0], x) for p, x in zip(each, i)], pa.string()), pa.array([put(p[1], x) for p, x in zip(each, i)], pa.string())], names)

    return levels.mapInArrow(run, shown)


def rebuild_nodes(levels: DataFrame) -> DataFrame:
    """(record_id, node_path, parent_path) of every object that is an array element; exact copies of a record count once."""
    standing = levels.where(F.exists("nodes", lambda n: n > 0))
    return _rebuild(standing.select("record_id", "path", "max_def", "nodes", "rep", "def").distinct(), False)


def rebuild_fields(levels: DataFrame) -> DataFrame:
    """(record_id, node_path, field, value) of every scalar: node_path is the nearest array element (else the payload), field the keys from there; a scalar element is its own node, with an empty field. Exact copies of a record count once."""
    return _rebuild(levels.where(~F.endswith("path", F.lit("{}"))).distinct(), True)


def child_objects(df: DataFrame, record_id: str, payloads: list[str]) -> DataFrame:
    """Child tables' keys of all payloads: shredding to leaf columns, then reconstruction from the levels of those that stand for repeated objects."""
    return rebuild_nodes(shred(df, record_id, payloads, nodes_only=True))


def child_fields(df: DataFrame, record_id: str, payloads: list[str]) -> DataFrame:
    """Child tables' contents of all payloads."""
    return rebuild_fields(shred(df, record_id, payloads))
