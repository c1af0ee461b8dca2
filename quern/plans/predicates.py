"""What Spark's own planner pushed to a scan, read as key sets.

Predicates are never parsed here: Spark analyses and optimizes the query, and the
filters it gives to the file scan are read from the plan.  What isn't understood with
certainty is left alone; the query's own filter is applied in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame

from .intervals import Interval, KeySet

_FLIPPED = {"EqualTo": "EqualTo", "EqualNullSafe": "EqualNullSafe", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual", "GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual"}


class Unreadable(Exception):
    """An expression that no key set stands for."""


def seq(it) -> Iterator:
    """A Scala collection's elements."""
    i = it.iterator()
    while i.hasNext():
        yield i.next()


@dataclass
class FileEntry:
    path: str
    size: int
    modified: int


@dataclass
class ScanInfo:
    """A file scan of a physical plan."""

    roots: tuple[str, ...]
    format: str
    required: list[str]
    partition_columns: list[str]
    keys: dict[str, KeySet]
    opens_index: set[str]
    files: list[FileEntry] = field(default_factory=list)
    occurrence: str | None = None  # the place in a query's text that names the table, where it is marked


def _literal(e) -> Any:
    kind, value = e.dataType().simpleString(), e.value()
    if value is None:
        return None
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return int(value)
    if kind in ("float", "double"):
        return float(value)
    if kind == "boolean":
        return bool(value)
    if kind == "string":
        return str(value.toString())
    if kind == "binary":
        return bytes(value)
    if kind.startswith("decimal"):
        return Decimal(str(value.toString()))
    if kind == "date":
        return date(1970, 1, 1) + timedelta(days=int(value))
    if kind in ("timestamp", "timestamp_ntz"):
        return datetime(1970, 1, 1, tzinfo=timezone.utc).replace(tzinfo=None) + timedelta(microseconds=int(value))
    raise Unreadable(kind)


def _raw(value: Any, kind: str) -> Any:
    """A catalyst value of an InSet."""
    if value is None:
        return None
    if kind == "string" or kind.startswith("decimal"):
        return str(value.toString()) if kind == "string" else Decimal(str(value.toString()))
    if kind == "date":
        return date(1970, 1, 1) + timedelta(days=int(value))
    if kind in ("timestamp", "timestamp_ntz"):
        return datetime(1970, 1, 1) + timedelta(microseconds=int(value))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        return value
    raise Unreadable(kind)


def _name(e) -> str:
    if e.getClass().getSimpleName() != "AttributeReference":
        raise Unreadable(e.getClass().getSimpleName())
    return e.name()


def read(e) -> tuple[str, KeySet, bool]:
    """``(column, key set, opens)`` of a catalyst expression on one column.

    ``opens``: it may by itself make an index worth a look (a prefix and IS NOT NULL may not).
    """
    kind = e.getClass().getSimpleName()
    if kind in ("And", "Or"):
        a, left, opens_a = read(e.left())
        b, right, opens_b = read(e.right())
        if a != b:
            raise Unreadable("two columns")
        return a, (left & right if kind == "And" else left | right), (opens_a or opens_b) if kind == "And" else (opens_a and opens_b)
    if kind in _FLIPPED:
        left, right = e.left(), e.right()
        if left.getClass().getSimpleName() == "Literal":
            left, right, kind = right, left, _FLIPPED[kind]
        if right.getClass().getSimpleName() != "Literal":
            raise Unreadable("no literal")
        name, value = _name(left), _literal(right)
        if value is None:
            return name, KeySet.only_null() if kind == "EqualNullSafe" else KeySet(), True
        keys = {
            "EqualNullSafe": lambda: KeySet.points([value]),
            "EqualTo": lambda: KeySet.points([value]),
            "LessThan": lambda: KeySet.of([Interval(None, value, True, False)]),
            "LessThanOrEqual": lambda: KeySet.of([Interval(None, value)]),
            "GreaterThan": lambda: KeySet.of([Interval(value, None, False, True)]),
            "GreaterThanOrEqual": lambda: KeySet.of([Interval(value, None)]),
        }[kind]()
        return name, keys, True
    if kind == "In":
        values = list(seq(e.list()))
        if any(v.getClass().getSimpleName() != "Literal" for v in values):
            raise Unreadable("no literal")
        return _name(e.value()), KeySet.points(map(_literal, values)), True
    if kind == "InSet":
        of = e.child().dataType().simpleString()
        return _name(e.child()), KeySet.points(_raw(v, of) for v in seq(e.hset())), True
    if kind == "IsNull":
        return _name(e.child()), KeySet.only_null(), True
    if kind == "IsNotNull":
        return _name(e.child()), KeySet.not_null(), False
    if kind == "StartsWith":
        if e.right().getClass().getSimpleName() != "Literal":
            raise Unreadable("no literal")
        prefix = _literal(e.right())
        return _name(e.left()), KeySet() if prefix is None else KeySet.prefix(prefix), False
    raise Unreadable(kind)


def key_sets(filters) -> tuple[dict[str, KeySet], set[str]]:
    """The intersection of the readable conjuncts by column, and the columns that open an index."""
    keys: dict[str, KeySet] = {}
    opens: set[str] = set()
    for f in seq(filters):
        try:
            name, found, opening = read(f)
        except Unreadable:
            continue
        keys[name] = keys[name] & found if name in keys else found
        if opening:
            opens.add(name)
    return keys, opens


def _walk(plan) -> Iterator:
    yield plan
    for child in seq(plan.children()):
        yield from _walk(child)


def _option(relation, key: str) -> str | None:
    found = relation.options().get(key)
    return found.get() if found.isDefined() else None


def scans(df: DataFrame) -> list[ScanInfo]:
    """The Parquet and ORC file scans of ``df``'s physical plan, with the files left by partition pruning."""
    found = []
    plan = df._jdf.queryExecution().sparkPlan()
    for node in _walk(plan):
        if node.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        relation = node.relation()
        kind = relation.fileFormat().toString().lower()
        if kind not in ("parquet", "orc"):
            continue
        keys, opens = key_sets(node.dataFilters())
        files = []
        static = [f for f in seq(node.partitionFilters()) if "dynamicpruning" not in f.toString().lower()]
        jvm = df.sparkSession.sparkContext._jvm
        chosen = jvm.java.util.ArrayList()
        for f in static:
            chosen.add(f)
        to_seq = jvm.org.apache.spark.api.python.PythonUtils.toSeq
        for directory in seq(relation.location().listFiles(to_seq(chosen), to_seq(jvm.java.util.ArrayList()))):
            for f in seq(directory.files()):
                files.append(FileEntry(f.getPath().toString(), int(f.getLen()), int(f.getModificationTime())))
        found.append(
            ScanInfo(
                tuple(p.toString() for p in seq(relation.location().rootPaths())),
                kind,
                [f.name() for f in seq(node.requiredSchema())],
                [f.name() for f in seq(relation.partitionSchema())],
                keys,
                opens,
                files,
                _option(relation, "quern.occurrence"),
            )
        )
    return found


def relation_of(df: DataFrame):
    """The one file relation that ``df`` is nothing but; None otherwise.

    ``(roots, format, partition columns)``.
    """
    leaves = list(seq(df._jdf.queryExecution().analyzed().collectLeaves()))
    if len(leaves) != 1 or leaves[0].getClass().getSimpleName() != "LogicalRelation":
        return None
    relation = leaves[0].relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString().lower() not in ("parquet", "orc"):
        return None
    return tuple(p.toString() for p in seq(relation.location().rootPaths())), relation.fileFormat().toString().lower(), [f.name() for f in seq(relation.partitionSchema())]
