"""Where a statement names tables: positions from Spark's own parser, never from a search of the text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .predicates import seq

_EXPLAIN = re.compile(r"\s*EXPLAIN(\s+(EXTENDED|CODEGEN|COST|FORMATTED))?\s+", re.I)
#: Statements that run as soon as they are given, and whose query is their last child.
_EAGER = ("InsertIntoStatement", "CreateTableAsSelect", "ReplaceTableAsSelect")


@dataclass(frozen=True)
class Occurrence:
    """A table name at ``begin`` to ``end`` of the text; ``aliased`` if the query gives it another."""

    name: str
    begin: int
    end: int
    aliased: bool


@dataclass(frozen=True)
class Parsed:
    """A statement: from ``query`` on it is a plain query; ``found`` are its tables, in the order of the text."""

    query: int
    eager: bool
    found: list[Occurrence]


def _walk(node, parent: str, shadowed: frozenset[str]) -> Iterator[tuple]:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        # A common table expression sees those before it, and the query all of them.
        for named in seq(node.cteRelations()):
            yield from _walk(named._2(), kind, shadowed)
            shadowed = shadowed | {named._1().lower()}
    if kind == "UnresolvedRelation":
        parts = list(seq(node.multipartIdentifier()))
        if len(parts) > 1 or parts[0].lower() not in shadowed:
            yield node, parts, parent == "SubqueryAlias"
    for below in (node.children(), node.subqueries()):
        for child in seq(below):
            yield from _walk(child, kind, shadowed)


def parse(spark: SparkSession, text: str) -> Parsed | None:
    """The tables that a query names, also within EXPLAIN, INSERT and CREATE TABLE AS; None for any other statement."""
    explain = _EXPLAIN.match(text)
    start = explain.end() if explain else 0
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text[start:])
    kind, query, eager = plan.getClass().getSimpleName(), start, False
    if kind in _EAGER:
        plan, eager = list(seq(plan.children()))[-1], True
        query = start + plan.origin().startIndex().get()
    elif kind.endswith("Command") or kind.endswith("Statement"):
        return None
    found = []
    for node, parts, aliased in _walk(plan, "", frozenset()):
        begin, end = (start + x().get() for x in (node.origin().startIndex, node.origin().stopIndex))
        # Beyond the basic plane the parser counts otherwise than Python: such a text is left alone.
        if re.sub(r"[`\s]", "", text[begin : end + 1]) != ".".join(parts).replace("`", "").replace(" ", ""):
            return None
        found.append(Occurrence(".".join(f"`{p.replace('`', '``')}`" for p in parts), begin, end + 1, aliased))
    return Parsed(query, eager, sorted(found, key=lambda o: o.begin))


def replaced(text: str, by: dict[Occurrence, str]) -> str:
    """The text with some names replaced; where the query gives no alias, the name itself stays one."""
    for o, name in sorted(by.items(), key=lambda x: -x[0].begin):
        alias = "" if o.aliased else f" AS {o.name.rsplit('.', 1)[-1] if '`.`' not in o.name else '`' + o.name.rsplit('`.`', 1)[-1]}"
        text = f"{text[: o.begin]}{name}{alias}{text[o.end :]}"
    return text
