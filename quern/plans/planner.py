"""Which indexes a scan may use, and what to do with each of its files."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators import statistics
from ..operators.statistics import FULL, SKIP, USE
from ..sources.catalog import IndexDef
from ..sources.files import plain
from .intervals import KeySet
from .predicates import FileEntry, ScanInfo


@dataclass
class Chosen:
    """An index and the key sets of its leading columns."""

    index: IndexDef
    sets: list[KeySet]
    manifest: dict[str, dict] = field(default_factory=dict)  # by file
    judged: dict[str, dict] = field(default_factory=dict)  # by file: what Bloom filter and sample say


@dataclass
class Decision:
    file: FileEntry
    what: str
    index: str
    reason: str
    coverage: float | None = None


def matched_sets(index: IndexDef, keys: dict[str, KeySet], opens: set[str]) -> list[KeySet]:
    """Key sets that the index can use: equalities on leading columns, then one set of any form.

    A bitmap takes any set on its column: its entries are looked up by key like all others.
    Empty if the predicate gives no reason to use the index.
    """
    found: list[KeySet] = []
    for i, c in enumerate(index.names):
        if c not in keys or (i == 0 and c not in opens):
            break
        found.append(keys[c])
        if len(keys[c].intervals) != 1 or not keys[c].all_points or keys[c].null:
            break
    return found


def choose(indexes: list[IndexDef], info: ScanInfo, disabled: set[str], most: int) -> list[Chosen]:
    """Up to ``most`` enabled indexes with disjoint columns, those that match most of their columns first."""
    ranked = []
    for index in indexes:
        if index.name in disabled:
            continue
        sets = matched_sets(index, info.keys, info.opens_index)
        if sets:
            ranked.append((len(index.columns) / len(sets) + 1 / len(sets), index.created, Chosen(index, sets)))
    ranked.sort(key=lambda r: r[:2])
    found: list[Chosen] = []
    taken: set[str] = set()
    for _, _, c in ranked:
        if len(found) < most and not taken & set(c.index.names):
            found.append(c)
            taken |= set(c.index.names)
    return found


def decide(info: ScanInfo, chosen: list[Chosen], options: statistics.Options, statistics_on: bool, file_policy: bool, size_ratio: float) -> list[Decision]:
    """A decision for each file of the scan.

    A file that an index doesn't know, or knows with another size or time, is read whole by
    that index.  Any index may skip a file; otherwise those that say so are used.
    """
    decisions = []
    for f in info.files:
        path, verdicts = plain(f.path), []
        for c in chosen:
            row = c.manifest.get(path)
            if row is None:
                verdicts.append((FULL, c, "not indexed", None))
            elif (row["size"], row["modified"]) != (f.size, f.modified):
                verdicts.append((FULL, c, "changed since", None))
            elif any(s.is_empty for s in c.sets):
                verdicts.append((SKIP, c, "empty predicate", None))
            elif statistics_on:
                what, share = statistics.judge(row, c.sets, c.judged.get(path, {}), options)
                if what != SKIP and file_policy and row["index_bytes"] > size_ratio * f.size:
                    verdicts.append((FULL, c, "index too large", share))
                else:
                    verdicts.append((what, c, "statistics", share))
            elif file_policy and row["index_bytes"] > size_ratio * f.size:
                verdicts.append((FULL, c, "index too large", None))
            else:
                verdicts.append((USE, c, "no statistics asked", None))
        skips = [v for v in verdicts if v[0] == SKIP]
        uses = [v for v in verdicts if v[0] == USE]
        best = (skips or uses or verdicts)
        what = best[0][0]
        names = ",".join(v[1].index.name for v in (uses if what == USE else best[:1]))
        decisions.append(Decision(f, what, names, best[0][2], best[0][3]))
    return decisions
