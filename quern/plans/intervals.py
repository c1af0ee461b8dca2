"""Sets of key values: sorted, disjoint intervals and whether null belongs to them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from ..functions.keys import after_prefix, order


@dataclass(frozen=True)
class Interval:
    """``lo`` to ``hi``; an end that is open has ``None`` there (null itself is never an end)."""

    lo: Any = None
    hi: Any = None
    lo_in: bool = True
    hi_in: bool = True

    @property
    def is_point(self) -> bool:
        return self.lo is not None and self.hi is not None and self.lo_in and self.hi_in and order(self.lo) == order(self.hi)

    @property
    def is_empty(self) -> bool:
        if self.lo is None or self.hi is None:
            return False
        a, b = order(self.lo), order(self.hi)
        return a > b or (a == b and not (self.lo_in and self.hi_in))

    def __contains__(self, value: Any) -> bool:
        v = order(value)
        above = self.lo is None or v > order(self.lo) or (self.lo_in and v == order(self.lo))
        return above and (self.hi is None or v < order(self.hi) or (self.hi_in and v == order(self.hi)))

    def intersect(self, other: Interval) -> Interval:
        lo, lo_in = _tighter((self.lo, self.lo_in), (other.lo, other.lo_in), least=False)
        hi, hi_in = _tighter((self.hi, self.hi_in), (other.hi, other.hi_in), least=True)
        return Interval(lo, hi, lo_in, hi_in)

    def overlaps(self, low: Any, high: Any) -> bool:
        return not self.intersect(Interval(low, high)).is_empty


def _tighter(a: tuple, b: tuple, least: bool) -> tuple:
    if a[0] is None or b[0] is None:
        return b if a[0] is None else a
    x, y = order(a[0]), order(b[0])
    if x == y:
        return a if not a[1] else b
    return a if (x < y) == least else b


def _touches(a: Interval, b: Interval) -> bool:
    """``b`` begins no later than where ``a`` ends, with no value between."""
    if a.hi is None or b.lo is None:
        return True
    x, y = order(b.lo), order(a.hi)
    return x < y or (x == y and (a.hi_in or b.lo_in))


@dataclass(frozen=True)
class KeySet:
    """Values that a predicate on one column lets pass."""

    intervals: tuple[Interval, ...] = ()
    null: bool = False

    @classmethod
    def of(cls, intervals: Iterable[Interval], null: bool = False) -> KeySet:
        some = [i for i in intervals if not i.is_empty]
        some.sort(key=lambda i: ((0,) if i.lo is None else (1, order(i.lo)), not i.lo_in))
        merged: list[Interval] = []
        for i in some:
            if merged and _touches(merged[-1], i):
                last = merged.pop()
                if last.hi is None or i.hi is None:
                    hi, hi_in = None, True
                elif order(last.hi) == order(i.hi):
                    hi, hi_in = last.hi, last.hi_in or i.hi_in
                else:
                    hi, hi_in = (last.hi, last.hi_in) if order(last.hi) > order(i.hi) else (i.hi, i.hi_in)
                i = Interval(last.lo, hi, last.lo_in, hi_in)
            merged.append(i)
        return cls(tuple(merged), null)

    @classmethod
    def points(cls, values: Iterable[Any]) -> KeySet:
        return cls.of(Interval(v, v) for v in values if v is not None)

    @classmethod
    def prefix(cls, prefix: str) -> KeySet:
        """A prefix is the plain range up to the text after it, so it mixes with any other range."""
        return cls.of([Interval(prefix, after_prefix(prefix), True, False)])

    @classmethod
    def not_null(cls) -> KeySet:
        return cls((Interval(),))

    @classmethod
    def only_null(cls) -> KeySet:
        return cls((), True)

    def __and__(self, other: KeySet) -> KeySet:
        return KeySet.of((a.intersect(b) for a in self.intervals for b in other.intervals), self.null and other.null)

    def __or__(self, other: KeySet) -> KeySet:
        return KeySet.of([*self.intervals, *other.intervals], self.null or other.null)

    def __contains__(self, value: Any) -> bool:
        return self.null if value is None else any(value in i for i in self.intervals)

    @property
    def is_empty(self) -> bool:
        return not self.intervals and not self.null

    @property
    def all_points(self) -> bool:
        return all(i.is_point for i in self.intervals)

    def may_hold(self, low: Any, high: Any, nulls: int) -> bool:
        """False only if no value from ``low`` to ``high`` (None: there is none) nor a null is in the set."""
        if self.null and nulls:
            return True
        return low is not None and any(i.overlaps(low, high) for i in self.intervals)
