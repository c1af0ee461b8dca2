"""Key sets against the plain meaning of the predicates they stand for."""

import math

from hypothesis import given
from hypothesis import strategies as st

from quern.functions.keys import after_prefix, order
from quern.plans.intervals import Interval, KeySet

VALUES = st.integers(-3, 8)
NUMBERS = st.one_of(st.integers(-3, 8), st.just(math.nan), st.floats(-3, 8))


@st.composite
def key_set(draw):
    """A key set and the test it stands for."""
    kind = draw(st.sampled_from(["eq", "in", "lt", "le", "gt", "ge", "null", "not_null"]))
    v, vs = draw(VALUES), draw(st.lists(VALUES, max_size=4))
    less = lambda x, y: order(x) < order(y)
    return {
        "eq": (KeySet.points([v]), lambda x: x is not None and order(x) == order(v)),
        "in": (KeySet.points(vs), lambda x: x is not None and any(order(x) == order(w) for w in vs)),
        "lt": (KeySet.of([Interval(None, v, True, False)]), lambda x: x is not None and less(x, v)),
        "le": (KeySet.of([Interval(None, v)]), lambda x: x is not None and not less(v, x)),
        "gt": (KeySet.of([Interval(v, None, False, True)]), lambda x: x is not None and less(v, x)),
        "ge": (KeySet.of([Interval(v, None)]), lambda x: x is not None and not less(x, v)),
        "null": (KeySet.only_null(), lambda x: x is None),
        "not_null": (KeySet.not_null(), lambda x: x is not None),
    }[kind]


@st.composite
def combined(draw, depth=3):
    if depth == 0 or draw(st.booleans()):
        return draw(key_set())
    (a, f), (b, g) = draw(combined(depth - 1)), draw(combined(depth - 1))
    if draw(st.booleans()):
        return a & b, lambda x: f(x) and g(x)
    return a | b, lambda x: f(x) or g(x)


@given(combined(), st.one_of(st.none(), NUMBERS))
def test_membership_is_the_predicate(made, x):
    keys, test = made
    assert (x in keys) == test(x)


@given(combined())
def test_intervals_are_sorted_disjoint_and_not_empty(made):
    keys, _ = made
    for a, b in zip(keys.intervals, keys.intervals[1:]):
        assert a.hi is not None and b.lo is not None
        assert order(a.hi) < order(b.lo) or (order(a.hi) == order(b.lo) and not (a.hi_in or b.lo_in))
    assert not any(i.is_empty for i in keys.intervals)


@given(combined(), st.lists(st.one_of(st.none(), VALUES), min_size=1, max_size=6))
def test_files_with_a_match_are_never_skipped(made, values):
    keys, test = made
    some = [v for v in values if v is not None]
    if any(map(test, values)):
        assert keys.may_hold(min(some, default=None), max(some, default=None), values.count(None))


@given(st.text(max_size=4), st.text(max_size=6))
def test_prefix_is_a_range(prefix, x):
    assert (x in KeySet.prefix(prefix)) == x.startswith(prefix)


def test_prefix_with_range_and_or_range():
    both = KeySet.prefix("this3") & KeySet.of([Interval("this35", None, False, True)])
    assert "this36" in both and "this35" not in both and "this4" not in both and not both.is_empty
    either = KeySet.of([Interval("this4", "this5")]) | KeySet.prefix("this5")
    assert "this57" in either and "this45" in either and "this6" not in either


def test_ends_of_prefixes():
    assert after_prefix("ab") == "ac"
    assert after_prefix("") is None and after_prefix("\U0010ffff") is None
    assert after_prefix("a\U0010ffff") == "b" and after_prefix("퟿") == ""


def test_nan_is_equal_to_itself_and_greatest():
    assert math.nan in KeySet.points([math.nan]) and math.nan in KeySet.of([Interval(5.0, None)])
    assert math.nan not in KeySet.of([Interval(None, math.inf)]) and 0.0 in KeySet.points([-0.0])
