import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import linededup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=20, min_documents=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(holders[key(x)]) >= min_documents and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in linededup.dedup_lines(df).collect()), key=repr)


def test_against_brute_force(docs, rows):
    assert got(docs) == brute([r[:2] for r in rows])
    assert any(r[2] for r in brute([r[:2] for r in rows]))


LINE = st.sampled_from(["", "short", "a line of twenty chars", "A Line Of Twenty Chars  ", "\x0b a line of twenty chars\r", "ÀÉ twenty characters long", "àé twenty characters long", "x" * 19, "x" * 20, " \t"])


@settings(max_examples=6, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(LINE, max_size=6).map("\n".join)), min_size=1, max_size=10))
def test_random_documents(spark, texts):
    rows = [(i * 3 % 11, t) for i, t in enumerate(texts)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_digests(docs, rows):
    want = {r[0]: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute([r[:2] for r in rows])}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.line_digests(docs).collect()} == want


def test_edge_cases(spark, empty, clashing, docs):
    assert linededup.line_digests(empty).count() == 0
    sha = lambda df: sorted(map(tuple, linededup.line_digests(df).collect()))
    assert sha(clashing) == sha(docs)
    whole = linededup.dedup_lines(clashing)
    assert whole.columns == [c for c in clashing.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert {r["score"] for r in whole.collect()} == {"clash"}
    # Three rows of one id are one document; a null id never counts.
    line = "the same line of more than twenty"
    rows = [(1, line), (1, line), (1, line), (None, line), (2, line)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    rows.append((3, line))
    assert [r[2] for r in got(spark.createDataFrame(rows, "doc_id long, text string"))] == [r[2] for r in brute(rows)]


def test_query(spark, table_dir):
    from quern.llm.queries import QUERIES

    assert QUERIES["op3_line_dedup"](spark, table_dir).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


@pytest.mark.parametrize("most", [1, 2])
def test_bounds_are_parameters(docs, rows, most):
    r = linededup.dedup_lines(docs, min_chars=5, min_documents=most).collect()
    want = brute([x[:2] for x in rows], 5, most)
    assert sorted(((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"] or "") for x in r), key=repr) == want
