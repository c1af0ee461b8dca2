import re
from collections import defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes):
    """Water filling, round by round, as the words of the contract have it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(sizes)
    taken = defaultdict(int)
    source_of = {i: s for i, _, s in rows}
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert want[s] - 1 - 1e-6 <= taken[s] <= want[s] + 1e-6
    return taken


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 40), st.sampled_from([None, "", "a", "b", "é", "zz"])), min_size=1, max_size=25))
def test_targets_and_budgets(spark, rows):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate(rows)]
    check(rows, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_documents(spark, docs, rows, clashing, empty, table_dir):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check([(r[0], r[1], r[3]) for r in rows], got)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mixing.mix(docs)) == sorted(map(tuple, got)) == key(mixing.mix(clashing)) == key(mixing.mix(docs.repartition(7)))
    assert mixing.mix(empty).count() == 0
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{table_dir}/documents.parquet/*.parquet'")
    assert {(r[0], r[1], r[4]) for r in c.execute(mixing.OP9_SQL).fetchall()} == {(r["doc_id"], r["size"], r["taken"]) for r in got}


def test_native_plan(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixed_documents_are_what_is_taken(docs, rows, clashing):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    text = {r[0]: r[1] or "" for r in rows}
    found = defaultdict(list)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert text[r["doc_id"]].startswith(r["text"])
        if r["text"] != text[r["doc_id"]]:
            assert r["n_chars"] == len(r["text"]) and not re.search(r"[ \t\n]$", r["text"])
        found[r["doc_id"]].append(len(WORD.findall(r["text"])))
    assert {i: sum(n) for i, n in found.items()} == {i: n for i, n in taken.items() if n}
    assert mixing.mixed_documents(clashing).columns == clashing.columns
    assert mixing.mixed_documents(clashing).count() == out.count()


def test_repeated_rows_share_a_key(spark):
    rows = [(i // 4, "w " * (5 + i % 4), "a" if i < 20 else "b") for i in range(24)] + [(None, "x y", "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    per = defaultdict(int)
    for r in got:
        per[r["target"]] += r["taken"]
    assert all(t - 6 <= n <= t for t, n in per.items())
