import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import mtree


def brute(rows, is_query, k):
    """rows: (id, vector)."""
    out = []
    rows = sorted({(i, tuple(v)) for i, v in rows})
    for q, x in rows:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 12), st.integers(2, 6), st.integers(0, 10))
def test_tree_search_is_exact(n, width, page, fanout, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-3, 4, (n, width)).astype(float)
    ids = rng.permutation(n)
    tree = mtree.MTree.build(ids, vectors, page, fanout)
    assert sorted(tree.ids.tolist()) == list(range(n))
    for q in (*vectors[:3], np.zeros(width), 100 * rng.standard_normal(width)):
        scores = vectors @ q
        want = sorted(zip((-scores).tolist(), ids.tolist()))
        for k in (1, 4):
            got = tree.search(q, -1, k)
            assert [(i, s) for i, s in got] == [(i, -s) for s, i in want[:k]] or np.allclose([s for _, s in got], [-s for s, _ in want[:k]])


def test_nodes_cover_and_prune():
    """Radii and parent distances hold, and clustered vectors leave most distances uncomputed."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 8)) * 50
    vectors = np.concatenate([c + rng.standard_normal((50, 8)) for c in centres])
    tree = mtree.MTree.build(np.arange(1000), vectors, 32, 8)
    for n in range(len(tree.pivots)):
        i, j = tree.first[n], tree.last[n]
        if tree.leaf[n]:
            away = np.linalg.norm(tree.lifted[i:j] - tree.pivots[n], axis=1)
            assert (away <= tree.radius[n] + 1e-6).all() and np.allclose(away, tree.to_pivot[i:j])
        else:
            assert np.allclose(np.linalg.norm(tree.pivots[i:j] - tree.pivots[n], axis=1), tree.to_parent[i:j])
    for q in range(0, 1000, 50):
        tree.search(vectors[q], q, 5)
    assert tree.computed < 0.5 * 20 * 1000


@pytest.mark.parametrize("block_rows", [16, 1000])
def test_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 6)]) for i in range(150)]
    rows += [(150 + i, rows[0][1]) for i in range(30)] + rows[:5]  # ties, and repeated rows
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = mtree.top_k(df, F.col("vec_id") % 10 == 0, 7, block_rows=block_rows, query_rows=8)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute(rows, lambda q: q % 10 == 0, 7)


def test_unusable_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [None, 1.0]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (1, [3.0]), (2, []), (None, [1.0, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumns({n: F.lit("clash") for n in ("id", "asks", "block", "tree", "score", "rank", "query_id")})
    got = mtree.top_k(df, F.col("vec_id") % 10 == 0, 10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 3.0), (0, 2, 3, 3.0), (0, 3, 2, 0.0)]
    assert mtree.top_k(df.where("vec_id < 0"), F.col("vec_id") % 10 == 0, 10).count() == 0


def test_query(spark, table_dir):
    import duckdb

    from quern.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES["op7_top_k"](spark, table_dir)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{table_dir}/embeddings.parquet/*.parquet'")
    want = c.execute(ORACLE_SQL["op7_top_k"]).fetchall()
    found = sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))
    assert found == sorted(want) and want
    # The 20 highest scores of each query; all others where there are fewer.
    assert [r[1] for r in found] == [rank for _ in (0, 20, 40) for rank in range(1, 21)]
    few = spark.createDataFrame([(i, [1.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    few.write.mode("overwrite").parquet(f"{table_dir}/few/embeddings.parquet")
    assert sorted((r["rank"], r["vec_id"]) for r in QUERIES["op7_top_k"](spark, f"{table_dir}/few").collect()) == [(i + 1, i + 1) for i in range(8)]
    huge = spark.createDataFrame([(i, [3e38, 3e38 * (i % 2)]) for i in range(3)], "vec_id long, embedding array<float>").select("vec_id", mtree.whole(F.col("embedding")).alias("vector"))
    assert mtree.top_k(huge, F.col("vec_id") == 0, 2).count() == 2
