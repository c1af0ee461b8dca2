"""Exact top-k search by inner product with M-trees.

Inner product is no metric, but among vectors given one more component so that all have
one norm, and queries with a zero there, the greatest inner product is the least Euclidean
distance.  Each block of vectors becomes an M-tree of paged nodes that know their covering
radius and the distance to their parent's pivot.  A best-first search visits pages by the
least distance they can hold, and leaves out distances that the triangle inequality on
stored distances proves too large.  Scores themselves come from the untouched vectors.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import write_shared

#: Vectors of a tree and queries of a block (on average), entries of a leaf page, children of a node.
BLOCK_ROWS, QUERY_ROWS, PAGE, FANOUT = 16384, 1024, 512, 16
#: Relative slack of bounds, far above the error of the distances they are made of.
SLACK = 1e-9


@dataclass
class MTree:
    """Nodes 0, 1, ...; 0 is the root.  Leaves own a slice of the entries, others a slice of the nodes."""

    ids: np.ndarray
    vectors: np.ndarray
    lifted: np.ndarray
    to_pivot: np.ndarray
    pivots: np.ndarray
    radius: np.ndarray
    to_parent: np.ndarray
    leaf: np.ndarray
    first: np.ndarray
    last: np.ndarray
    top: float
    computed: int = 0

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT, seed: int = 0) -> MTree:
        """Top-down bulk load: pivots drawn at random, each entry to its nearest pivot."""
        norms = (vectors * vectors).sum(axis=1)
        top = float(norms.max(initial=0.0))
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(top - norms, 0))[:, None]], axis=1)
        rng = np.random.default_rng(seed)
        order, to_pivot = np.arange(len(ids)), np.zeros(len(ids))
        pivots, radius, to_parent, leaf, first, last = [], [], [], [], [], []

        def node(pivot: np.ndarray, members: np.ndarray, parent: np.ndarray | None) -> int:
            away = np.linalg.norm(lifted[members] - pivot, axis=1)
            for column, value in ((pivots, pivot), (radius, away.max(initial=0.0)), (to_parent, 0.0 if parent is None else float(np.linalg.norm(pivot - parent))), (leaf, True), (first, 0), (last, 0)):
                column.append(value)
            return len(pivots) - 1

        placed = np.empty(0, np.int64)
        todo = [(node(lifted.mean(axis=0) if len(ids) else np.zeros(lifted.shape[1]), order, None), order)]
        parts = []
        while todo:  # level by level, so that a node's children are neighbours
            later = []
            for at, members in todo:
                groups = []
                if len(members) > page:
                    chosen = lifted[rng.choice(members, min(fanout, -(-len(members) // page) + 1, len(members)), replace=False)]
                    near = ((lifted[members] ** 2).sum(axis=1)[:, None] - 2 * lifted[members] @ chosen.T + (chosen**2).sum(axis=1)).argmin(axis=1)
                    groups = [(p, members[near == i]) for i, p in enumerate(chosen) if (near == i).any()]
                if len(groups) > 1:
                    leaf[at], first[at] = False, len(pivots)
                    later += [(node(p, m, pivots[at]), m) for p, m in groups]
                    last[at] = len(pivots)
                else:  # a page; copies of one vector cannot be told apart and share a longer one
                    first[at] = sum(map(len, parts))
                    parts.append(members)
                    last[at] = first[at] + len(members)
                    to_pivot[first[at] : last[at]] = np.linalg.norm(lifted[members] - pivots[at], axis=1)
            todo = later
        placed = np.concatenate(parts) if parts else placed
        return cls(ids[placed], vectors[placed], lifted[placed], to_pivot, np.array(pivots), np.array(radius), np.array(to_parent), np.array(leaf), np.array(first), np.array(last), top)

    def search(self, query: np.ndarray, own, k: int) -> list[tuple[int, float]]:
        """The ``k`` greatest ``(id, inner product)`` of entries whose id isn't ``own``, ties to smaller ids."""
        q = np.append(query, 0.0)
        square = float(query @ query)
        slack = SLACK * (np.sqrt(square) + np.sqrt(self.top) + 1)
        ids, scores, reach = np.empty(0, self.ids.dtype), np.empty(0), np.inf
        start = float(np.linalg.norm(q - self.pivots[0]))
        queue = [(max(0.0, start - self.radius[0]), 0, start)]
        while queue:
            bound, at, away = heapq.heappop(queue)
            if bound > reach:
                break
            i, j = self.first[at], self.last[at]
            if self.leaf[at]:
                some = np.flatnonzero(np.abs(away - self.to_pivot[i:j]) <= reach) + i
                self.computed += len(some)
                if 2 * len(some) < j - i:
                    got = self.vectors[some] @ query
                else:  # cheaper in place than copied
                    got = (self.vectors[i:j] @ query)[some - i]
                if len(ids) == k:
                    good = got >= scores[-1]
                    some, got = some[good], got[good]
                if len(some):
                    other = self.ids[some] != own
                    ids, scores = np.concatenate([ids, self.ids[some[other]]]), np.concatenate([scores, got[other]])
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    if len(ids) == k:
                        reach = float(np.sqrt(max(0.0, square + self.top - 2 * scores[-1]))) + slack
            else:
                children = np.arange(i, j)
                children = children[np.abs(away - self.to_parent[i:j]) - self.radius[i:j] <= reach]
                aways = np.linalg.norm(self.pivots[children] - q, axis=1)
                self.computed += len(children)
                for c, a in zip(children.tolist(), aways.tolist()):
                    low = max(0.0, a - self.radius[c])
                    if low <= reach:
                        heapq.heappush(queue, (low, c, a))
        return list(zip(ids.tolist(), scores.tolist()))


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = max(1, int(lengths.max(initial=0)))
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    """``(block, ids, vectors)`` of ``rows(id, vector)`` dealt by hash into ``count`` blocks."""
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(count))).groupBy("block").agg(F.collect_list(F.struct("id", "vector")).alias("rows")).select("block", "rows.id", "rows.vector")


def build_index(rows: DataFrame, count: int, page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """``(block, tree)``: a serialized M-tree for each block of ``rows(id, vector)``."""
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("tree", T.BinaryType())])
    schema = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, vectors = b.column(1)[r].values.to_numpy(zero_copy_only=False), _matrix(b.column(2)[r].values)
                tree = pickle.dumps(MTree.build(ids, vectors, page, fanout), protocol=5)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1).cast(pa.int64()), pa.array([tree], pa.binary())], schema=schema)

    return _blocks(rows, count).select(F.col("block").cast("long").alias("block"), "id", "vector").mapInArrow(run, out)


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "vector", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` (double): the ``k`` greatest inner products for each query.

    Queries are the rows for which ``is_query`` holds; candidates are all rows of other ids.
    Equal scores go to the smaller id; fewer candidates give fewer rows.  Rows without an id,
    or whose vector is null or holds null or non-finite components, take no part.  Rows that
    repeat id and vector count once.  Shorter vectors are continued with zeros.  Inner products
    of whole numbers are exact below 2^53.  An empty table gives an empty one.

    Every block of queries meets every tree, one pair at a time; each gives ``k`` rows a query.
    """
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).dropDuplicates(["id", "vector"])
    rows, _ = write_shared(rows, "vectors")
    total, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    trees = max(1, -(-total // block_rows))
    index, _ = write_shared(build_index(rows.select("id", "vector"), trees), "mtree")
    queries = _blocks(rows.where("asks").select("id", "vector"), max(1, -(-asked // query_rows))).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))).alias("block"), F.col("id").alias("ids"), F.col("vector").alias("vectors"))
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                tree: MTree = pickle.loads(b.column(0)[r].as_py())
                width = tree.vectors.shape[1]
                asking = _matrix(b.column(2)[r].values)[:, :width]
                asking = np.pad(asking, ((0, 0), (0, width - asking.shape[1])))
                ids = b.column(1)[r].values.to_pylist()
                found = [(i, *hit) for i, q in zip(ids, asking) for hit in tree.search(q, i, k)]
                columns = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    # A pair a task, about: the number of pairs is known.
    pairs = queries.join(index, "block").select("tree", "ids", "vectors").repartition(min(100_000, max(1, trees * -(-asked // query_rows))))
    found = pairs.mapInArrow(run, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Scale of op7's whole-number components, the divisor of its query ids, and results a query (fixed values).
SCALE, QUERY_EVERY, K = 64, 20, 20


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as double (beyond 2^53 every double is whole)."""

    def one(x):
        y = x.cast("double") * float(scale)
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def op7_top_k(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole(F.col("embedding")).alias("vector"))
    found = top_k(rows, F.col("vec_id") % QUERY_EVERY == 0, K)
    limit = float(1 << 63)
    score = F.when(F.col("score") >= limit, F.lit((1 << 63) - 1)).when(F.col("score") < -limit, F.lit(-(1 << 63))).otherwise(F.expr("try_cast(score as bigint)"))
    return found.select("query_id", "rank", "vec_id", score.alias("score"))


OP7_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
"""
