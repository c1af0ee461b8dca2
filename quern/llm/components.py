"""Connected components of a link table by alternating star contractions, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_shared, write_shared

#: Links that a task of a round writes, about: small rounds are then a few files, not one for each shuffle partition.
LINKS_A_TASK = 100_000
#: Rounds after which a run is given up; the number needed grows with the logarithm of the longest path.
MOST_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or the node itself)."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its least neighbour."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; ``component`` is the least node reachable.

    Self-links and repeated links do no harm; nodes need an order; an empty table gives an
    empty one.  Each round is written to the shared folder, and the round before is deleted.
    The least neighbours are aggregated with a map-side part and joined back, so a node with
    a great many links is never in one task as a whole (AQE splits its side of the join).
    """
    spark = links.sparkSession
    now, path = write_shared(links.where("a <> b").select("a", "b"), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before, old = state, path
        # A round makes no more links than it is given, and one for each node.
        now, path = write_shared(_small_star(_large_star(now)).coalesce(max(1, -(-state[0] // LINKS_A_TASK))), "links")
        drop_shared(spark, old)
    else:
        raise RuntimeError("components: too many rounds")
    # Now every link goes from a node to the least node of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
