"""Connected components of a graph held in a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint, split_join

MAX_ROUNDS = 200
#: Edges that one task turns.
TASK_EDGES = 1 << 14


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of the edges ``u, v`` (longs); ``root`` is the component's smallest node.

    Rounds of large-star and small-star: every node hands its neighbours to the
    smallest it knows, until each component is a star around its root.  The state
    is the edge list alone, checkpointed in each round; nothing is collected.  Hubs
    with a large share of all edges are joined by broadcast.  Rounds grow with the
    square of the logarithm of the longest path; tasks follow the number of edges, which falls.
    """
    first = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    stars, before = shared_checkpoint(first), None
    for _ in range(MAX_ROUNDS):
        state = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        before, tasks = state, max(1, -(-state[0] // TASK_EDGES))
        larger = shared_checkpoint(_large_star(stars.coalesce(tasks), state[0], tasks).coalesce(tasks))
        stars = shared_checkpoint(_small_star(larger, tasks).coalesce(tasks))
    raise RuntimeError(f"components are not stable after {MAX_ROUNDS} rounds")


def _large_star(stars: DataFrame, edges: int, tasks: int) -> DataFrame:
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    larger = both.where(F.col("v") > F.col("u"))
    return split_join(larger, smallest, ["u"], "n", total=2 * edges).select(F.col("v").alias("hi"), F.col("m").alias("lo")).coalesce(tasks).distinct()


def _small_star(stars: DataFrame, tasks: int) -> DataFrame:
    smallest = stars.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = split_join(stars, smallest, ["hi"], "n", total=stars.count()).where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return smallest.select("hi", F.col("m").alias("lo")).unionByName(moved).coalesce(tasks).distinct()
