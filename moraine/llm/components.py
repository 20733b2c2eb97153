"""Connected components of a graph by alternating star operations.

Each round points neighbours at the smallest node they see (first the larger
neighbours of every node, then the smaller ones), which at least halves the
depth; the rounds are built from minima with partial aggregation and from joins
in which the few nodes of very high degree are joined by broadcast, so a hot
node is never held by one task. Each round's edges are written to the shared
folder, and those of the round before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Tables, cut, join_hot


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a and b, any direction,
    repeats and loops allowed); root: the smallest node of the component."""
    with Tables() as t:
        now = t.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
        digest = _digest(now)
        for _ in range(most_rounds):
            # larger neighbours of each node go to its smallest neighbour or itself
            both = now.union(now.select("b", "a"))
            least = t.cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("degree")))
            large = join_hot(now.select(F.col("b").alias("a"), F.col("a").alias("to")), least, "a", "degree").select(F.col("to").alias("a"), F.col("m").alias("b"))
            large = t.cut(large.where("a > b").distinct())
            # smaller neighbours of each node, and itself, go to the smallest of them
            smallest = t.cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")))
            linked = join_hot(large, smallest, "a", "degree")
            linked = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b"))).where("a > b").distinct()
            after = t.cut(linked)
            t.drop(now, least, large, smallest)
            now, before, digest = after, digest, _digest(after)
            if digest == before:
                break
        else:
            raise RuntimeError("components did not settle")
        return cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
