"""Connected components of an edge table, entirely in DataFrames.

Alternating large-star and small-star contraction: every round points the neighbours of each node to the
smallest one it knows, until nothing moves. A round is two aggregations and joins on node numbers; its
edges are written to the shared folder, so lineage stays short and lost executors only repeat one round.
Minima are partially aggregated before the shuffle, so a hub's edges never meet in one group. A round's folder goes when the next one
is written.

Defined results: an edge of a node with itself and an edge with a null end say nothing; repeated and turned edges count once; no
edges give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, persisted


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node."""
    now = persisted(edges.select("a", "b").where("a <> b").distinct())
    stamp = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long")))
    before, after = None, now.agg(stamp).first()
    while after != before:
        before, last = after, now
        now = persisted(_small_star(_large_star(last)))
        after = now.agg(stamp).first()
        discarded(last)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
