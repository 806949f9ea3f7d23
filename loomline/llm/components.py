"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations with joins; edges stay a distributed table throughout
and every round's edges are written to the shared folder, so lineage stays short. The
minimum per node is a partial aggregate (a hub's edges are combined before the
shuffle), and the join back is a plain equi-join that adaptive execution can split
where a hub is hot. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_minima(both), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _minima(down)
    moved = down.join(mins, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(mins.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the least node.

    Null ends and self-loops link nothing. The node type may be any that has an order.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    run = uuid.uuid4().hex[:8]
    mark, label = None, f"edges-{run}-0"
    now = scratch.cut(now, label)
    for step in range(1, most_rounds + 1):
        new_label = f"edges-{run}-{step}"
        now = scratch.cut(_small_star(_large_star(now)), new_label)
        scratch.drop(label)
        label = new_label
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == mark or row["n"] == 0:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        mark = (row["n"], row["x"])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
