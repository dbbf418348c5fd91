"""Connected components of a graph far larger than one machine.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond"): every
round is two shuffles on node ids, the number of rounds grows with the logarithm of the component size, and no component
is ever gathered in one place. Each round is checkpointed in the session's shared folder, so that the plan stays short
and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import cut


def _minima(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each node's component, for every node of an edge.

    Direction, repeated edges and order do not matter; self-loops give a component of one; edges with a null end are
    ignored; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = cut(e.distinct())
    e, seen = nodes.where("u <> v"), None
    for _ in range(max_rounds):
        # large star: larger neighbours point to the least neighbour
        large = _minima(e).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself point to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    every = nodes.select(F.col("u").alias("node")).union(nodes.select("v")).distinct()
    return every.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
