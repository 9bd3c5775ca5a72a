"""Connected components of an edge list, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", fill: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` of every node of an edge; ``component`` is the smallest node reachable.

    Alternates large-star and small-star steps: each node's larger (smaller) neighbours are linked to
    the smallest one, until every component is a star. A step is two joins on the node, which AQE can
    split for a hub; the number of steps grows with the logarithm of the longest path. Self loops keep
    their node; null ends are ignored. With ``fill`` the steps have a partition for each ``fill`` edges (at most as many
    as a shuffle has): a step writes several files a partition, which few edges don't need. With ``scratch`` the steps
    are its tables: those of past steps are freed at once, the first and the last when the caller frees them.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null").distinct()
    keep = scratch or cut
    first = edges = keep(edges)
    few = 1 + edges.count() // fill if fill else 0
    step = (lambda df: keep(df.coalesce(few))) if few else keep
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).distinct()
    state, past = None, []
    edges = edges.filter("u > v")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = step(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # read anew, so that a hub's join can be split
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = step(large)
        lower = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = step(small.distinct())
        if scratch:
            scratch.free(least, large, lower, *past)
        past = [edges]
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == state:
            break
        state = now
    return nodes.join(edges, nodes.node == edges.u, "left").select("node", F.coalesce("v", "node").alias("component"))
