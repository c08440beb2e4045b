"""Connected components of an edge table, by rounds of joins on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root), a work table, for every node of edges(a, b); root is the smallest node that links reach.

    Alternating large-star and small-star rounds: each node's larger neighbours, then all its smaller ones, are linked
    to the smallest of them. The number of rounds grows with the logarithm of the largest component. A node's
    neighbours are never gathered: its minimum is an aggregate, combined on the map side, and written before the edges
    are joined with it, so that the edges of a node with very many can be split over tasks.
    """
    both = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    now = materialize(both, "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        twoway = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = materialize(twoway.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = twoway.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = materialize(large, "edges")
        low = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(low, "hi").select("lo", "hi", "m")
        small = small.select(F.col("m").alias("lo"), "hi").unionByName(small.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).distinct()
        release(now)
        now = materialize(small, "edges")
        release(large, least, low)
    out = now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root").unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
    out = materialize(out, "components")
    release(now)
    return out
