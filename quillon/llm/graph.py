"""Connected components of a graph that is a DataFrame of edges.

Large-star and small-star rounds (Kiveris et al., 2014): the edge count never
grows, a long chain shrinks by a constant factor a round, and all that reaches
the driver is one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _to_smallest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the smallest of u and u's neighbours in ``edges``."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(smallest, "u")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): each id of an edge with the smallest id that it reaches.

    ``edges`` has columns u and v of a long type, in any order and with repeats;
    edges with a null or from a vertex to itself are dropped. No edges: no rows.
    """
    star = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    star = scratch.save(star, "edges")
    seen = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        linked = _to_smallest(large)
        small = linked.select(F.col("u"), F.col("m").alias("v")).unionByName(linked.select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = scratch.save(small.where("u <> v").distinct(), "edges")
        row = after.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        scratch.drop(star)
        star = after
        if seen == (row.n, row.x):
            break
        seen = (row.n, row.x)
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
