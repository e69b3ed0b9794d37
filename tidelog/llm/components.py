"""Connected components of a graph of any size, by alternating large and small stars.

Each round moves every edge's far end towards the smallest neighbour, first for
larger neighbours, then for smaller ones (Kiveris et al., 2014); the edges end as
stars round each component's smallest vertex, after a number of rounds that grows
with the logarithm of the size.  Minima are aggregated before the shuffle and
joined back as one row a vertex; the other side of that join, the edges of a vertex
with many neighbours, is split by adaptive execution where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v; the star of each vertex round its least neighbour."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (vertex, component): the smallest vertex that each vertex with an edge can reach; vertices that are that smallest one are left out."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, before = cut(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
        before = mark
        now = cut(_star(_star(now, True), False), "edges")
