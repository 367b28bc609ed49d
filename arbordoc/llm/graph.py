"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """edges (a, b) -> (node, root) for every node that has an edge; root is the smallest node of its component.

    Alternating large-star and small-star steps: each hooks a node's neighbours to the smallest node known there. Each step is one aggregation (combined on the map side) and
    one join, whose row side AQE can split when a node has very many neighbours. Edges are written to the shared folder after each round, so lineage stays short;
    the number of edges never grows. Ends when a round changes nothing. Null ends are ignored; repeated edges and loops are allowed.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = stash(e, tag), None
    while True:
        count, total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, total) == seen or not count:
            break
        seen = (count, total)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), tag)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, tag)
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = stash(small, tag)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
