"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Shelf, cut


def mark(e: DataFrame) -> tuple:
    """Two edge sets with equal marks are taken as equal."""
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges(u, v): the smallest node that each node reaches.

    Alternates large-star and small-star rounds until the edges stand still; minima are combined before
    each shuffle and lineage is cut every round. Nodes without an edge are not returned.
    """
    with Shelf(edges.sparkSession, "components") as shelf:
        e = shelf.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        now = mark(e)
        while True:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            before, e = now, shelf.put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
            now = mark(e)
            if now == before:
                break
        return cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
