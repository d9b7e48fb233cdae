"""Ordered rows of a group, split across tasks: what came last before a row, and ranks.

Rows are dealt by ranges of group and order together, so a group of all rows is spread over all tasks; what a part needs from
those before it is one row for each part and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def laid(rows: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """rows written once in order, with `_at`, ascending within `_part`; parts are ranges of group and order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    return cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))


def _named(rows: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds the group as columns without nulls, to join on."""
    g = [f"_g{i}" for i in range(len(group))]
    return rows.withColumns({n: F.struct(c) for n, c in zip(g, group)}), g


def last_before(rows: DataFrame, group: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null of the group's rows before each row, in `order`; null where there is none."""
    at, g = _named(laid(rows.withColumn("_value", value), group, order), group)
    here = Window.partitionBy("_part", *g).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = at.groupBy("_part", *g).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_end"))
    earlier = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    carry = ends.select("_part", *g, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    near = at.withColumn("_near", F.last("_value", ignorenulls=True).over(here))
    return near.join(carry, ["_part", *g]).withColumn(name, F.coalesce("_near", "_carry")).drop("_at", "_part", "_value", "_near", "_carry", *g)


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds the rank of each row in its group by `order`, from 0."""
    at, g = _named(laid(rows, group, order), group)
    counts = at.groupBy("_part", *g).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*g).orderBy("_part")) - F.col("_n")  # over a row for each part
    starts = counts.withColumn("_before", before).drop("_n")
    return at.join(starts, ["_part", *g]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before", *g)
