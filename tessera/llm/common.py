"""What the operators of this subpackage share: inputs, shared storage and distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import carried, cut, saved, scratch, shared_dir

__all__ = ["carried", "cut", "ranked", "saved", "scratch", "shards", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(df: DataFrame) -> int:
    """Partitions for a range exchange: the session's shuffle parallelism."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: list[str], order: list[str | Column], name: str = "rank", few: bool = True) -> DataFrame:
    """Adds a gapless 0-based rank within `group` by `order`, and `<name>_n`, the group's rows.

    No group meets in one task: rows are range-partitioned on group and order together, counted per
    partition, and each partition's ranks start where the partitions before it end. Only one row per
    partition and group passes through the running sum. `few` says that the groups are bounded by a parameter, so
    that those rows are bounded by the layout and may be broadcast; otherwise they meet the rows in a shuffled hash
    join on partition and group, which no key can crowd beyond a partition's own rows.
    """
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = df.repartitionByRange(shards(df), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    rows = cut(laid.withColumn("_at", at).withColumn("_part", F.shiftright(F.col("_at"), 33)))
    null_safe = [F.coalesce(F.col(g).cast("string"), F.lit("\x00null")).alias(f"_g{i}") for i, g in enumerate(group)]
    rows = rows.select("*", *null_safe)
    g = [f"_g{i}" for i in range(len(group))]
    counts = rows.groupBy("_part", *g).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by = Window.partitionBy(*(g or [F.lit(0)])).orderBy("_part")
    all_ = Window.partitionBy(*(g or [F.lit(0)]))
    starts = counts.select("_part", *g, "_first", (F.sum("_n").over(by) - F.col("_n")).alias("_before"), F.sum("_n").over(all_).alias(f"{name}_n"))
    return (
        rows.join(F.broadcast(starts) if few else starts.hint("shuffle_hash"), ["_part", *g])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_at", "_part", "_first", "_before", *g)
    )
