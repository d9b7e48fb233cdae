"""Sums of vectors and of their outer products by group, and the rows above a share of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered
from tessera.session import Shelf, carried, dealt_by, small

carried(__name__)

#: Numbers that a task holds in the sums of all its groups before it hands them on.
HELD = 4_000_000
#: Bins of a group's scores in the search for a cut.
BINS = 1024


def vector_sums(rows: DataFrame, group: str, vector: str, second: bool = False) -> DataFrame:
    """group, n and total (the sum of the vectors), with `second` also moment (the sum of x x', row by row), of rows whose vectors
    are not null and share one length.

    A task adds its rows up group by group, as one matrix product for each group of a batch, and hands on one row for each; rows of
    a group are then added up one at a time, so that neither side holds more than HELD numbers or one group's sums.
    """
    kind = dict(rows.dtypes)[group]

    def added(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """whole: rows are vectors, in any order; else sums, a group's rows together."""
        held: dict = {}

        def out() -> pa.RecordBatch:
            keys, sums = list(held), list(held.values())
            held.clear()
            wide = lambda c: pa.array([s[c].ravel() for s in sums], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array([s[0] for s in sums], pa.int64()), wide(1), wide(2)], names=["g", "n", "total", "moment"])

        def add(key, n: int, total: np.ndarray, moment: np.ndarray) -> None:
            if key in held:
                s = held[key]
                held[key] = [s[0] + n, s[1] + total, s[2] + moment]
            else:
                held[key] = [n, total, moment]

        key_type, none = None, np.zeros(0)
        for b in batches:
            key_type = b.schema.field("g").type
            if not b.num_rows:
                continue
            if whole:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                codes = b.column("g").dictionary_encode(null_encoding="encode")
                code, keys = codes.indices.to_numpy(), codes.dictionary.to_pylist()
                order = np.argsort(code, kind="stable")
                ends = np.flatnonzero(np.r_[code[order][1:] != code[order][:-1], True]) + 1
                for lo, hi in zip(np.r_[0, ends[:-1]], ends):
                    mine = x[order[lo:hi]]
                    add(keys[code[order[lo]]], int(hi - lo), mine.sum(axis=0), mine.T @ mine if second else none)
                    if len(held) * (x.shape[1] * (x.shape[1] if second else 1) + 1) > HELD:
                        yield out()
            else:
                for key, n, total, moment in zip(b.column("g").to_pylist(), b.column("n").to_pylist(), b.column("total"), b.column("moment")):
                    if held and key not in held:
                        yield out()
                    add(key, n, total.values.to_numpy(), moment.values.to_numpy())
        if held:
            yield out()

    schema = f"g {kind}, n bigint, total array<double>, moment array<double>"
    parts = rows.select(F.col(group).alias("g"), F.col(vector).alias("x")).where("x is not null").mapInArrow(lambda it: added(it, True), schema)
    sums = dealt_by(parts, "g").sortWithinPartitions("g").mapInArrow(lambda it: added(it, False), schema)
    return sums.select(F.col("g").alias(group), "n", "total", *(["moment"] if second else []))


def top_share(rows: DataFrame, group: str, score: str, key: str, share: float, shelf: Shelf) -> DataFrame:
    """Of each group of n rows the ceil(share n) with the highest score, ties by the smallest key; scores and keys are not null.

    Counts in BINS bins of each group's scores tell the bin that holds the cut; rows of higher bins stay, those of that bin alone
    are ranked, over all tasks, whatever share of a group or table it holds. Groups' rows never meet in one task.
    """
    rows = shelf.put(rows)
    ends = shelf.put(rows.groupBy(group).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.ceil(F.count(F.lit(1)) * share).alias("_keep")))
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")
    binned = shelf.put(rows.join(small(ends), group).withColumn("_bin", place).drop("_low", "_high"))
    counts = binned.groupBy(group, "_bin", "_keep").agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(group).orderBy(F.desc("_bin"))) - F.col("_n")  # at most BINS rows a group
    cut = shelf.put(counts.withColumn("_above", above).where("_above < _keep AND _above + _n >= _keep").select(group, F.col("_bin").alias("_cut"), (F.col("_keep") - F.col("_above")).alias("_left")))
    at = binned.drop("_keep").join(small(cut), group)
    edge = numbered(at.where("_bin = _cut").select(group, key, score, "_left"), [group], [F.desc(score), F.asc(key)], "_rank")
    some = edge.where(F.col("_rank") < F.col("_left")).select(group, key)
    kept = at.where("_bin > _cut").select(rows.columns)
    return kept.unionByName(at.where("_bin = _cut").select(rows.columns).join(some, [group, key], "left_semi"))
