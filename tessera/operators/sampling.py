"""Sampling schedules and scene changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec
from tessera.operators.ordered import last_before
from tessera.session import small

#: Counts of a scan that add up over windows.
SCAN_SUMS = ("seeds", "faces", "low_area", "scene_changes", "dense_added", "static_skipped")


def sample_times(length: Column, step: float) -> Column:
    """0, step, ... up to length plus half a step, exclusive; [0] for a step that is not positive."""
    if step <= 0:
        return F.when(length >= 0, F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    n = F.ceil((length + step * 0.5) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k * step)).otherwise(F.array().cast("array<double>"))


def uniform_times(start: Column, end: Column, count: int) -> Column:
    """`count` times evenly from start to end; one at the start for an empty span."""
    a = F.greatest(F.lit(0.0), start)
    b = F.greatest(a, end)
    many = F.transform(F.sequence(F.lit(0), F.lit(max(1, count) - 1)), lambda k: a + (b - a) * k / max(1, count - 1))
    return F.when((b > a) & F.lit(count > 1), many).otherwise(F.array(a))


def retry_checkpoints(duration: Column, covered: Column, seeds: Column, step: int = 5, forced: bool = False) -> Column:
    """Times at every step % of the duration (step to the nearest 5, ties to even, in [5, 95]) beyond what is covered."""
    pct = max(5, min(95, int(round(max(5, min(95, step)) / 5.0) * 5)))
    total = F.greatest(F.lit(0.0), duration)
    done = F.greatest(F.lit(0.0), F.least(covered, total))
    all_ = F.transform(F.sequence(F.lit(pct), F.lit(99), F.lit(pct)), lambda k: F.round(total * (k / 100.0), 6))
    found = F.array_distinct(F.filter(all_, lambda t: (t > done + 1e-6) & (t < total)))
    wanted = (total > 0) & (done < total) & (F.lit(forced) | (seeds > 0))
    return F.when(wanted, found).otherwise(F.array().cast("array<double>"))


def late_windows(duration: Column, scan: float = 60.0, step: float = 2.0) -> Column:
    """(start, end) of the late windows at 35, 60 and 80 % of items longer than the scan by 10 s or two steps; starts
    equal to a tenth of a second count once, windows of a second or less not at all."""
    length = max(15.0, scan)
    starts = F.array_distinct(F.array(*(F.floor(duration * p * 10 + 0.5) for p in (0.35, 0.60, 0.80))))
    windows = F.transform(F.filter(F.array(*(duration * p for p in (0.35, 0.60, 0.80))), lambda s: (s + 1 < duration) & F.array_contains(starts, F.floor(s * 10 + 0.5))), lambda s: F.struct(s.alias("start"), F.least(duration, s + length).alias("end")))
    none = F.array().cast("array<struct<start:double,end:double>>")
    return F.when(duration > scan + max(10.0, 2 * step), F.filter(windows, lambda w: w["end"] > w["start"] + 1)).otherwise(none)


def until_first(rows: DataFrame, order: list[str], hit: str) -> DataFrame:
    """Rows of each entity_id up to and including its first hit by `order`; all of them where there is none.

    The first hit is a minimum that combines before the shuffle, so no entity is sorted or meets in one task.
    """
    at = F.struct(*order)
    first = rows.where(hit).groupBy("entity_id").agg(F.min(at).alias("_first"))
    return rows.join(small(first), "entity_id", "left").where(F.col("_first").isNull() | (at <= F.col("_first"))).drop("_first").select(*rows.columns)


def first_success(windows: DataFrame) -> DataFrame:
    """Rows (entity_id, at, ok, ...) up to and including the first success of each entity."""
    return until_first(windows, ["at"], "ok")


def retry_merged(windows: DataFrame) -> DataFrame:
    """A row for each entity of windows(entity_id, start, end, ok, best_seed and the counts SCAN_SUMS): what its windows up to the first
    success, by start, have found together.

    Windows that end where they start are not scanned. found_at and scan_end are of the first success, null where there is none;
    attempted has the starts scanned, counts add up, best_seed is the highest, 0 at least. All of it combines before the shuffle.
    """
    real = windows.where("end > start").withColumn("ok", F.coalesce("ok", F.lit(False)))
    seen = until_first(real, ["start"], "ok")
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in SCAN_SUMS if c in windows.columns]
    best = F.greatest(F.lit(0.0), F.max(F.coalesce("best_seed", F.lit(0.0)))).alias("best_seed")
    found = [F.max(F.when(F.col("ok"), F.col(c))).alias(n) for c, n in (("start", "found_at"), ("end", "scan_end"))]
    return seen.groupBy("entity_id").agg(*found, F.array_sort(F.collect_list("start")).alias("attempted"), best, *sums)


def scene_changes(frames: DataFrame, threshold: float = 15.0) -> DataFrame:
    """Adds diff (Bhattacharyya distance x 100 to the previous readable frame) and change to frames
    (entity_id, ts, hist, static); rows without a histogram are skipped, not compared. A long video is spread over tasks."""
    seen = frames.where(F.col("hist").isNotNull())
    out = last_before(seen, ["entity_id"], ["ts"], F.struct("hist", "static"), "_b")
    out = out.withColumn("diff", F.when(F.col("_b").isNotNull(), vec.bhattacharyya(F.col("_b.hist"), F.col("hist"))))
    return out.withColumn("change", F.coalesce((F.col("diff") >= threshold) & ~F.col("static") & ~F.col("_b.static"), F.lit(False))).drop("_b")


def scene_schedule(spans: DataFrame, changes: DataFrame, static: DataFrame, step: float = 2.0, window: float = 1.0, dense: float = 0.5, scan_step: float = 1.0) -> DataFrame:
    """(entity_id, ts): base times of spans(entity_id, duration), and dense ones around changes(entity_id, ts), less
    those near static(entity_id, ts) ones; the first time of an entity stays if none would."""
    base = spans.select("entity_id", F.explode(sample_times(F.col("duration"), step)).alias("ts"))
    around = changes.join(spans, "entity_id").select("entity_id", F.greatest(F.lit(0.0), F.col("ts") - window).alias("a"), F.least(F.col("duration"), F.col("ts") + window).alias("b"))
    more = around.select("entity_id", "a", F.explode(sample_times(F.greatest(F.lit(0.0), F.col("b") - F.col("a")), max(0.1, dense))).alias("o")).select("entity_id", (F.col("a") + F.col("o")).alias("ts"))
    all_ = base.unionByName(more).groupBy("entity_id", F.floor(F.col("ts") * 1000 + 0.5).alias("k")).agg(F.min("ts").alias("ts")).select("entity_id", "ts")
    tol = max(0.15, min(step, scan_step) * 0.5)
    # static times meet samples of the same entity in the same or a neighbouring cell as wide as the tolerance
    cell = lambda t: F.floor(t / tol)
    s = static.select("entity_id", F.col("ts").alias("st"), F.explode(F.sequence(cell(F.col("ts")) - 1, cell(F.col("ts")) + 1)).alias("cell"))
    near = all_.withColumn("cell", cell(F.col("ts"))).join(s, ["entity_id", "cell"]).where(F.abs(F.col("ts") - F.col("st")) <= tol).select("entity_id", "ts").distinct()
    left = all_.join(near, ["entity_id", "ts"], "left_anti")
    first = all_.groupBy("entity_id").agg(F.min("ts").alias("ts")).join(left.select("entity_id").distinct(), "entity_id", "left_anti")
    return left.unionByName(first)


def first_hits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first hit of each entity, counters over rows up to and including it) of rows(entity_id, ts, rank, hit, ...)."""
    seen = until_first(rows, ["ts", "rank"], "hit")
    return seen.where("hit"), seen.groupBy("entity_id").agg(F.count(F.lit(1)).alias("evaluated"))


def rolling_rate(points: DataFrame, seconds: int = 300) -> DataFrame:
    """Adds per_minute: done since the oldest point of the last `seconds`, and the one before it, by time; of
    points (stream, ts, done).

    That point is the last one earlier than `seconds` ago, or else the stream's first; each point asks for it at that
    time, so points and questions in one order need the last point before alone, and a stream is spread over tasks.
    """
    t = F.col("ts").cast("timestamp").cast("double")
    p = points.withColumn("_t", t)
    first = p.groupBy("stream").agg(F.min(F.struct("_t", "done")).alias("_f"))
    here = F.struct("_t", "done")
    both = p.select("*", (F.col("_t") - seconds).alias("_w"), F.lit(0).alias("_k")).unionByName(p.select("stream", "_t", "done", F.col("_t").alias("_w"), F.lit(1).alias("_k")), allowMissingColumns=True)
    asked = last_before(both, ["stream"], ["_w", "_k", "_t"], F.when(F.col("_k") == 1, here), "_p").where("_k = 0")  # a question comes before the points of its time
    p = asked.join(small(first), "stream").withColumn("_o", F.coalesce("_p", "_f"))
    dt = F.col("_t") - F.col("_o._t")
    return p.withColumn("per_minute", F.when(dt > 0, (F.col("done") - F.col("_o.done")) / dt * 60).otherwise(0.0)).select(*points.columns, "per_minute")
