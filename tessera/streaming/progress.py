"""Event streams: counters, windowed rates, feedback state and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.session import carried

carried(__name__)


def events(spark: SparkSession, folder: str, schema: str, files: int = 16, kind: str = "parquet") -> DataFrame:
    """A file stream that takes `files` files a trigger at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)


def counters(stream: DataFrame) -> DataFrame:
    """Running counts by decision (complete mode)."""
    return stream.groupBy("decision_label").agg(F.count(F.lit(1)).alias("n"))


def windowed_rate(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events per minute in sliding windows on a fixed grid; late events beyond the watermark are dropped."""
    minutes = int(width.split()[0])
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg((F.count(F.lit(1)) / minutes).alias("per_minute"))


#: The only store that keeps lists and timers for a key.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(stream: DataFrame, key: str, ts: str, order: list[str], late: str, state: str, out: str, step: Callable) -> DataFrame:
    """Rows of each key handed to `step` in event-time order, whatever the order of their coming.

    Rows wait in a list until the watermark (`late` behind the newest event) has passed them, a timer for the earliest wakes the
    key, and those that are due go to step(key, state, rows) in the order of (ts, *order). It returns the new state (a tuple of the
    fields in `state`, None before the first row) and the rows to give out, of the fields in `out`. A row later than the watermark
    is dropped. What is newer than the watermark waits for a later event.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import StructType

    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late).withColumn("at_us", F.unix_micros(F.col(ts).cast("timestamp")))
    names = rows.columns
    at, by = names.index("at_us"), [names.index("at_us"), *(names.index(c) for c in order)]
    waiting = StructType([f for f in rows.drop(ts).schema.fields])
    kept = [k for k, c in enumerate(names) if c != ts]
    out_names = StructType.fromDDL(out).names

    class InOrder(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", waiting)
            self.state = handle.getValueState("state", state)

        def _wake(self, us: int) -> None:
            self.handle.registerTimer(-(-us // 1000))

        def handleInputRows(self, key, rows, timerValues):
            for b in rows:
                if len(b):
                    self._wake(int(b["at_us"].min()))
                    self.waiting.appendList([tuple(_plain(r[k]) for k in kept) for r in b.itertuples(index=False, name=None)])
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs() * 1000
            held = [tuple(r) for r in self.waiting.get()]
            spot = {k: n for n, k in enumerate(kept)}
            place = lambda r: tuple(r[spot[k]] for k in by)
            due = sorted((r for r in held if r[spot[at]] <= now), key=place)
            rest = [r for r in held if r[spot[at]] > now]
            if due:
                fields = [names[k] for k in kept]
                new, given = step(key[0], tuple(self.state.get()) if self.state.exists() else None, [dict(zip(fields, r)) for r in due])
                self.state.update(new)
                if rest:
                    self.waiting.put(rest)
                    self._wake(min(r[spot[at]] for r in rest))
                else:
                    self.waiting.clear()
                if given:
                    yield pd.DataFrame(given, columns=out_names)

        def close(self) -> None:
            pass

    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=InOrder(), outputStructType=out, outputMode="Update", timeMode="EventTime")


def _plain(x):
    """A value of a pandas row as Python has it; lists for arrays, None for what is missing."""
    import numpy as np

    if isinstance(x, np.ndarray):
        return [None if v is None else float(v) if isinstance(v, (float, np.floating)) else v for v in x.tolist()]
    if isinstance(x, np.generic):
        x = x.item()
    return None if x is None or x != x else x


def prototype_state(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """label, sample_count, confidence_sum and prototype whenever they change: memory.prototypes over a stream
    (label, ts, event_id, confidence, embedding), events in order of (ts, event_id) once the watermark has passed them."""
    from tessera.functions import vec
    from tessera.operators.memory import folded

    def step(label, state, rows):
        import numpy as np

        n, conf, proto = state or (0, 0.0, None)
        proto = None if proto is None else np.asarray(proto, float)
        for r in rows:
            c = r["confidence"] or 0.0
            proto, on = folded(proto, n, np.asarray(r["embedding"], float))
            n, conf = (n + 1, conf + c) if on else (1, c)
        return (n, conf, proto.tolist()), [(label, n, conf, proto.tolist())]

    usable = stream.select("label", "ts", "event_id", F.col("confidence").cast("double").alias("confidence"), vec.doubles(F.col("embedding")).alias("embedding")).where("embedding is not null")
    return in_order(usable, "label", "ts", ["event_id"], late, "n bigint, conf double, proto array<double>", "label string, sample_count bigint, confidence_sum double, prototype array<double>", step)


def rolling_state(stream: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """stream, ts, done and per_minute of points(stream, ts, done), as sampling.rolling_rate has it: since the oldest point of the last
    `seconds`, and the one before it. A key holds those points alone."""

    def step(name, state, rows):
        times, done = (list(x) for x in state) if state else ([], [])
        out = []
        for r in rows:
            t = r["at_us"]
            times.append(t)
            done.append(r["done"])
            old = 0
            while old + 1 < len(times) and times[old + 1] < t - seconds * 1_000_000:
                old += 1
            del times[:old], done[:old]
            dt = (t - times[0]) / 1e6
            out.append((name, t, r["done"], (r["done"] - done[0]) / dt * 60 if dt > 0 else 0.0))
        return (times, done), out

    points = stream.select("stream", "ts", F.col("done").cast("bigint").alias("done"))
    kind = dict(points.dtypes)["stream"]
    got = in_order(points, "stream", "ts", ["done"], late, "times array<bigint>, done array<bigint>", f"stream {kind}, us bigint, done bigint, per_minute double", step)
    return got.select("stream", F.timestamp_micros("us").alias("ts"), "done", "per_minute")


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs what is there to the end through foreachBatch and stops."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return q
