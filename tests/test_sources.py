import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import files
from tessera.streaming import progress


def test_broken_and_missing_state(spark, tmp_path):
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "good.json").write_text('{"label": "a", "n": 1}')
    (tmp_path / "bad.json").write_text("{not json")
    assert [tuple(r) for r in files.json_state(spark, str(tmp_path / "good.json"), schema).collect()] == [("a", 1)]
    assert files.json_state(spark, str(tmp_path / "bad.json"), schema).count() == 0
    assert files.json_state(spark, str(tmp_path / "none.json"), schema).count() == 0


def test_log_lines(spark):
    lines = spark.createDataFrame([('[RESULT_JSON] {"a": 1}',), ("[RESULT_JSON] [1]",), ("noise",), ("[PROGRESS] done=3 total=x",)], "value string")
    assert [r["a"] for r in files.result_lines(lines, "a int").collect()] == [1]
    p = lines.where("value like '[PROGRESS]%'").select(files.progress(F.col("value")).alias("p")).first()["p"]
    assert p == {"done": 3}


def test_media_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.mp4").write_bytes(b"xy")
    assert [(r["path"], r["size"]) for r in files.media_files(spark, str(tmp_path)).collect()] == [("sub/a.mp4", 2)]


def streamed(spark, folder, df, parts, seed=1):
    """df as files in shuffled order, a row that lets the watermark pass everything last."""
    import random

    order = list(range(parts))
    random.Random(seed).shuffle(order)
    rows = df.withColumn("_f", F.pmod(F.xxhash64(*df.columns[:3]), F.lit(parts))).cache()
    for k in order:
        rows.where(F.col("_f") == k).drop("_f").coalesce(1).write.mode("append").parquet(folder)


def test_streamed_prototypes_equal_the_fold(spark, tmp_path):
    """Events out of order, at equal times, with zero vectors, and ones without a vector."""
    from tessera.operators import memory

    rows = [(f"l{i % 2}", i // 3, i, None if i % 7 == 0 else 0.5, [0.0, 0.0] if i in (0, 1, 9) else None if i == 5 else [float(i % 5), 1.0]) for i in range(40)]
    schema = "label string, ts bigint, event_id bigint, confidence double, embedding array<double>"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("ts") + 10**9))
    streamed(spark, str(tmp_path / "in"), df, 4)
    spark.createDataFrame([("end", 10**6, 99, 0.5, [1.0, 1.0])], schema).withColumn("ts", F.timestamp_seconds(F.col("ts") + 10**9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}
    stream = progress.prototype_state(progress.events(spark, str(tmp_path / "in"), df.schema, files=1), "1 hour")
    progress.drain(stream, str(tmp_path / "cp"), lambda b, _: seen.update({r["label"]: r for r in b.collect()}), "update")
    want = {r["label"]: r for r in memory.prototypes(df).collect()}
    assert set(want) == set(seen) - {"end"}
    for label, r in want.items():
        assert seen[label]["sample_count"] == r["sample_count"] and abs(seen[label]["confidence_sum"] - r["confidence_sum"]) < 1e-9
        assert all(abs(a - b) < 1e-9 for a, b in zip(seen[label]["prototype"], r["prototype"]))


def test_streamed_rate_equals_the_rolling_one(spark, tmp_path):
    from tessera.operators import sampling

    points = [(k % 2, (k * k) % 5000 + k, k) for k in range(80)]
    df = spark.createDataFrame(points, "stream bigint, ts bigint, done bigint").withColumn("ts", F.timestamp_seconds(F.col("ts") + 10**9))
    streamed(spark, str(tmp_path / "in"), df, 3)
    spark.createDataFrame([(9, 10**7, 0)], "stream bigint, ts bigint, done bigint").withColumn("ts", F.timestamp_seconds(F.col("ts") + 10**9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    s = progress.rolling_state(progress.events(spark, str(tmp_path / "in"), df.schema, files=1), 300, "3 hours")
    progress.drain(s, str(tmp_path / "cp"), lambda b, _: got.extend(tuple(r) for r in b.collect()), "update")
    want = sorted((r["stream"], r["ts"], r["done"], round(r["per_minute"], 6)) for r in sampling.rolling_rate(df).collect())
    assert sorted((a, b, c, round(d, 6)) for a, b, c, d in got if a != 9) == want and any(r[3] for r in want)


def test_stream_counters_and_rates(spark, tmp_path):
    e = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, if(id % 2 = 0, 'a', 'b') as decision_label from range(20)")
    e.write.parquet(str(tmp_path / "in"))
    got = {}
    s = progress.events(spark, str(tmp_path / "in"), "ts timestamp, decision_label string")
    progress.drain(progress.counters(s), str(tmp_path / "c1"), lambda b, _: got.update({r["decision_label"]: r["n"] for r in b.collect()}), "complete")
    assert got == {"a": 10, "b": 10}
    rates = []
    progress.drain(progress.windowed_rate(s), str(tmp_path / "c2"), lambda b, _: rates.extend(r["per_minute"] for r in b.collect()), "update")
    assert max(rates) > 0


def test_entry_stands_without_the_llm_subpackage():
    root = Path(__file__).resolve().parent.parent
    code = f"import sys; sys.path.insert(0, {str(root)!r}); sys.modules['tessera.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
