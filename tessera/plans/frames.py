"""Queries over events as raw detections, scans and cache rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import frames, votes
from tessera.plans.events import _EV, _events
from tessera.plans.registry import query, table


@query("WITH d AS (SELECT doc_id, 10.0::DOUBLE + doc_id % 20 AS fps, CAST(n_chars AS INTEGER) AS frames, least(8.0::DOUBLE, n_chars / 100.0::DOUBLE) AS scan FROM documents), t AS (SELECT doc_id, fps, frames, unnest(list_concat(list_transform(range(0, CAST(ceil((scan + 0.25) / 0.5) AS BIGINT)), lambda k: k * 0.5::DOUBLE), [0.0::DOUBLE, scan])) AS ts FROM d WHERE frames > 0) SELECT DISTINCT doc_id, CAST(greatest(0, least(frames - 1, trunc(ts * fps))) AS INTEGER) AS frame_index FROM t")
def prefetch_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), (10.0 + F.col("doc_id") % 20).alias("fps"), F.col("n_chars").cast("int").alias("frames"), F.least(F.lit(8.0), F.col("n_chars") / 100.0).alias("scan"))
    return frames.prefetch_indices(d).select(F.col("entity_id").alias("doc_id"), "frame_index")


@query("WITH w AS (SELECT DISTINCT user_id, event_id % 30 AS frame_index FROM events), f AS (SELECT user_id, event_id % 30 AS frame_index, min(value) AS sharpness FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2) SELECT user_id, frame_index, coalesce(sharpness, -1) AS sharpness FROM w LEFT JOIN f USING (user_id, frame_index)")
def requested_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), (F.col("event_id") % 30).alias("frame_index"), "value", "event_id")
    f = e.where("event_id % 3 = 0").groupBy("entity_id", "frame_index").agg(F.min("value").alias("sharpness"))
    return frames.requested(e, f).select(F.col("entity_id").alias("user_id"), "frame_index", F.coalesce("sharpness", F.lit(-1.0)).alias("sharpness"))


@query("WITH d AS (SELECT doc_id, n_chars AS n FROM documents), p AS (SELECT doc_id, n, unnest(range(0, 6)) AS k FROM d WHERE n > 0), i AS (SELECT doc_id, greatest(0, least(n - 1, CAST(round_even((0.08::DOUBLE + (0.84::DOUBLE / 5) * k) * (n - 1), 0) AS BIGINT))) AS i FROM p) SELECT doc_id, array_to_string(list(DISTINCT i ORDER BY i), ',') AS positions FROM i GROUP BY doc_id")
def hash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("n_chars > 0")
    return d.select("doc_id", F.array_join(frames.hash_positions(F.col("n_chars")), ",").alias("positions"))


@query(f"WITH {_EV} SELECT event_id, CASE WHEN round_even(value / 200, 0) IN (0, 1) THEN CAST(round_even(value / 200, 0) AS INTEGER) ELSE -1 END AS attribute, greatest(0.0, value - 100) AS age, floor(CASE WHEN event_id % 3 = 0 THEN least(1.0, k / 90.0::DOUBLE) * CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0.5 END * (event_id % 10 / 10.0::DOUBLE) WHEN event_id % 4 <> 0 THEN 0.5 * (event_id % 10 / 10.0::DOUBLE) ELSE event_id % 10 / 10.0::DOUBLE END * 10000 + 0.5) / 10000 AS landmark FROM ev")
def detection_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    lm = frames.landmark_confidence(F.when(i % 3 == 0, F.col("k") / 90.0), F.when(i % 4 != 0, F.lit(0.5)), (i % 10) / 10.0)
    return _events(spark, sf_dir).select("event_id", F.coalesce(frames.attribute(v / 200), F.lit(-1)).alias("attribute"), frames.age(v - 100).alias("age"), (F.floor(lm * 10000 + 0.5) / 10000).alias("landmark"))


@query(f"WITH {_EV} SELECT event_id, CAST(greatest(0, least(floor(k - 5 - 0.1::DOUBLE * 50), 99)) AS INTEGER) AS bx1, CAST(greatest(0, least(floor(k - 5 + 50 + 0.1::DOUBLE * 50), 99)) AS INTEGER) AS bx2 FROM ev")
def expanded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    b = _events(spark, sf_dir).select("event_id", (k - 5).alias("x1"), (k + 45).alias("x2"), (k - 5).alias("y1"), (k + 45).alias("y2"), F.lit(100).alias("frame_w"), F.lit(100).alias("frame_h"))
    return votes.boxes(b, 0.1).select("event_id", "bx1", "bx2")


@query(f"WITH {_EV} SELECT user_id, CAST(sum(k) AS BIGINT) AS seeds, CAST(sum(k + 1) AS BIGINT) AS faces, CAST(sum(event_id % 7) AS BIGINT) AS low_area, max(value / 500) AS best_seed FROM ev GROUP BY user_id")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("entity_id"), F.col("k").alias("seeds"), (F.col("k") + 1).alias("faces"), (F.col("event_id") % 7).alias("low_area"), *(F.lit(0).alias(c) for c in frames.SCAN_SUMS[3:]), (F.col("value") / 500).alias("best_seed"))
    return frames.scan_totals(e).select(F.col("entity_id").alias("user_id"), "seeds", "faces", "low_area", "best_seed")


@query("WITH m AS (SELECT vec_id, 'l' || label AS a, 'L' || (CASE WHEN vec_id % 3 = 0 THEN label ELSE label + 1 END) AS b FROM embeddings WHERE vec_id % 5 <> 0) SELECT vec_id, 'positive' AS event_type, b AS label, '' AS negative_label FROM m UNION ALL SELECT vec_id, 'negative', b, a FROM m WHERE lower(a) <> lower(b)")
def cache_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    m = table(spark, sf_dir, "embeddings").select(i.alias("source_path"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("from_label"), F.concat(F.lit("L"), F.when(i % 3 == 0, F.col("label")).otherwise(F.col("label") + 1).cast("string")).alias("to_label"), F.lit(0.5).alias("confidence"), F.when(i % 5 != 0, F.col("embedding")).alias("embedding"), F.lit(None).cast("array<float>").alias("aux_embedding"))
    return frames.cache_feedback(m).select(F.col("source_path").alias("vec_id"), "event_type", "label", F.coalesce("negative_label", F.lit("")).alias("negative_label"))


@query("SELECT event_id, 'f' || event_id || '.mp4' AS name, CASE WHEN event_id % 4 = 0 THEN 'folder' WHEN event_id % 4 = 1 THEN 'match' ELSE event_type END AS shown_as, CASE WHEN event_id % 2 = 0 THEN 'a, b' ELSE '' END AS tags FROM events")
def result_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    r = table(spark, sf_dir, "events").select(F.lit("").alias("name"), F.concat(F.lit("in/f"), i.cast("string"), F.lit(".mp4")).alias("path"), F.col("event_type").alias("decision_label"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("reason_summary"), F.when(i % 2 == 0, F.array(F.lit("a"), F.lit(" "), F.lit("b"))).alias("tags"), F.when(i % 4 == 0, "folder").alias("folder"), F.when(i % 4 == 1, "match").alias("match_label"))
    return frames.display(r).select(F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("event_id"), "name", "shown_as", "tags")
