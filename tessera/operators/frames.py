"""Frames and raw detections: requested frames, attribute clean-up, seeds, scan totals and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vec
from tessera.functions.scalar import base_name, clamp, frame_index, label_key
from tessera.operators.sampling import SCAN_SUMS, sample_times


def prefetch_indices(items: DataFrame, steps: tuple[float, ...] = (2.0, 1.0, 1.0, 0.5)) -> DataFrame:
    """entity_id and frame_index of the frames a scan may ask for: a grid at the smallest positive step (0.25 s at least)
    over items(entity_id, fps, frames, scan), its start and its end."""
    step = max(0.25, min((s for s in steps if s > 0), default=1.0))
    times = F.array_union(sample_times(F.col("scan"), step), F.array(F.lit(0.0), F.col("scan")))
    at = items.select("entity_id", "fps", "frames", F.explode(times).alias("ts"))
    return at.where("frames > 0").select("entity_id", frame_index(F.col("ts"), F.col("fps"), F.col("frames")).alias("frame_index")).distinct()


def requested(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames asked for, each once; those that cannot be read have null features."""
    return wanted.select("entity_id", "frame_index").distinct().join(frames, ["entity_id", "frame_index"], "left")


def hash_positions(frames: Column, samples: int = 6) -> Column:
    """Distinct frame numbers at `samples` (3 at least) even fractions from 8 % to 92 %, ties to even."""
    n = max(3, samples)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround((F.lit(0.08) + (0.84 / (n - 1)) * k) * F.greatest(frames - 1, F.lit(0))).cast("int"))
    return F.when(frames > 0, F.array_distinct(F.transform(at, lambda i: F.greatest(F.lit(0), F.least(frames - 1, i))))).otherwise(F.array().cast("array<int>"))


def attribute(raw: Column) -> Column:
    """A class attribute rounded to 0 or 1; null if it is neither."""
    r = F.bround(raw)
    return F.when(r.isin(0.0, 1.0), r.cast("int"))


def age(raw: Column) -> Column:
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), raw))


def pose(raw: Column) -> Column:
    """struct(yaw, pitch) of a pose array: its first two entries, null where not finite or short."""
    fit = lambda k: F.when((F.size(raw) >= 2) & ~F.isnan(F.try_element_at(raw, F.lit(k))) & (F.abs(F.try_element_at(raw, F.lit(k))) < float("inf")), F.try_element_at(raw, F.lit(k)))
    return F.struct(fit(1).alias("yaw"), fit(2).alias("pitch"))


def landmark_confidence(explicit: Column, finite_share: Column, prob: Column) -> Column:
    """The explicit confidence, else the share of finite points, times what else is known; else the detection's own."""
    one = F.lit(1.0)
    p, share = clamp(prob), clamp(finite_share)
    return F.when(explicit.isNotNull(), clamp(explicit) * F.coalesce(share, one) * F.coalesce(p, one)).when(share.isNotNull(), share * F.coalesce(p, one)).otherwise(p)


def complete_seed(rows: DataFrame) -> DataFrame:
    """Rows whose seed is complete: time, box, embedding, label and confidence."""
    return rows.dropna(subset=["ts", "box", "embedding", "label", "label_conf"])


def provisional(rows: DataFrame) -> DataFrame:
    """Uncertain rows without an embedding take the seed's, if it is usable."""
    seed = vec.normalized(F.col("seed_embedding"))
    take = (label_key(F.col("decision_label")) == "uncertain") & F.col("embedding").isNull() & seed.isNotNull()
    return rows.withColumn("embedding_source", F.when(take, "provisional").otherwise(F.col("embedding_source"))).withColumn("embedding", F.when(take, F.col("seed_embedding")).otherwise(F.col("embedding")))


def scan_totals(infos: DataFrame) -> DataFrame:
    """Scan counters of an entity's windows: sums, and the best seed."""
    return infos.groupBy("entity_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SCAN_SUMS), F.coalesce(F.max("best_seed"), F.lit(0.0)).alias("best_seed"))


def cache_feedback(moved: DataFrame) -> DataFrame:
    """Events of moved cache rows (source_path, from_label, to_label, confidence, embedding, aux_embedding): a positive one
    for the new label and, if the label changed, a negative one for the old. Rows without a usable vector give none."""
    e, a = vec.normalized(F.col("embedding")), vec.normalized(F.col("aux_embedding"))
    usable = moved.withColumn("embedding", e).withColumn("aux_embedding", a).where(F.col("embedding").isNotNull() | F.col("aux_embedding").isNotNull())
    changed = label_key(F.col("from_label")) != label_key(F.col("to_label"))
    kinds = F.array_compact(F.array(F.lit("positive"), F.when(changed, F.lit("negative"))))
    out = usable.withColumn("event_type", F.explode(kinds))
    pos = F.col("event_type") == "positive"
    return out.select("source_path", "event_type", F.col("to_label").alias("label"), F.when(~pos, F.col("from_label")).alias("negative_label"), "confidence", F.when(pos, F.col("embedding")).alias("embedding"), F.when(pos, F.col("aux_embedding")).alias("aux_embedding"))


def display(rows: DataFrame) -> DataFrame:
    """name, decision, confidence to three places, summary, tags and the label to show, as strings."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    filled = lambda c: F.nullif(text(c), F.lit(""))
    return rows.select(
        F.coalesce(filled("name"), base_name(text("path"))).alias("name"),
        text("decision_label").alias("decision"),
        F.format_string("%.3f", F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))).alias("confidence"),
        text("reason_summary").alias("reason_summary"),
        F.array_join(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t) != ""), ", ").alias("tags"),
        F.coalesce(filled("folder"), filled("match_label"), filled("decision_label"), F.lit("unknown")).alias("shown_as"),
    )


def pending(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items that wait for review and whose file is there."""
    return items.where("status = 'pending'").join(files.select(F.col("path").alias("pending_path")), "pending_path", "left_semi")


def inside(selected: DataFrame, folder: str) -> DataFrame:
    """The rows, after an error for any path outside the folder."""
    ok = F.col("path").startswith(folder.rstrip("/") + "/")
    return selected.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not inside the source folder: "), F.col("path")))))


def representative(detections: DataFrame) -> DataFrame:
    """The detection of each entity with the highest area ratio * prob * landmark; the first wins ties."""
    score = F.greatest(F.lit(0.0), F.col("area_ratio")) * F.greatest(F.lit(0.0), F.col("prob")) * clamp(F.coalesce("landmark", F.col("prob")))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc(score), "seq"))
    return detections.withColumn("_r", rank).where("_r = 1").drop("_r")


def run_id() -> Column:
    """UTC time and eight random hex digits."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z-'"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))


def projection(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """key, x and y on the two leading principal axes; each axis points where its largest weight is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(vec.doubles(F.col(vector))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    axes = model.pc.toArray()
    sign = [1.0 if axes[abs(axes[:, k]).argmax(), k] > 0 else -1.0 for k in range(2)]
    p = vector_to_array("p")
    return model.transform(rows).select(key, (p[0] * sign[0]).alias("x"), (p[1] * sign[1]).alias("y"))
