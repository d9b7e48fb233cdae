"""Detections: gates, ranks and votes."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import clamp


@dataclass(frozen=True)
class Gate:
    least_side: int = 80
    least_sharpness: float = 60.0
    most_yaw: float = 45.0
    most_pitch: float = 45.0
    least_landmark: float = 0.45


def reject_reason(rule: Gate = Gate()) -> Column:
    """The first reason against a detection (width, height, sharpness, yaw, pitch, landmark); null if it passes.
    Unknown pose or landmark passes."""
    w, h = F.col("width"), F.col("height")
    return (
        F.when(w.isNull() | h.isNull() | (w <= 0) | (h <= 0), "empty")
        .when((w < rule.least_side) | (h < rule.least_side), "small")
        .when(F.coalesce("sharpness", F.lit(0.0)) < rule.least_sharpness, "blurred")
        .when((F.abs("yaw") > rule.most_yaw) | (F.abs("pitch") > rule.most_pitch), "pose")
        .when(F.col("landmark") < rule.least_landmark, "landmark")
    )


def gate_counts(detections: DataFrame, rule: Gate = Gate()) -> DataFrame:
    return detections.select(F.coalesce(reject_reason(rule), F.lit("passed")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def top_detections(detections: DataFrame, most: int = 4, least_prob: float = 0.9, filter_first: bool = True) -> DataFrame:
    """The `most` detections of a frame by area * prob, cut after the confidence filter or before it."""
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc(F.col("area") * F.col("prob")), "det_id"))
    sure = F.col("prob") >= least_prob
    if filter_first:
        return detections.where(sure).withColumn("rank", rank).where(F.col("rank") <= most)
    return detections.withColumn("rank", rank).where((F.col("rank") <= most) & sure)


def class_of(attribute: Column, missing: str = "unknown") -> Column:
    """target, other or unknown of a 0/1 attribute; the policy for a missing one is a parameter ("positive": target)."""
    return F.when(F.round(attribute) == 1, "other").when(F.round(attribute) == 0, "target").otherwise("target" if missing == "positive" else "unknown")


def subject_vote(rows: DataFrame, floor: float = 0.02, ceil: float = 0.12, least_frames: int = 3) -> DataFrame:
    """One row per entity_id of its area-weighted class vote, over rows (entity_id, pos, matched, label, label_conf, area,
    area_ratio), a row for each attempted frame."""
    c, m = F.col, F.coalesce("matched", F.lit(False))
    weight = F.greatest(F.lit(1.0), c("area")) * c("label_conf")
    sums = rows.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(m).alias("frames"),
        F.coalesce(F.sum(F.when(m & (c("label") == "target") & (c("label_conf") > 0), weight)), F.lit(0.0)).alias("target_weight"),
        F.coalesce(F.sum(F.when(m & (c("label") == "other") & (c("label_conf") > 0), weight)), F.lit(0.0)).alias("other_weight"),
        F.max(F.when(m, c("pos"))).alias("last"),
        F.min(F.when(m, c("pos"))).alias("first"),
        F.coalesce(F.avg(F.when(m, c("area_ratio"))), F.lit(0.0)).alias("area_ratio"),
    )
    total = c("target_weight") + c("other_weight")
    out = sums.withColumn("winner", F.when(total <= 0, "unknown").when(c("target_weight") >= c("other_weight"), "target").otherwise("other"))
    out = out.withColumn("vote", F.when(total > 0, F.greatest("target_weight", "other_weight") / total).otherwise(0.0))
    out = out.withColumn("appearance", c("frames") / c("attempted")).withColumn("coverage", F.coalesce(clamp((c("last") - c("first") + 1) / c("attempted")), F.lit(0.0)))
    size = clamp((c("area_ratio") - floor) / (ceil - floor))
    out = out.withColumn("consistency", clamp(0.60 * clamp(c("appearance")) + 0.30 * size + 0.10 * c("coverage")))
    sure = clamp(0.55 * c("vote") + 0.45 * c("consistency"))
    return out.withColumn("confidence", F.when(c("frames") < least_frames, sure * 0.7).otherwise(sure))


def verified(rows: DataFrame, frames: int = 2, least_conf: float = 0.65, least_ratio: float = 0.62) -> DataFrame:
    """votes, scores and `verified` per entity_id over candidate votes (entity_id, label, label_conf).

    Scores are summed and held against the ratio as decimals (confidences to 15 places), so a share of just the ratio counts
    whatever order the votes are added in.
    """
    if frames < 2:
        raise ValueError("two positive votes are always needed: frames must be 2 or more")
    c = F.col
    conf = c("label_conf").try_cast("decimal(18,15)")
    sum_of = lambda label: F.sum(F.when(c("label") == label, conf).otherwise(F.lit(0).cast("decimal(18,15)")))
    counted = rows.where(c("label").isin("target", "other") & (c("label_conf") > 0))
    out = counted.groupBy("entity_id").agg(F.count(F.lit(1)).alias("votes"), F.count_if((c("label") == "target") & (c("label_conf") >= least_conf)).alias("pos_votes"), sum_of("target").alias("_pos"), sum_of("other").alias("_neg"))
    ratio = Decimal(str(least_ratio))
    enough = c("_pos") * F.lit(1 - ratio) >= c("_neg") * F.lit(ratio)
    out = out.withColumn("verified", (c("votes") >= frames) & (c("pos_votes") >= max(2, frames - 1)) & (c("_pos") + c("_neg") > 0) & enough & (c("_pos") > c("_neg")))
    return out.select("entity_id", "votes", "pos_votes", c("_pos").cast("double").alias("pos_score"), c("_neg").cast("double").alias("neg_score"), "verified")


def best_match(detections: DataFrame, similarity: Column) -> DataFrame:
    """The most similar detection of each frame; the first wins ties."""
    d = detections.withColumn("similarity", similarity)
    return d.groupBy("frame_id").agg(F.max_by(F.struct(*d.columns), F.struct("similarity", -F.col("det_id"))).alias("best")).select("best.*")


def boxes(rows: DataFrame, margin: float = 0.0, inclusive: bool = True) -> DataFrame:
    """Boxes (x1, y1, x2, y2) expanded by a margin and held to the frame (frame_w, frame_h), their sides and area ratio.
    `inclusive` holds the far corner to the last pixel, else to the frame's extent."""
    c, less = F.col, 1 if inclusive else 0
    mx, my = (c("x2") - c("x1")) * margin, (c("y2") - c("y1")) * margin
    hold = lambda x, top: F.greatest(F.lit(0), F.least(F.floor(x).cast("int"), top))
    out = rows.select("*", hold(c("x1") - mx, c("frame_w") - 1).alias("bx1"), hold(c("y1") - my, c("frame_h") - 1).alias("by1"), hold(c("x2") + mx, c("frame_w") - less).alias("bx2"), hold(c("y2") + my, c("frame_h") - less).alias("by2"))
    out = out.withColumn("width", F.greatest(F.lit(0), c("bx2") - c("bx1"))).withColumn("height", F.greatest(F.lit(0), c("by2") - c("by1")))
    return out.withColumn("area_ratio", F.when(c("frame_w") * c("frame_h") > 0, c("width") * c("height") / (c("frame_w") * c("frame_h"))).otherwise(0.0))
