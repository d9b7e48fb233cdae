"""A whole run: measured tracks in, decisions, folders, moves, review queue, learned thresholds and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import vec
from tessera.functions.fusion import Fusion
from tessera.functions.scalar import base_name, folder_name, half_up, label_key
from tessera.operators import clusters as groups
from tessera.operators import media, memory, review, sampling, votes
from tessera.operators.memory import FOUND, UNCERTAIN
from tessera.operators.similarity import best_identity
from tessera.session import cut, small


def clustered(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(path, cluster_id) of rows that have a usable embedding, by the settings of the run."""
    usable = rows.where(F.col("error").isNull() & ~F.coalesce("stopped", F.lit(False))).select("path", "embedding")
    return groups.cluster(usable, cfg.eps, cfg.min_samples, cfg.merge_threshold, "path", "embedding")


def decisions(measured: DataFrame, identities: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows with decision_label, decision_reason, confidence, match, applied, match_label, tags and reason_summary.

    measured has path, error, stopped, embedding, the columns of `review.decide`, faces and low_area; identities has
    position, label and prototype, and may have locked and match_threshold. With cfg.reid a second vector (aux_embedding of a row,
    aux_prototype of an identity) decides where the first is in doubt. Rows that failed or were stopped
    are labelled so, with confidence 0, and match nothing.
    """
    rows = review.decide(measured, cfg.min_stable, cfg.min_votes, cfg.least_ratio)
    rows = best_identity(rows, identities, cfg.same_threshold, Fusion(cfg.reid, cfg.reid_weight, cfg.reid_least, cfg.reid_low, cfg.reid_high))
    ended = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("stopped", F.lit(False)), "stopped")
    rows = rows.withColumn("match", F.when(ended.isNull() & F.col("match.label").isNotNull(), F.col("match")))
    known = identities.select(F.col("label").alias("_known"), *(F.col(c) if c in identities.columns else F.lit(None).cast(t).alias(c) for c, t in (("locked", "boolean"), ("match_threshold", "double"))))
    rows = rows.join(small(known), F.col("match.label") == F.col("_known"), "left").drop("_known")
    rows = memory.assist(rows, memory.Assist(cfg.auto_threshold, cfg.suggest_threshold))
    score = F.format_string("(score=%.3f, threshold=%.3f)", "match.score", "threshold_used")
    suggested = ~F.col("applied") & F.col("folder").isNotNull()
    said = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(ended == "stopped", "Stopped before the end.")
        .when(F.col("applied"), F.concat(F.when(F.coalesce("locked", F.lit(False)), "Locked identity ").otherwise("Learned identity "), "match.label", F.lit(" applied "), score, F.lit(".")))
        .when(suggested, F.concat(F.lit("Memory suggests "), "match.label", F.lit(" "), score, F.lit(", below the threshold to apply it.")))
        .otherwise(F.col("decision_reason"))
    )
    rows = (
        rows.withColumn("decision_reason", said)
        .withColumn("decision_label", F.coalesce(ended, F.col("final_label")))
        .withColumn("confidence", F.when(ended.isNotNull(), 0.0).otherwise(F.col("final_confidence")))
        .withColumn("match_label", F.coalesce("match.label", F.lit("")))
    )
    return review.reason_tags(rows, cfg.min_stable, cfg.min_votes).drop("final_label", "final_confidence")


def routed(decided: DataFrame, clusters: DataFrame, cfg: Config = Config(), taken: DataFrame | None = None) -> DataFrame:
    """Adds cluster_id, folder, route, destination (a folder; null where the file stays) and target (the file's new name).

    clusters has path and cluster_id. An applied identity names the folder, else the cluster does; uncertain rows
    without one get Needs_Review as the folder suggested. Uncertain files go to Uncertain even when they are
    queued, other queued ones to a folder below Review_Pending.
    """
    folders = media.cluster_folders(clusters).withColumnRenamed("folder", "_named")
    at = clusters.join(small(folders), "cluster_id").select("path", F.col("cluster_id").alias("_cluster"), "_named")
    rows = decided.join(at, "path", "left")
    k, ended = label_key(F.col("decision_label")), F.col("error").isNotNull() | F.coalesce("stopped", F.lit(False))
    named = F.when(F.col("applied"), F.col("match_label")).otherwise(F.coalesce("_named", F.when(k == UNCERTAIN, "Needs_Review")))
    rows = rows.withColumn("cluster_id", F.when(~F.col("applied"), F.col("_cluster"))).withColumn("folder", F.when(~ended & named.isNotNull(), folder_name(named)))
    rows = review.destination(rows, cfg.review, cfg.review_threshold).drop("_cluster", "_named")
    wishes = rows.where(F.col("destination").isNotNull()).select("path", F.col("destination").alias("folder"), base_name(F.col("path")).alias("name"))
    return rows.join(media.move_plan(wishes, taken).select("path", "target"), "path", "left")


def sort_run(measured: DataFrame, identities: DataFrame, cfg: Config = Config(), clusters: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """`decisions`, then `routed`, over clusters given or made; paths must be unique."""
    decided = cut(decisions(measured, identities, cfg))
    return routed(decided, clustered(decided, cfg) if clusters is None else clusters, cfg, taken)


def seed_gate(cfg: Config = Config()) -> votes.Gate:
    """The gate of a run's detections."""
    return votes.Gate(cfg.gate_side, cfg.gate_sharpness, cfg.gate_yaw, cfg.gate_pitch, cfg.gate_landmark)


def schedule(spans: DataFrame, frames: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(entity_id, ts) at which a run looks at spans(entity_id, duration): on its grid, and by cfg.scene_aware also around scene changes of
    frames(entity_id, ts, hist, deviation, edges), without still frames."""
    if not cfg.scene_aware:
        return spans.select("entity_id", F.explode(sampling.sample_times(F.col("duration"), cfg.sample_every)).alias("ts"))
    still = (F.coalesce("deviation", F.lit(0.0)) <= cfg.scene_static_deviation) & (F.coalesce("edges", F.lit(0.0)) <= cfg.scene_static_edges)
    seen = cut(sampling.scene_changes(frames.select("entity_id", "ts", "hist", still.alias("static")), cfg.scene_threshold))
    return sampling.scene_schedule(spans, seen.where("change").select("entity_id", "ts"), seen.where("static").select("entity_id", "ts"), cfg.sample_every, cfg.scene_dense_window, cfg.scene_dense_step, cfg.scene_scan_step)


def queue_items(rows: DataFrame) -> DataFrame:
    """The review items of a routed run, all pending."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.where("route = 'queue'").select(
        F.sha1("path").alias("id"), F.col("path").alias("source_path"), F.concat_ws("/", "destination", "target").alias("pending_path"), F.col("decision_label").alias("predicted_label"),
        text("decision_reason").alias("reason"), "confidence", F.coalesce("folder", F.lit("Entity_Unknown")).alias("suggested_folder"), "match_label", F.coalesce("match.score", F.lit(0.0)).alias("match_score"),
        "applied", "embedding", F.lit("pending").alias("status"), (label_key(F.col("decision_label")) == UNCERTAIN).alias("from_uncertain"),
    )


def run_summary(rows: DataFrame, seconds: float = 0.0) -> DataFrame:
    """One row: the tally, files moved, queued and left, matches applied, time taken (not below 0)."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias
    more = rows.agg(n(F.col("destination").isNotNull())("moved"), n(F.col("destination").isNull())("left_in_source"), n(F.col("route") == "queue")("queued"), n(F.col("applied"))("memory_applied"), n(F.coalesce("stopped", F.lit(False)))("stopped"))
    return review.tally(rows).join(more).withColumn("seconds", F.lit(round(max(0.0, seconds), 3)))


def waiting(listing: DataFrame) -> DataFrame:
    """The rows of a listing that a run over uncertain files takes as its input."""
    return listing.where(F.col("path").startswith("Uncertain/"))


def reprocess_summary(rows: DataFrame) -> DataFrame:
    """processed, reclassified and remaining_uncertain of a run over uncertain files."""
    t = review.tally(rows)
    return t.select("processed", (F.col("processed") - F.col("uncertain")).alias("reclassified"), F.col("uncertain").alias("remaining_uncertain"))


def learned_thresholds(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """label, same_threshold, mean_distance, sd_distance and pairs of each folder of found rows with two usable embeddings."""
    found = rows.where((label_key(F.col("decision_label")) == FOUND) & F.col("folder").isNotNull() & ~F.lower("folder").isin("absent", "needs_review"))
    usable = found.select("path", F.col("folder").alias("label"), "embedding").where(vec.normalized(F.col("embedding")).isNotNull())
    stats = memory.intra_distances(usable, "label", "path", "embedding", fallback=cfg.same_threshold)
    return stats.where("pairs > 0").select("label", half_up(F.col("threshold"), 6).alias("same_threshold"), "mean_distance", "sd_distance", "pairs")
