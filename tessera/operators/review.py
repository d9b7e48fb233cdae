"""Decisions, their explanation, review routing, review actions and destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import base_name, clamp, folder_name, half_up, label_key, safe_float, safe_int
from tessera.operators.memory import ABSENT, FOUND, UNCERTAIN

#: Reason tags in order of priority, and the sentence of each.
TAGS = {
    "memory_match_applied": "A learned identity matched with high confidence and was applied.",
    "vote_disagreement": "The votes of the track disagreed.",
    "few_stable_embeddings": "The track gave too few stable embeddings.",
    "few_votes": "The track gave too few votes.",
    "low_area": "Most detections were too small to count as evidence.",
    "unverified_candidates": "Candidates appeared, but none was verified.",
    "memory_match_suggested": "A learned identity matched, below the threshold to apply it.",
}
FALLBACK = {FOUND: "Consistent detection of the target.", ABSENT: "No evidence of the target.", UNCERTAIN: "Evidence is weak or conflicting.", "error": "Processing failed.", "stopped": "Stopped before the end."}


def reason_tags(rows: DataFrame, min_stable: int = 3, min_votes: int = 3) -> DataFrame:
    """Adds tags (array, by priority) and reason_summary to rows with the metrics faces, low_area, stable, votes,
    pos_score, neg_score, seeds and with decision_label, decision_reason, applied and match_label."""
    c, reason = F.col, F.lower(F.coalesce("decision_reason", F.lit("")))
    holds = {
        "memory_match_applied": c("applied"),
        "vote_disagreement": ((c("pos_score") > 0) & (c("neg_score") > 0) & (c("pos_score") <= c("neg_score"))) | reason.contains("conflicting votes"),
        "few_stable_embeddings": ((c("stable") > 0) & (c("stable") < min_stable)) | reason.contains("stable embeddings") | reason.contains("could not be stabilized"),
        "few_votes": ((c("votes") > 0) & (c("votes") < min_votes)) | (reason.contains("only") & reason.contains(" votes")),
        "low_area": (c("faces") > 0) & (c("low_area") > 0) & (c("low_area") / F.greatest(F.lit(1), c("faces")) >= 0.5),
        "unverified_candidates": (c("seeds") > 0) & label_key(c("decision_label")).isin(UNCERTAIN, ABSENT) & reason.contains("none verified"),
        "memory_match_suggested": ~F.coalesce(c("applied"), F.lit(False)) & (F.trim(F.coalesce("match_label", F.lit(""))) != "") & (label_key(c("decision_label")) == UNCERTAIN),
    }
    tags = F.array_compact(F.array(*(F.when(holds[t], t) for t in TAGS)))
    said = F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair))
    fallback = F.create_map(*(F.lit(x) for pair in FALLBACK.items() for x in pair))
    plain = F.coalesce(F.nullif(F.trim("decision_reason"), F.lit("")), F.try_element_at(fallback, label_key(c("decision_label"))), F.lit("No explanation available."))
    return rows.withColumn("tags", tags).withColumn("reason_summary", F.when(F.size("tags") > 0, F.element_at(said, F.try_element_at("tags", F.lit(1)))).otherwise(plain))


def decide(rows: DataFrame, min_stable: int = 3, min_votes: int = 3, min_ratio: float = 0.62, rates: tuple[float, int, float] = (0.35, 3, 0.45)) -> DataFrame:
    """decision_label, decision_reason and confidence of rows with seeds, verified, best_seed, subject_found, appearance, subject_frames,
    consistency, subject_confidence, stable, votes, pos_score and neg_score: the first rule that holds decides."""
    c = F.col
    total = c("pos_score") + c("neg_score")
    ratio = F.when(total > 0, c("pos_score") / total).otherwise(0.0)
    weak = ~(c("subject_found") & (c("appearance") >= rates[0]) & (c("subject_frames") >= rates[1]) & (c("consistency") >= rates[2]))
    found = 0.35 + 0.20 * F.least(F.lit(1.0), c("stable") / max(1, min_stable)) + 0.25 * ratio + 0.20 * c("subject_confidence")
    said = lambda form, value: F.format_string(form, value.cast("int"))
    chain = [
        (c("seeds") <= 0, ABSENT, F.lit(0.9), F.lit("No candidate gave evidence.")),
        (~c("verified"), UNCERTAIN, 0.35 + F.least(F.lit(0.25), 0.3 * c("best_seed")), said("Candidates found (%d), none verified.", c("seeds"))),
        (weak, UNCERTAIN, 0.35 + 0.35 * c("subject_confidence"), F.format_string("Candidate is weak as a subject (appearance=%.2f, consistency=%.2f, frames=%s).", c("appearance").cast("double"), c("consistency").cast("double"), c("subject_frames").cast("string"))),
        (c("stable") < min_stable, UNCERTAIN, F.lit(0.45), said("Weak track: only %d stable embeddings.", c("stable"))),
        (c("votes") < min_votes, UNCERTAIN, F.lit(0.45), said("Weak track: only %d votes.", c("votes"))),
        ((total > 0) & ((ratio < min_ratio) | (c("pos_score") <= c("neg_score"))), UNCERTAIN, F.lit(0.5), F.format_string("Conflicting votes (for=%.3f, against=%.3f).", c("pos_score").cast("double"), c("neg_score").cast("double"))),
        (F.lit(True), FOUND, found, F.lit("Consistent detection and a stable track.")),
    ]
    label = conf = reason = None
    for test, name, value, text in chain:
        label = F.when(test, name) if label is None else label.when(test, name)
        conf = F.when(test, value) if conf is None else conf.when(test, value)
        reason = F.when(test, text) if reason is None else reason.when(test, text)
    return rows.withColumn("decision_label", label).withColumn("confidence", half_up(clamp(conf), 3)).withColumn("decision_reason", reason)


def review_route(label: Column, confidence: Column, review: bool = True, threshold: float = 0.75) -> Column:
    """direct, direct_absent or queue."""
    if not review:
        return F.lit("direct")
    k = label_key(label)
    return F.when(k == UNCERTAIN, "queue").when((k == FOUND) & (F.coalesce(confidence, F.lit(0.0)) < threshold), "queue").when(k == ABSENT, "direct_absent").otherwise("direct")


def destination(rows: DataFrame, review: bool = True, threshold: float = 0.75) -> DataFrame:
    """Adds route and destination to rows with folder, cluster_id, error and stopped.

    Files that failed or were stopped stay (null). Uncertain ones go to Uncertain, even when they are queued; other
    queued ones to their folder below Review_Pending; found ones to their folder, without one to Absent, like absent ones.
    """
    c, k = F.col, label_key(F.col("decision_label"))
    ended = c("error").isNotNull() | F.coalesce("stopped", F.lit(False))
    wish = F.coalesce(F.nullif(F.trim("folder"), F.lit("")), F.concat(F.lit("Entity_"), c("cluster_id").cast("string")))
    folder = F.when(wish.isNotNull(), folder_name(wish))
    r = review_route(c("decision_label"), c("confidence"), review, threshold)
    queue = F.concat(F.lit("Review_Pending/"), F.coalesce(folder, F.lit("Entity_Unknown")))
    to = F.when(k == UNCERTAIN, "Uncertain").when(r == "queue", queue).when(k == FOUND, F.coalesce(folder, F.lit("Absent"))).otherwise("Absent")
    return rows.withColumn("route", F.when(~ended, r)).withColumn("destination", F.when(~ended, to))


#: Measures that explain a decision: counts, scores without a bound, and a share.
COUNTS, SCORES, SHARE = ("faces", "low_area", "stable", "votes", "seeds"), ("pos_score", "neg_score"), "best_seed"


def metrics(rows: DataFrame) -> DataFrame:
    """The measures made fit to show: whole counts and scores (4 places) not below 0, the share (4 places) in [0, 1]; 0
    where a column is missing, null or no number."""
    of = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    fit = {c: F.greatest(F.lit(0), safe_int(of(c))) for c in COUNTS} | {c: half_up(F.greatest(F.lit(0.0), safe_float(of(c))), 4) for c in SCORES} | {SHARE: half_up(clamp(safe_float(of(SHARE))), 4)}
    return rows.withColumns(fit)


def apply_actions(items: DataFrame, actions: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items after actions, rejected actions with `error`).

    actions: item_id, action, target_folder, reviewed_at, seq. The first valid action on a pending item moves it on;
    later ones, and unknown items, actions or folders, are errors.
    """
    a = actions.select("item_id", label_key(F.col("action")).alias("action"), F.coalesce(F.trim("target_folder"), F.lit("")).alias("target"), "reviewed_at", "seq")
    there = folders.select(F.lower("folder").alias("_known")).distinct()
    j = a.join(items.select(F.col("id").alias("item_id"), F.col("status").alias("was"), "suggested_folder", "on_disk"), "item_id", "left").join(there, F.lower(folder_name(F.col("target"))) == F.col("_known"), "left")
    error = (
        F.when(F.col("was").isNull(), "unknown item")
        .when(F.col("was") != "pending", "not pending")
        .when((F.col("action") != "skip") & ~F.coalesce("on_disk", F.lit(False)), "file is missing")
        .when(~F.col("action").isin("approve_suggested", "move_absent", "reassign_existing", "reassign_new", "skip"), "unknown action")
        .when(F.col("action").isin("reassign_existing", "reassign_new") & (F.col("target") == ""), "folder is required")
        .when((F.col("action") == "reassign_existing") & F.col("_known").isNull(), "no such folder")
    )
    j = j.withColumn("error", error)
    first = j.where("error is null").groupBy("item_id").agg(F.min(F.struct("seq", "action", "target", "reviewed_at", "suggested_folder")).alias("did"))
    late = j.where("error is null").join(first.select("item_id", F.col("did.seq").alias("_seq")), "item_id").where("seq <> _seq").withColumn("error", F.lit("not pending"))
    rejected = j.where("error is not null").select("item_id", "seq", "action", "error").unionByName(late.select("item_id", "seq", "action", "error"))
    did = F.col("did.action")
    status = F.when(did == "approve_suggested", "approved").when(did == "move_absent", "moved_absent").when(did.isin("reassign_existing", "reassign_new"), "reassigned").when(did == "skip", "skipped")
    label = F.when(did == "approve_suggested", F.coalesce(F.when(F.trim("did.suggested_folder") != "", folder_name(F.col("did.suggested_folder"))), F.lit("Entity_Unknown"))).when(did == "move_absent", "Absent").when(did.isin("reassign_existing", "reassign_new"), folder_name(F.col("did.target")))
    out = items.join(first.withColumnRenamed("item_id", "id"), "id", "left")
    return out.select(*(c for c in items.columns if c not in ("status",)), F.coalesce(status, F.col("status")).alias("status"), label.alias("final_label"), F.col("did.reviewed_at").alias("reviewed_at")), rejected


def tally(rows: DataFrame) -> DataFrame:
    """One row of counts: errors first, stopped rows in no label's count."""
    k, bad, stopped = label_key(F.col("decision_label")), F.col("error").isNotNull(), F.coalesce("stopped", F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    ok = ~bad & ~stopped
    return rows.agg(F.count(F.lit(1)).alias("scanned"), n(ok).alias("processed"), n(ok & (k == FOUND)).alias("found"), n(ok & (k == UNCERTAIN)).alias("uncertain"), n(ok & (k == ABSENT)).alias("absent"), n(bad).alias("errors"))


def report_rows(rows: DataFrame) -> DataFrame:
    """The per-item report."""
    return rows.select("path", base_name(F.col("path")).alias("name"), "decision_label", half_up(F.col("confidence"), 3).alias("confidence"), F.coalesce("reason_summary", F.lit("")).alias("reason_summary"), F.coalesce("error", F.lit("")).alias("error"), F.coalesce("applied", F.lit(False)).alias("memory_applied"), F.coalesce("destination", F.lit("")).alias("destination"))


def write_reports(summary: DataFrame, rows: DataFrame, folder: str) -> None:
    """Summary and rows as JSON and CSV, through Spark's commit protocol."""
    for name, df in (("summary", summary), ("items", rows)):
        df.write.mode("overwrite").json(f"{folder}/{name}_json")
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_csv")


def confidence_histogram(rows: DataFrame, column: str = "confidence", bins: int = 10) -> DataFrame:
    """bin and n: shares by tenths, 1 in the last bin; those that are null count as 0."""
    v = clamp(F.coalesce(safe_float(F.col(column)), F.lit(0.0)))
    return rows.groupBy(F.least(F.lit(bins - 1), F.floor(v * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: The keys of a result, in order, and the kind of each: text, flag, count, score (4 places) or as it is.
PAYLOAD = {
    "video": "text", "video_name": "text", "decision_label": "text", "confidence_score": "share", "reason_summary": "text", "reason_tags": "tags", "reason_metrics": "metrics", "decision_reason": "text", "memory_match_label": "text",
    "memory_match_score": "score", "memory_match_arcface_score": "score", "memory_match_reid_score": "maybe", "memory_match_rerank_mode": "text", "memory_applied": "flag", "learning_applied": "flag", "adaptive_threshold_used": "score",
    "feedback_consistency_snapshot": "map", "suggested_folder_name": "text", "suggested_cluster_id": "asis", "samples_used": "count", "embedding": "vector", "embedding_source": "text", "reid_enabled": "flag", "reid_embedding_present": "flag",
    "reid_backend": "text", "reid_model_tier": "text", "reid_embedding": "vector", "stopped": "flag", "error": "text",
}


def result_payload(rows: DataFrame, reid_tier: str = "", reid_backend: str = "") -> DataFrame:
    """path and value: the JSON object of each row of a run, with the keys of PAYLOAD; columns that are missing or null give empty
    text, 0, false or null."""
    has = set(rows.columns)
    of = lambda c, t="string": F.col(c) if c in has else F.lit(None).cast(t)
    inside = lambda c, t: F.col(f"match.{c}") if "match" in has else F.lit(None).cast(t)
    measured = metrics(rows)
    source = {
        "video": of("path"), "video_name": base_name(of("path")), "decision_label": of("decision_label"), "confidence_score": of("confidence"), "reason_summary": of("reason_summary"), "reason_tags": of("tags", "array<string>"), "decision_reason": of("decision_reason"),
        "reason_metrics": F.struct(*(F.col(c) for c in (*COUNTS, *SCORES, SHARE))), "memory_match_label": of("match_label"), "memory_match_score": inside("score", "double"), "memory_match_arcface_score": inside("primary", "double"), "memory_match_reid_score": inside("aux", "double"), "memory_match_rerank_mode": inside("mode", "string"),
        "memory_applied": of("applied", "boolean"), "learning_applied": of("learning_applied", "boolean") if "learning_applied" in has else of("applied", "boolean"), "adaptive_threshold_used": of("threshold_used", "double"), "feedback_consistency_snapshot": of("feedback_snapshot", "map<string,double>"), "suggested_folder_name": of("folder"),
        "suggested_cluster_id": of("cluster_id", "bigint"), "samples_used": of("stable", "int"), "embedding": of("embedding", "array<double>"), "embedding_source": of("embedding_source"), "reid_enabled": F.lit(bool(reid_backend)), "reid_embedding_present": F.size(F.coalesce(of("aux_embedding", "array<double>"), F.array().cast("array<double>"))) > 0,
        "reid_backend": F.lit(reid_backend), "reid_model_tier": F.lit(reid_tier), "reid_embedding": of("aux_embedding", "array<double>"), "stopped": of("stopped", "boolean"), "error": of("error"),
    }
    fit = {
        "text": lambda c: F.coalesce(c.cast("string"), F.lit("")), "flag": lambda c: F.coalesce(c.cast("boolean"), F.lit(False)), "count": lambda c: F.greatest(F.lit(0), safe_int(c)), "score": lambda c: half_up(safe_float(c), 4), "share": lambda c: half_up(clamp(safe_float(c)), 3),
        "maybe": lambda c: half_up(c, 4), "tags": lambda c: F.coalesce(c, F.array().cast("array<string>")), "vector": lambda c: c.cast("array<double>"), "map": lambda c: F.coalesce(c, F.create_map().cast("map<string,double>")), "asis": lambda c: c, "metrics": lambda c: c,
    }
    body = F.struct(*(fit[kind](source[key]).alias(key) for key, kind in PAYLOAD.items()))
    return measured.select("path", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
