"""Queries over events and orders as detections, decisions, feedback and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.functions.scalar import half_up
from tessera.operators import identity, memory, review, sampling, votes
from tessera.operators.ordered import numbered
from tessera.plans.registry import query, table

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_EV = f"ev AS (SELECT *, {_K} AS k FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    t = F.col("event_type")
    return e.select("event_id", F.concat(F.lit("in/"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("path"), F.when(t == "click", "target_found").when(t == "view", "uncertain").when(t == "purchase", "Target_Found ").otherwise("target_absent").alias("decision_label"), half_up(F.col("value") / 500.0, 3).alias("confidence"), F.when(t == "error", "failed").alias("error"), (F.col("event_id") % 11 == 0).alias("stopped"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("n"), F.col("k").cast("string"))).alias("folder"), F.when(F.col("event_id") % 6 == 0, F.col("k")).alias("cluster_id"), "value", "k", "user_id")


_DEC = f"""{_EV}, dec AS (SELECT event_id, user_id, k, value, CASE event_type WHEN 'click' THEN 'target_found' WHEN 'view' THEN 'uncertain' WHEN 'purchase' THEN 'target_found' ELSE 'target_absent' END AS label,
  floor(value / 500.0 * 1000 + 0.5) / 1000 AS conf, event_type = 'error' AS bad, event_id % 11 = 0 AS stopped,
  CASE WHEN event_id % 4 = 0 THEN 'n' || k END AS folder, CASE WHEN event_id % 6 = 0 THEN k END AS cluster_id FROM ev)"""


@query(f"WITH {_DEC} SELECT count(*) AS scanned, count(*) FILTER (NOT bad AND NOT stopped) AS processed, count(*) FILTER (NOT bad AND NOT stopped AND label = 'target_found') AS found, count(*) FILTER (NOT bad AND NOT stopped AND label = 'uncertain') AS uncertain, count(*) FILTER (NOT bad AND NOT stopped AND label = 'target_absent') AS absent, count(*) FILTER (bad) AS errors FROM dec")
def decision_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.tally(_decided(spark, sf_dir))


@query("SELECT user_id, floor(greatest(0, epoch(max(ts)) - epoch(min(ts))) * 1000 + 0.5) / 1000 AS elapsed_s, count(*) AS n, floor(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) / 100.0 * 1000 + 0.5) / 1000 AS total FROM events GROUP BY user_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cents = F.sum(F.floor(F.col("value") * 100 + 0.5).cast("bigint"))
    return e.groupBy("user_id").agg(scalar.elapsed_seconds(F.min("ts"), F.max("ts")).alias("elapsed_s"), F.count(F.lit(1)).alias("n"), half_up(cents / 100.0, 3).alias("total"))


@query(f"WITH {_DEC}, n AS (SELECT *, coalesce(folder, 'Entity_' || cluster_id) AS named, bad OR stopped AS ended FROM dec) SELECT event_id, CASE WHEN ended THEN NULL WHEN label = 'uncertain' THEN 'queue' WHEN label = 'target_found' AND conf < 0.75 THEN 'queue' WHEN label = 'target_absent' THEN 'direct_absent' ELSE 'direct' END AS route, CASE WHEN ended THEN NULL WHEN label = 'uncertain' THEN 'Uncertain' WHEN label = 'target_found' AND conf < 0.75 THEN 'Review_Pending/' || coalesce(named, 'Entity_Unknown') WHEN label = 'target_absent' THEN 'Absent' ELSE coalesce(named, 'Absent') END AS destination FROM n")
def route_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.destination(_decided(spark, sf_dir)).select("event_id", "route", "destination")


_TAGS = f"""WITH {_EV}, m AS (SELECT event_id, k AS faces, event_id % 7 AS low_area, event_id % 5 AS stable, event_id % 6 AS votes, CAST(event_id % 9 AS DOUBLE) AS pos, CAST(event_id % 8 AS DOUBLE) AS neg, event_id % 3 AS seeds, event_id % 13 = 0 AS applied,
  CASE WHEN event_id % 10 = 0 THEN 'x' ELSE '' END AS matched, CASE event_type WHEN 'click' THEN 'target_found' WHEN 'view' THEN 'uncertain' ELSE 'target_absent' END AS label, CASE WHEN event_id % 4 = 1 THEN 'Candidates appeared but none verified' ELSE '' END AS reason FROM ev),
t AS (SELECT event_id, label, reason, list_filter([CASE WHEN applied THEN 'memory_match_applied' END, CASE WHEN pos > 0 AND neg > 0 AND pos <= neg THEN 'vote_disagreement' END, CASE WHEN stable > 0 AND stable < 3 THEN 'few_stable_embeddings' END, CASE WHEN votes > 0 AND votes < 3 THEN 'few_votes' END,
  CASE WHEN faces > 0 AND low_area > 0 AND low_area / greatest(1, faces) >= 0.5 THEN 'low_area' END, CASE WHEN seeds > 0 AND label IN ('uncertain', 'target_absent') AND reason <> '' THEN 'unverified_candidates' END, CASE WHEN NOT applied AND matched <> '' AND label = 'uncertain' THEN 'memory_match_suggested' END], lambda x: x IS NOT NULL) AS tags FROM m)
SELECT event_id, array_to_string(tags, ',') AS tags, CASE WHEN len(tags) = 0 THEN CASE WHEN reason <> '' THEN reason WHEN label = 'target_found' THEN 'Consistent detection of the target.' WHEN label = 'uncertain' THEN 'Evidence is weak or conflicting.' ELSE 'No evidence of the target.' END ELSE '' END AS fallback FROM t"""


@query(_TAGS)
def reason_tags_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = _events(spark, sf_dir).select("event_id", F.col("k").alias("faces"), (i % 7).alias("low_area"), (i % 5).alias("stable"), (i % 6).alias("votes"), (i % 9).cast("double").alias("pos_score"), (i % 8).cast("double").alias("neg_score"), (i % 3).alias("seeds"), (i % 13 == 0).alias("applied"), F.when(i % 10 == 0, "x").otherwise("").alias("match_label"), F.when(F.col("event_type") == "click", "target_found").when(F.col("event_type") == "view", "uncertain").otherwise("target_absent").alias("decision_label"), F.when(i % 4 == 1, "Candidates appeared but none verified").otherwise("").alias("decision_reason"))
    t = review.reason_tags(e)
    return t.select("event_id", F.array_join("tags", ",").alias("tags"), F.when(F.size("tags") == 0, F.col("reason_summary")).otherwise("").alias("fallback"))


_CASC = """WITH m AS (SELECT event_id, event_id % 4 AS seeds, event_id % 5 <> 0 AS verified, value / 500 AS best, event_id % 7 <> 0 AS subj, (event_id % 10) / 10.0::DOUBLE AS app, event_id % 9 AS fr, (event_id % 20) / 20.0::DOUBLE AS cons, value / 491 AS sc, event_id % 6 AS stable, event_id % 8 AS votes, CAST(event_id % 11 AS DOUBLE) AS p, CAST(event_id % 3 AS DOUBLE) AS n FROM events),
r AS (SELECT *, CASE WHEN p + n > 0 THEN p / (p + n) ELSE 0 END AS ratio FROM m),
d AS (SELECT *, CASE WHEN seeds <= 0 THEN 1 WHEN NOT verified THEN 2 WHEN NOT (subj AND app >= 0.35 AND fr >= 3 AND cons >= 0.5) THEN 3 WHEN stable < 3 THEN 4 WHEN votes < 3 THEN 5 WHEN p + n > 0 AND (ratio < 0.62 OR p <= n) THEN 6 ELSE 7 END AS rule FROM r)
SELECT event_id, CASE rule WHEN 1 THEN 'target_absent' WHEN 7 THEN 'target_found' ELSE 'uncertain' END AS decision_label,
CASE rule WHEN 1 THEN 'No candidate gave evidence.' WHEN 2 THEN format('Candidates found ({}), none verified.', seeds) WHEN 3 THEN printf('Candidate is weak as a subject (appearance=%.2f, consistency=%.2f, frames=%d).', app, cons, fr) WHEN 4 THEN format('Weak track: only {} stable embeddings.', stable) WHEN 5 THEN format('Weak track: only {} votes.', votes) WHEN 6 THEN printf('Conflicting votes (for=%.3f, against=%.3f).', p, n) ELSE 'Consistent detection and a stable track.' END AS decision_reason,
floor(least(1.0, greatest(0.0, CASE rule WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.35::DOUBLE + least(0.25::DOUBLE, 0.3::DOUBLE * best) WHEN 3 THEN 0.35::DOUBLE + 0.35::DOUBLE * sc WHEN 4 THEN 0.45::DOUBLE WHEN 5 THEN 0.45::DOUBLE WHEN 6 THEN 0.5::DOUBLE ELSE 0.35::DOUBLE + 0.20::DOUBLE * least(1.0::DOUBLE, stable / 3.0::DOUBLE) + 0.25::DOUBLE * ratio + 0.20::DOUBLE * sc END)) * 1000 + 0.5) / 1000 AS confidence FROM d"""


@query(_CASC)
def decision_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    m = table(spark, sf_dir, "events").select("event_id", (i % 4).alias("seeds"), (i % 5 != 0).alias("verified"), (v / 500).alias("best_seed"), (i % 7 != 0).alias("subject_found"), ((i % 10) / 10.0).alias("appearance"), (i % 9).alias("subject_frames"), ((i % 20) / 20.0).alias("consistency"), (v / 491).alias("subject_confidence"), (i % 6).alias("stable"), (i % 8).alias("votes"), (i % 11).cast("double").alias("pos_score"), (i % 3).cast("double").alias("neg_score"))
    return review.decide(m, rates=(0.35, 3, 0.50)).select("event_id", "decision_label", "decision_reason", "confidence")


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", (F.col("k") * 2).alias("width"), (F.col("k") * 3).alias("height"), F.col("value").alias("sharpness"), F.when(i % 5 == 0, None).otherwise(i % 120 - 60).cast("double").alias("yaw"), (i % 100 - 50).cast("double").alias("pitch"), F.when(i % 3 == 0, None).otherwise((i % 50) / 50.0).alias("landmark"), F.floor(i / 8).alias("frame_id"), i.alias("det_id"), F.col("value").alias("area"), (0.8 + (i % 21) / 100.0).alias("prob"))


_DET = f"{_EV}, det AS (SELECT event_id, k * 2 AS w, k * 3 AS h, value AS s, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 120 - 60 END AS yaw, event_id % 100 - 50 AS pitch, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 50) / 50.0::DOUBLE END AS lm, event_id // 8 AS frame_id, value AS area, 0.8::DOUBLE + (event_id % 21) / 100.0::DOUBLE AS prob FROM ev)"


@query(f"WITH {_DET} SELECT CASE WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN w < 80 OR h < 80 THEN 'small' WHEN s < 60 THEN 'blurred' WHEN abs(yaw) > 45 OR abs(pitch) > 45 THEN 'pose' WHEN lm < 0.45 THEN 'landmark' ELSE 'passed' END AS reason, count(*) AS n FROM det GROUP BY 1")
def quality_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.gate_counts(_detections(spark, sf_dir))


@query(f"WITH {_DET}, r AS (SELECT frame_id, event_id AS det_id, row_number() OVER (PARTITION BY frame_id ORDER BY area * prob DESC, event_id) AS rank FROM det WHERE prob >= 0.9) SELECT frame_id, det_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4")
def top_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.top_detections(_detections(spark, sf_dir)).select("frame_id", "det_id", "rank")


_VOTE = f"""WITH {_EV}, r AS (SELECT user_id, event_id % 50 AS pos, event_id % 4 <> 0 AS hit, CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'target' END AS label, (event_id % 10) / 10.0::DOUBLE AS conf, CAST(k AS DOUBLE) AS area, value / 5000 AS ratio FROM ev),
g AS (SELECT user_id, count(*) AS attempted, count(*) FILTER (hit) AS frames, coalesce(sum(greatest(1.0, area) * conf) FILTER (hit AND label = 'target' AND conf > 0), 0) AS t, coalesce(sum(greatest(1.0, area) * conf) FILTER (hit AND label = 'other' AND conf > 0), 0) AS o, max(pos) FILTER (hit) AS b, min(pos) FILTER (hit) AS a, coalesce(avg(ratio) FILTER (hit), 0) AS ar FROM r GROUP BY user_id),
x AS (SELECT *, CASE WHEN t + o > 0 THEN greatest(t, o) / (t + o) ELSE 0 END AS vote, 0.6 * (frames / attempted) + 0.3 * least(1.0, greatest(0.0, (ar - 0.02) / 0.1)) + 0.1 * coalesce(least(1.0, greatest(0.0, (b - a + 1) / attempted)), 0) AS cons FROM g)
SELECT user_id, attempted, frames, CASE WHEN t + o <= 0 THEN 'unknown' WHEN t >= o THEN 'target' ELSE 'other' END AS winner, round(vote, 4) AS vote, round(cons, 4) AS consistency, round((0.55 * vote + 0.45 * cons) * CASE WHEN frames < 3 THEN 0.7 ELSE 1 END, 4) AS confidence FROM x"""


@query(_VOTE)
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    r = _events(spark, sf_dir).select(F.col("user_id").alias("entity_id"), (i % 50).alias("pos"), (i % 4 != 0).alias("matched"), F.when(i % 3 == 0, "other").otherwise("target").alias("label"), ((i % 10) / 10.0).alias("label_conf"), F.col("k").cast("double").alias("area"), (F.col("value") / 5000).alias("area_ratio"))
    v = votes.subject_vote(r)
    return v.select(F.col("entity_id").alias("user_id"), "attempted", "frames", "winner", *(F.round(c, 4).alias(c) for c in ("vote", "consistency", "confidence")))


@query("WITH r AS (SELECT user_id, count(*) FILTER (c > 0) AS votes, count(*) FILTER (c >= 0.65 AND t) AS pv, sum(c) FILTER (c > 0 AND t) AS p, coalesce(sum(c) FILTER (c > 0 AND NOT t), 0) AS n FROM (SELECT user_id, (event_id % 10) / 10.0::DOUBLE AS c, event_id % 3 <> 0 AS t FROM events) GROUP BY user_id) SELECT user_id, votes, votes >= 2 AND pv >= 2 AND coalesce(p, 0) + n > 0 AND coalesce(p, 0) / (coalesce(p, 0) + n) >= 0.62 AND coalesce(p, 0) > n AS verified FROM r WHERE votes > 0")
def confirmation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.when(i % 3 == 0, "other").otherwise("target").alias("label"), ((i % 10) / 10.0).alias("label_conf"))
    return votes.verified(r).select(F.col("entity_id").alias("user_id"), "votes", "verified")


@query("WITH r AS (SELECT user_id, event_id, coalesce(sum(CASE WHEN event_type = 'purchase' AND value > 250 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h, event_type = 'purchase' AND value > 250 AS hit FROM events) SELECT user_id, count(*) AS evaluated, coalesce(max(event_id) FILTER (hit), -1) AS first_hit FROM r WHERE h = 0 GROUP BY user_id")
def first_hit_with_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), "ts", F.col("event_id").alias("rank"), ((F.col("event_type") == "purchase") & (F.col("value") > 250)).alias("hit"))
    hits, seen = sampling.first_hits(e)
    return seen.join(hits.select("entity_id", F.col("rank").alias("first_hit")), "entity_id", "left").select(F.col("entity_id").alias("user_id"), "evaluated", F.coalesce("first_hit", F.lit(-1)).alias("first_hit"))


_SCENE = f"""WITH {_EV}, f AS (SELECT user_id, event_id, ts, [CAST(k + 1 AS DOUBLE), value, CAST(event_id % 17 + 1 AS DOUBLE)] AS hist, event_id % 9 = 0 AS static FROM ev WHERE event_id % 10 <> 3),
l AS (SELECT *, lag(hist) OVER w AS ph, lag(static) OVER w AS ps FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
d AS (SELECT *, 100 * sqrt(greatest(0, 1 - (sqrt(hist[1] * ph[1]) + sqrt(hist[2] * ph[2]) + sqrt(hist[3] * ph[3])) / sqrt((hist[1] + hist[2] + hist[3]) * (ph[1] + ph[2] + ph[3])))) AS diff FROM l)
SELECT event_id, CASE WHEN ph IS NULL THEN -1 ELSE round(diff, 4) END AS diff, coalesce(ph IS NOT NULL AND diff >= 15 AND NOT static AND NOT ps, false) AS change FROM d"""


@query(_SCENE)
def scene_change_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    f = _events(spark, sf_dir).select(F.col("user_id").alias("entity_id"), "event_id", "ts", F.when(i % 10 != 3, F.array((F.col("k") + 1).cast("double"), F.col("value"), (i % 17 + 1).cast("double"))).alias("hist"), (i % 9 == 0).alias("static"))
    return sampling.scene_changes(f).select("event_id", F.coalesce(F.round("diff", 4), F.lit(-1.0)).alias("diff"), "change")


_SCHED = """WITH spans AS (SELECT DISTINCT user_id, 20.0::DOUBLE + user_id % 7 AS duration FROM events),
ch AS (SELECT user_id, CAST(event_id % 20 AS DOUBLE) AS ts FROM events WHERE event_id % 37 = 0), st AS (SELECT user_id, CAST(event_id % 20 AS DOUBLE) AS ts FROM events WHERE event_id % 41 = 0),
base AS (SELECT user_id, CAST(unnest(range(0, CAST(ceil((duration + 1.0) / 2.0) AS BIGINT))) AS DOUBLE) * 2.0 AS ts FROM spans),
ar AS (SELECT c.user_id, greatest(0.0, c.ts - 1.0) AS a, least(s.duration, c.ts + 1.0) AS b FROM ch c JOIN spans s USING (user_id)),
dense AS (SELECT user_id, a + CAST(unnest(range(0, CAST(ceil((greatest(0.0, b - a) + 0.25) / 0.5) AS BIGINT))) AS DOUBLE) * 0.5 AS ts FROM ar),
al AS (SELECT user_id, min(ts) AS ts FROM (SELECT * FROM base UNION ALL SELECT * FROM dense) GROUP BY user_id, floor(ts * 1000 + 0.5)),
kept AS (SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.user_id = al.user_id AND abs(st.ts - al.ts) <= 0.5))
SELECT user_id, ts FROM kept UNION ALL SELECT user_id, min(ts) FROM al WHERE user_id NOT IN (SELECT user_id FROM kept) GROUP BY user_id"""


@query(_SCHED)
def scene_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    spans = e.select(F.col("user_id").alias("entity_id"), (20.0 + F.col("user_id") % 7).alias("duration")).distinct()
    at = lambda k: e.where(i % k == 0).select(F.col("user_id").alias("entity_id"), (i % 20).cast("double").alias("ts"))
    return sampling.scene_schedule(spans, at(37), at(41)).select(F.col("entity_id").alias("user_id"), "ts")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    name = lambda k: F.concat(F.lit(" User"), (k % 40).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "ts", F.when(t.isin("click", "view"), "positive").when(t == "purchase", "repair").when(t == "signup", "structural").otherwise("negative").alias("event_type"), F.when(i % 15 == 0, "target_absent").otherwise(name(F.col("user_id"))).alias("label"), F.when(i % 4 == 0, name(F.col("user_id") + 1)).alias("negative_label"), "value")


_LOG = "lg AS (SELECT event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'positive' WHEN event_type = 'purchase' THEN 'repair' WHEN event_type = 'signup' THEN 'structural' ELSE 'negative' END AS kind, CASE WHEN event_id % 15 = 0 THEN 'target_absent' ELSE 'user' || (user_id % 40) END AS label, CASE WHEN event_id % 4 = 0 THEN 'user' || ((user_id + 1) % 40) END AS neg FROM events)"
_CNT = "both_ AS (SELECT label AS k, 1 AS p, 0 AS n, ts FROM lg WHERE kind IN ('positive', 'repair') UNION ALL SELECT neg, 0, 1, ts FROM lg WHERE neg IS NOT NULL), cnt AS (SELECT k AS label_key, CAST(sum(p) AS BIGINT) AS pos_count, CAST(sum(n) AS BIGINT) AS neg_count, max(ts) AS last_at FROM both_ GROUP BY k)"


@query(f"WITH {_LOG} SELECT count(*) FILTER (kind <> 'structural') AS feedback_events, count(*) FILTER (kind IN ('positive', 'repair')) AS positive_events, count(*) FILTER (neg IS NOT NULL) AS negative_events, count(*) FILTER (kind = 'structural') AS structural_events, count(*) FILTER (kind IN ('positive', 'repair') AND label <> 'target_absent') AS identity_updates, count(*) FILTER (label = 'target_absent') AS absent_events FROM lg")
def feedback_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.log_totals(_log(spark, sf_dir))


_ADAPT = f"WITH {_LOG}, {_CNT}, a AS (SELECT *, CASE WHEN pos_count + neg_count > 0 THEN pos_count / (pos_count + neg_count) ELSE 0 END AS c FROM cnt), b AS (SELECT *, least(0.08::DOUBLE, 0.08::DOUBLE * least(1.0::DOUBLE, pos_count / 20.0::DOUBLE) * c) AS bonus, least(0.05::DOUBLE, 0.05::DOUBLE * least(1.0::DOUBLE, neg_count / 20.0::DOUBLE) * (1 + greatest(0.0::DOUBLE, 0.6::DOUBLE - c))) AS penalty FROM a)"


@query(_ADAPT + " SELECT label_key, pos_count, neg_count, floor(c * 10000 + 0.5) / 10000 AS consistency, floor(greatest(0.74::DOUBLE, least(0.82::DOUBLE, 0.82::DOUBLE - bonus + penalty)) * 10000 + 0.5) / 10000 AS adaptive_threshold FROM b")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.learned(memory.feedback_counts(_log(spark, sf_dir))).select("label_key", "pos_count", "neg_count", "consistency", "adaptive_threshold")


@query(f"WITH {_LOG}, {_CNT} SELECT label_key, pos_count, neg_count, CASE WHEN pos_count <= 0 AND neg_count <= 0 THEN 'no_data' WHEN pos_count >= 2 * neg_count AND pos_count >= 2 THEN 'improving' WHEN neg_count > pos_count THEN 'conflicting' ELSE 'mixed' END AS trend FROM cnt ORDER BY last_at DESC, label_key DESC LIMIT 20")
def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    c = memory.learned(memory.feedback_counts(_log(spark, sf_dir))).withColumn("last_used", F.lit(None).cast("timestamp"))
    return memory.summary(c, 20).select("label_key", "pos_count", "neg_count", "trend")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, value FROM r WHERE k = 1")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.newest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recency_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows; the cap is the operator."""
    return memory.bounded(table(spark, sf_dir, "events"), "ts", "event_id", 500).select("event_id", "user_id")


@query("SELECT CAST(least(9, floor(value / 500 * 10)) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.confidence_histogram(table(spark, sf_dir, "events").withColumn("confidence", F.col("value") / 500))


_ROLL = """WITH p AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events),
l AS (SELECT *, lag(t) OVER w AS pt, lag(done) OVER w AS pd FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
f AS (SELECT *, first(t) OVER x AS ft, first(done) OVER x AS fd, first(pt) OVER x AS fpt, first(pd) OVER x AS fpd FROM l WINDOW x AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN t - coalesce(fpt, ft) > 0 THEN (done - coalesce(fpd, fd)) / (t - coalesce(fpt, ft)) * 60 ELSE 0 END, 4) AS per_minute FROM f"""


@query(_ROLL)
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "event_id", "ts")
    p = numbered(e, ["stream"], ["ts", "event_id"], "k").select("stream", "event_id", "ts", (F.col("k") + 1).alias("done"))
    return sampling.rolling_rate(p, 86400).select("event_id", F.round("per_minute", 4).alias("per_minute"))


_REV = """WITH it AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Entity_' || (o_custkey % 9) END AS folder, o_orderkey % 13 <> 0 AS there FROM orders),
ac AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'approve_suggested' WHEN 1 THEN 'move_absent' WHEN 2 THEN 'reassign_existing' WHEN 3 THEN 'reassign_new' WHEN 4 THEN 'skip' WHEN 5 THEN 'burn' ELSE 'approve_suggested' END AS action, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Entity_' || (o_orderkey % 20) END AS target FROM orders),
j AS (SELECT it.*, action, target, CASE WHEN status <> 'pending' THEN 'not pending' WHEN action <> 'skip' AND NOT there THEN 'file is missing' WHEN action = 'burn' THEN 'unknown action' WHEN action LIKE 'reassign%' AND target = '' THEN 'folder is required' WHEN action = 'reassign_existing' AND CAST(replace(target, 'Entity_', '') AS INTEGER) > 8 THEN 'no such folder' END AS error FROM it JOIN ac USING (id))
SELECT id, CASE WHEN error IS NOT NULL THEN status WHEN action = 'approve_suggested' THEN 'approved' WHEN action = 'move_absent' THEN 'moved_absent' WHEN action = 'skip' THEN 'skipped' ELSE 'reassigned' END AS status,
CASE WHEN error IS NOT NULL OR action = 'skip' THEN NULL WHEN action = 'approve_suggested' THEN coalesce(nullif(folder, ''), 'Entity_Unknown') WHEN action = 'move_absent' THEN 'Absent' ELSE target END AS final_label FROM j"""


@query(_REV)
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    items = o.select(k.alias("id"), F.when(k % 6 == 0, "approved").otherwise("pending").alias("status"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Entity_"), (F.col("o_custkey") % 9).cast("string"))).alias("suggested_folder"), (k % 13 != 0).alias("on_disk"))
    name = F.element_at(F.array(*map(F.lit, ("approve_suggested", "move_absent", "reassign_existing", "reassign_new", "skip", "burn", "approve_suggested"))), (k % 7 + 1).cast("int"))
    actions = o.select(k.alias("item_id"), name.alias("action"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Entity_"), (k % 20).cast("string"))).alias("target_folder"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(1).alias("seq"))
    folders = spark.range(9).select(F.concat(F.lit("Entity_"), F.col("id").cast("string")).alias("folder"))
    done, _ = review.apply_actions(items, actions, folders)
    return done.select("id", "status", "final_label")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE greatest(0, event_id % 12 - 3) END AS faces, 0 AS low_area, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 5 END AS stable, floor(greatest(0.0, value - 100) * 10000 + 0.5) / 10000 AS pos_score, floor(least(1.0, value / 300) * 10000 + 0.5) / 10000 AS best_seed FROM events")
def reason_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that may be negative, null or no number, scores below 0 and shares over 1."""
    i, v = F.col("event_id"), F.col("value")
    e = table(spark, sf_dir, "events").select("event_id", F.when(i % 9 != 0, i % 12 - 3).alias("faces"), F.when(i % 4 == 0, "none").otherwise((i % 5).cast("string")).alias("stable"), (v - 100).alias("pos_score"), (v / 300).alias("best_seed"))
    return review.metrics(e).select("event_id", "faces", "low_area", "stable", "pos_score", "best_seed")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 >= 40 THEN 'complete' WHEN o_orderkey % 3 = 0 THEN '--' ELSE CASE WHEN s >= 3600 THEN format('{}h {:02d}m {:02d}s', s // 3600, (s % 3600) // 60, s % 60) WHEN s >= 60 THEN format('{}m {:02d}s', s // 60, s % 60) ELSE format('{}s', s) END END AS eta FROM (SELECT o_orderkey, CAST(trunc((40 - o_orderkey % 50) / nullif((o_orderkey % 3) / 4.0::DOUBLE, 0) * 60.0) AS INTEGER) AS s FROM orders)")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.eta(k % 50, F.lit(40), (k % 3) / 4.0).alias("eta"))


@query("""WITH m AS (SELECT event_id AS i, 'a/' || event_id AS source_path, 'b/' || event_id AS final_path FROM events),
c AS (SELECT CASE event_id % 5 WHEN 0 THEN 'C/' WHEN 1 THEN 'b/' WHEN 2 THEN 'B/' ELSE 'A/' END || event_id AS path, value FROM events)
SELECT m.source_path, m.final_path, coalesce(s.value, f.value) AS value, CASE WHEN s.path IS NOT NULL THEN 'source' WHEN f.path IS NOT NULL THEN 'final' ELSE 'none' END AS found_by FROM m LEFT JOIN c s ON lower(s.path) = m.source_path LEFT JOIN c f ON lower(f.path) = m.final_path""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a move and as an entry of the cache, under its source's path, its final one or neither."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    moves = e.select(F.concat(F.lit("a/"), i).alias("source_path"), F.concat(F.lit("b/"), i).alias("final_path"))
    cache = e.select(F.concat(F.when(i % 5 == 0, "C/").when(i % 5 == 1, "b/").when(i % 5 == 2, "B/").otherwise("A/"), i).alias("path"), "value")
    return memory.cache_lookup(moves, cache).select("source_path", "final_path", "value", "found_by")


_RETRY = f"""WITH {_EV}, w AS (SELECT user_id, CAST(event_id AS DOUBLE) AS s, event_id + k - 2.0::DOUBLE AS e, event_type = 'purchase' AND value > 300 AS ok, k, value / 500 AS best, event_id % 4 AS seeds, event_id % 3 AS low FROM ev),
r AS (SELECT * FROM w WHERE e > s), f AS (SELECT user_id, min(s) AS s FROM r WHERE ok GROUP BY user_id),
x AS (SELECT r.*, f.s AS f FROM r LEFT JOIN f USING (user_id) WHERE f.s IS NULL OR r.s <= f.s)
SELECT user_id, coalesce(max(f), -1) AS found_at, coalesce(max(e) FILTER (s = f), -1) AS scan_end, count(*) AS attempted, round(sum(s), 1) AS starts, round(max(best), 4) AS best_seed, CAST(sum(seeds) AS BIGINT) AS seeds, CAST(sum(k) AS BIGINT) AS faces, CAST(sum(low) AS BIGINT) AS low_area FROM x GROUP BY user_id"""


@query(_RETRY)
def retry_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a retry window of its user; some end before they start."""
    i = F.col("event_id")
    w = _events(spark, sf_dir).select(F.col("user_id").alias("entity_id"), i.cast("double").alias("start"), (i + F.col("k") - 2.0).alias("end"), ((F.col("event_type") == "purchase") & (F.col("value") > 300)).alias("ok"), (F.col("value") / 500).alias("best_seed"), (i % 4).alias("seeds"), F.col("k").alias("faces"), (i % 3).alias("low_area"))
    m = sampling.retry_merged(w)
    total = F.aggregate("attempted", F.lit(0.0), lambda s, x: s + x)
    return m.select(F.col("entity_id").alias("user_id"), *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("found_at", "scan_end")), F.size("attempted").cast("bigint").alias("attempted"), F.round(total, 1).alias("starts"), F.round("best_seed", 4).alias("best_seed"), "seeds", "faces", "low_area")


_MERGED = f"""WITH {_EV}, f AS (SELECT doc_id, 'P' || (doc_id % 5) || '/clip' || (doc_id // 5) || CASE WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.mp4' END AS path FROM documents),
m AS (SELECT a.path AS old, 'P2/clip' || (a.doc_id // 5) || CASE WHEN b.path IS NULL THEN '' ELSE '_1' END || '.mp4' AS new FROM f a LEFT JOIN f b ON b.path = replace(a.path, 'P1/', 'P2/') WHERE a.path LIKE 'P1/%.mp4'),
l AS (SELECT event_id, 'P' || (event_id % 5) AS label, CASE WHEN event_id % 3 = 0 THEN 'p' || (k % 5) END AS match_label, CASE WHEN event_id % 7 = 0 THEN 'P1/deep/' || event_id ELSE 'P' || (event_id % 5) || '/clip' || (event_id // 5) || '.mp4' END AS final_path FROM ev)
"""


def _merged(spark: SparkSession, sf_dir: str):
    """Folder P1 merged into P2: documents as files, events as the log, every file with an entry in the cache."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("P"), n % 5, F.lit("/clip"), F.floor(n / 5), F.when(n % 11 == 0, ".txt").otherwise(".mp4"))
    files = d.select("doc_id", path.alias("path"))
    i, none = F.col("event_id"), F.lit(None).cast("string")
    folder = F.concat(F.lit("P"), i % 5)
    log = _events(spark, sf_dir).select(
        i.cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("positive").alias("event_type"), folder.alias("label"), F.when(i % 3 == 0, F.concat(F.lit("p"), F.col("k") % 5)).alias("match_label"), *(none.alias(c) for c in ("from_label", "to_label", "predicted_label", "negative_label")),
        F.lit(0.5).alias("confidence"), none.alias("source_path"), F.when(i % 7 == 0, F.concat(F.lit("P1/deep/"), i)).otherwise(F.concat(folder, F.lit("/clip"), F.floor(i / 5), F.lit(".mp4"))).alias("final_path"),
    )
    cache = files.select("path", F.array(F.lit(1.0), (n % 7).cast("double")).alias("embedding"), F.lit(0.5).alias("confidence"), F.lit(None).cast("timestamp").alias("updated_at"))
    ids = spark.range(5).select(F.concat(F.lit("P"), "id").alias("label"), F.array(F.lit(0.0), F.lit(1.0)).alias("prototype"), F.lit(1).alias("sample_count"), F.lit(0.5).alias("confidence_sum"), F.lit(0).alias("pos_count"), F.lit(0).alias("neg_count"), (F.col("id") == 1).alias("locked"), none.alias("locked_at"), none.alias("last_used"), F.lit(None).cast("timestamp").alias("last_corrected_at"))
    return identity.merge({"files": files, "log": log, "cache": cache, "identities": ids}, "P1", "P2", "2024-05-01 10:00:00", keep=None)


@query(_MERGED + "SELECT doc_id, coalesce(m.new, f.path) AS path FROM f LEFT JOIN m ON m.old = f.path")
def identity_merge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0]["files"].select("doc_id", "path")


@query(_MERGED + "SELECT event_id, CASE label WHEN 'P1' THEN 'P2' ELSE label END AS label, CASE match_label WHEN 'p1' THEN 'P2' ELSE match_label END AS match_label, CASE WHEN m.new IS NOT NULL THEN m.new WHEN final_path LIKE 'P1/%' THEN replace(final_path, 'P1/', 'P2/') ELSE final_path END AS final_path FROM l LEFT JOIN m ON m.old = l.final_path")
def identity_merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _merged(spark, sf_dir)[0]["log"].where(~F.col("event_id").startswith("identity"))
    return log.select(F.col("event_id").cast("bigint").alias("event_id"), "label", "match_label", "final_path")


@query(_MERGED + "SELECT CASE WHEN coalesce(m.new, f.path) LIKE 'P2/%' THEN 'P2' ELSE 'other' END AS folder, m.new IS NOT NULL AS touched, count(*) AS entries, count(DISTINCT coalesce(m.new, f.path)) AS paths FROM f LEFT JOIN m ON m.old = f.path GROUP BY 1, 2")
def identity_merge_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _merged(spark, sf_dir)[0]["cache"]
    return c.groupBy(F.when(F.col("path").startswith("P2/"), "P2").otherwise("other").alias("folder"), F.col("updated_at").isNotNull().alias("touched")).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("path").alias("paths"))


@query(_MERGED + ", n AS (SELECT count(*) AS n FROM m) SELECT 'P' || p AS label, CASE p WHEN 2 THEN 2 + n WHEN 1 THEN 0 ELSE 1 END::INTEGER AS sample_count, CASE p WHEN 2 THEN n ELSE 0 END::INTEGER AS pos_count, CASE p WHEN 1 THEN n ELSE 0 END::INTEGER AS neg_count, p = 2 AS locked FROM range(5) r(p), n WHERE p <> 1 OR n > 0")
def identity_merge_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0]["identities"].select("label", "sample_count", "pos_count", "neg_count", "locked")
