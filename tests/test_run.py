import json

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.config import Config, from_settings
from tessera.operators import media, memory, run

MEASURED = "path string, error string, stopped boolean, embedding array<double>, seeds int, verified boolean, best_seed double, subject_found boolean, appearance double, subject_frames int, consistency double, subject_confidence double, stable int, votes int, pos_score double, neg_score double, faces int, low_area int"


def track(path, embedding, error=None, stopped=False, seeds=3, verified=True, pos=3.0, neg=0.0):
    return (path, error, stopped, embedding, seeds, verified, 0.5, True, 1.0, 9, 1.0, 0.9, 5, 5, pos, neg, 9, 1)


@pytest.fixture(scope="module")
def measured(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [
        track("Uncertain/7.mp4", x), track("in/1.mp4", y), track("in/b/1.mp4", y, pos=1.0, neg=2.0), track("in/2.mp4", None, seeds=0, verified=False),
        track("in/3.mp4", z, verified=False), track("in/4.mp4", x, error="broken"), track("in/5.mp4", x, stopped=True), track("Uncertain/8.mp4", None, verified=False),
    ]
    return spark.createDataFrame(rows, MEASURED)


@pytest.fixture(scope="module")
def identities(spark):
    return spark.createDataFrame([(0, "Known", [1.0, 0.0, 0.0], False, 0.8)], "position int, label string, prototype array<double>, locked boolean, match_threshold double")


def test_run(spark, measured, identities):
    out = run.sort_run(measured, identities, Config(review=True))
    got = {r["path"]: (r["decision_label"], r["folder"], r["route"], r["destination"], r["target"]) for r in out.collect()}
    named = {p: v[1] for p, v in got.items()}
    assert got["Uncertain/7.mp4"] == ("target_found", "Known", "direct", "Known", "7.mp4")
    assert got["in/1.mp4"] == ("target_found", named["in/1.mp4"], "direct", named["in/1.mp4"], "1.mp4")
    assert got["in/b/1.mp4"] == ("uncertain", named["in/1.mp4"], "queue", "Uncertain", "1.mp4") and named["in/1.mp4"].startswith("Entity_")
    assert got["in/2.mp4"] == ("target_absent", None, "direct_absent", "Absent", "2.mp4")
    assert got["in/3.mp4"][0] == "uncertain" and got["in/3.mp4"][1] != named["in/1.mp4"]
    assert got["in/4.mp4"] == ("error", None, None, None, None) and got["in/5.mp4"][0] == "stopped"
    assert got["Uncertain/8.mp4"][1:4] == ("Needs_Review", "queue", "Uncertain")
    reasons = {r["path"]: r["decision_reason"] for r in out.collect()}
    assert reasons["in/4.mp4"] == "broken" and "(for=1.000, against=2.000)" in reasons["in/b/1.mp4"] and "score=1.000, threshold=0.800" in reasons["Uncertain/7.mp4"]
    s = run.run_summary(out, -3).first().asDict()
    assert s == {"scanned": 8, "processed": 6, "found": 2, "uncertain": 3, "absent": 1, "errors": 1, "moved": 6, "left_in_source": 2, "queued": 3, "memory_applied": 1, "stopped": 1, "seconds": 0.0}
    items = {r["source_path"]: r for r in run.queue_items(out).collect()}
    assert set(items) == {"in/b/1.mp4", "in/3.mp4", "Uncertain/8.mp4"} and items["in/3.mp4"]["pending_path"] == "Uncertain/3.mp4" and items["in/3.mp4"]["from_uncertain"]
    assert run.learned_thresholds(out).count() == 0


def test_reprocess(spark, measured, identities):
    rows = run.waiting(measured)
    out = run.sort_run(rows, identities, Config())
    assert tuple(run.reprocess_summary(out).first()) == (2, 1, 1)


def test_run_of_nothing(spark, measured, identities):
    out = run.sort_run(measured.limit(0), identities)
    assert out.count() == 0 and run.run_summary(out).first()["scanned"] == 0
    assert run.sort_run(measured, identities.limit(0)).where("applied").count() == 0


def test_learned_thresholds_reach_identities(spark, identities):
    rows = spark.createDataFrame([("a", "target_found", "Known", [1.0, 0.0]), ("b", "target_found", "Known", [0.0, 1.0]), ("c", "target_found", "One", [0.0, 1.0]), ("d", "uncertain", "Known", [0.0, 1.0])], "path string, decision_label string, folder string, embedding array<double>")
    stats = run.learned_thresholds(rows)
    assert [(r["label"], r["pairs"]) for r in stats.collect()] == [("Known", 1)]
    more = stats.unionByName(stats.withColumn("label", F.lit("New")))
    got = {r["label"]: (r["same_threshold"], r["pairs"], r["locked"]) for r in memory.set_thresholds(identities, more).collect()}
    assert got == {"Known": (0.35, 1, False), "New": (0.35, 1, False)}


def test_log_is_appended_and_cut(spark):
    log = spark.createDataFrame([(k, k, "positive") for k in range(5)], "ts int, event_id int, event_type string")
    new = spark.createDataFrame([(9, 9, "structural", "x")], "ts int, event_id int, event_type string, from_label string")
    got = memory.appended(log, new, 3).collect()
    assert sorted((r["event_id"], r["from_label"]) for r in got) == [(3, None), (4, None), (9, "x")]


@pytest.mark.parametrize("event,negative,want", [("", False, "positive"), (None, True, "negative"), (" Structural ", False, "structural"), ("other", True, "positive")])
def test_event_kind(spark, event, negative, want):
    assert spark.range(1).select(memory.event_kind(F.lit(event).cast("string"), F.lit(negative)).alias("k")).first()["k"] == want


def test_move_counts(spark):
    files = spark.createDataFrame([("r/a/1.mp4", True), ("r/a/2.mp4", True), ("r/a/3.mp4", False), ("", True)], "path string, exists boolean")
    assert {tuple(r) for r in media.move_counts(media.duplicate_moves(files, "r")).collect()} == {("move", 2), ("missing", 1), ("invalid_path", 1)}


def test_settings_file(tmp_path):
    assert from_settings(tmp_path / "none.json") == Config()
    (tmp_path / "s.json").write_text(json.dumps({"profile": "High-Accuracy", "max_seconds": "33", "sample_every": "x", "review": True, "colour": 1}))
    c = from_settings(tmp_path / "s.json")
    assert (c.profile, c.max_seconds, c.sample_every, c.review, c.min_votes) == ("high_accuracy", 33, 1.0, True, 4)
    (tmp_path / "s.json").write_text("[1")
    assert from_settings(tmp_path / "s.json") == Config()


def test_run_from_the_command_line(spark, measured, identities, tmp_path):
    measured.write.parquet(str(tmp_path / "m"))
    identities.write.parquet(str(tmp_path / "i"))
    args = ["sort", "--measured", str(tmp_path / "m"), "--identities", str(tmp_path / "i"), "--reprocess", "--report", str(tmp_path / "out")]
    out = cli.result(cli.parser().parse_args(args), spark)
    assert out.count() == 2
    assert spark.read.json(str(tmp_path / "out" / "summary_json")).first()["scanned"] == 2


def test_second_vector_decides_in_doubt(spark):
    """First vectors at the threshold: the second one accepts one track and turns the other down; without cfg.reid both go by the first."""
    a, doubt = [1.0, 0.0], [0.74, 0.6726]
    rows = [(*track(f"in/{n}.mp4", doubt), aux) for n, aux in (("same", [0.0, 1.0]), ("other", [1.0, 0.0]), ("none", None))]
    m = spark.createDataFrame(rows, MEASURED + ", aux_embedding array<double>")
    ids = spark.createDataFrame([(0, "A", a, [0.0, 2.0], True, 0.74)], "position int, label string, prototype array<double>, aux_prototype array<double>, locked boolean, match_threshold double")
    got = {r["path"]: r["match"] for r in run.decisions(m, ids, Config(reid=True)).collect()}
    assert got["in/same.mp4"]["mode"] == "ambiguous_fused" and got["in/same.mp4"]["score"] == pytest.approx(0.65 * 0.74 + 0.35, abs=1e-3) and got["in/same.mp4"]["aux"] == pytest.approx(1.0)
    assert got["in/other.mp4"] is None and got["in/none.mp4"]["mode"] == "ambiguous_primary"
    assert all(r["match"]["mode"] == "ambiguous_primary" for r in run.decisions(m, ids, Config()).collect())


def test_schedule_of_a_run(spark):
    spans = spark.createDataFrame([("v", 6.0)], "entity_id string, duration double")
    frames = spark.createDataFrame([("v", float(t), [1.0, 9.0] if t < 3 else [9.0, 1.0], 50.0, 90.0) for t in range(6)], "entity_id string, ts double, hist array<double>, deviation double, edges double")
    plain = [r["ts"] for r in run.schedule(spans, frames, Config(scene_aware=False)).orderBy("ts").collect()]
    aware = [r["ts"] for r in run.schedule(spans, frames, Config()).orderBy("ts").collect()]
    assert plain == [0.0, 2.0, 4.0, 6.0] and set(plain) < set(aware) and 2.5 in aware and 3.5 in aware
    assert run.seed_gate(Config(gate_side=10)).least_side == 10


def test_result_payload(spark, measured, identities):
    from tessera.operators import review

    out = run.decisions(measured, identities, Config())
    rows = {r["path"]: json.loads(r["value"]) for r in review.result_payload(out).collect()}
    assert all(list(r) == list(review.PAYLOAD) and len(r) == 29 for r in rows.values())
    one = rows["Uncertain/7.mp4"]
    assert one["memory_applied"] and one["learning_applied"] and one["memory_match_score"] == 1.0 and one["video_name"] == "7.mp4" and one["embedding"] == [1.0, 0.0, 0.0] and one["memory_match_reid_score"] is None
    assert rows["in/4.mp4"]["error"] == "broken" and rows["in/5.mp4"]["stopped"] and rows["in/2.mp4"]["embedding"] is None and rows["in/2.mp4"]["reason_metrics"]["faces"] == 9


def test_retries_end_at_the_first_success(spark):
    from tessera.operators import sampling

    rows = [("a", 25.0, 45.0, False, 0.5, 1, 4), ("a", 50.0, 70.0, True, 0.9, 1, 9), ("a", 75.0, 95.0, True, 0.99, 5, 5), ("a", 80.0, 80.0, True, 1.0, 7, 7), ("b", 10.0, 5.0, True, 0.2, 1, 1), ("b", 20.0, 30.0, None, None, None, 2)]
    m = {r["entity_id"]: r for r in sampling.retry_merged(spark.createDataFrame(rows, "entity_id string, start double, end double, ok boolean, best_seed double, seeds int, faces int")).collect()}
    assert (m["a"]["found_at"], m["a"]["scan_end"], m["a"]["attempted"], m["a"]["seeds"], m["a"]["faces"], m["a"]["best_seed"]) == (50.0, 70.0, [25.0, 50.0], 2, 13, 0.9)
    assert (m["b"]["found_at"], m["b"]["attempted"], m["b"]["seeds"], m["b"]["best_seed"]) == (None, [20.0], 0, 0.0)


def test_paths_times_and_derived_fields(spark):
    from datetime import datetime

    from tessera.functions import scalar
    from tessera.sources import files

    for raw, want in {"a/b/../c": "a/c", "/../a": "/a", "../a/./b//": "../a/b", "a/..": ".", "": ".", "/": "/", "../../x": "../../x"}.items():
        assert spark.range(1).select(scalar.normal_path(F.lit(raw)).alias("x")).first()["x"] == want
    assert datetime.strptime(spark.range(1).select(scalar.utc_now().alias("x")).first()["x"], "%Y-%m-%dT%H:%M:%SZ")
    raw = spark.createDataFrame([(" A ", None, -3, None, None, 10, 2, 1.5), ("", None, 1, 0.0, True, 1, 1, 0.5)], "label string, prototype array<double>, sample_count int, confidence_sum double, locked boolean, pos_count int, neg_count int, same_threshold double")
    r = files.identity_records(raw).collect()
    assert len(r) == 1 and (r[0]["label"], r[0]["sample_count"], r[0]["same_threshold"], r[0]["adaptive_threshold"], r[0]["trend"]) == ("A", 0, 1.0, 0.7917, "improving")
