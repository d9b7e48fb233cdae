import pytest
from pyspark.sql import functions as F

from tessera.operators import frames, memory, review


def test_pose_and_attribute(spark):
    r = spark.range(1).select(frames.pose(F.array(F.lit(3.0), F.lit(float("nan")))).alias("p"), frames.pose(F.array(F.lit(3.0))).alias("q"), frames.attribute(F.lit(2.6)).alias("a"), frames.attribute(F.lit(0.5)).alias("b")).first()
    assert tuple(r["p"]) == (3.0, None) and tuple(r["q"]) == (None, None) and r["a"] is None and r["b"] == 0


def test_inside_raises(spark):
    df = spark.createDataFrame([("a/x",), ("b/x",)], "path string")
    assert frames.inside(df.where("path = 'a/x'"), "a").count() == 1
    with pytest.raises(Exception, match="not inside"):
        frames.inside(df, "a").collect()


def test_provisional(spark):
    rows = [("uncertain", None, [1.0, 0.0], ""), ("uncertain", None, [0.0, 0.0], ""), ("target_absent", None, [1.0, 0.0], "")]
    df = spark.createDataFrame(rows, "decision_label string, embedding array<double>, seed_embedding array<double>, embedding_source string")
    assert [r["embedding_source"] for r in frames.provisional(df).collect()] == ["provisional", "", ""]


def test_projection_and_run_id(spark):
    df = spark.createDataFrame([(k, [float(k), float(k) / 2, 0.0]) for k in range(6)], "vec_id bigint, embedding array<double>")
    x = [r["x"] for r in frames.projection(df).orderBy("vec_id").collect()]
    assert x == sorted(x) and x[-1] > x[0]
    import re

    assert re.fullmatch(r"\d{8}T\d{6}Z-[0-9a-f]{8}", spark.range(1).select(frames.run_id().alias("r")).first()["r"])


def test_representative(spark):
    df = spark.createDataFrame([(1, 0, 0.2, 0.9, None), (1, 1, 0.2, 0.9, 0.9), (1, 2, 0.1, 1.0, 1.0)], "entity_id int, seq int, area_ratio double, prob double, landmark double")
    assert frames.representative(df).first()["seq"] == 0


def test_merge_split_lock_and_paths(spark):
    ids = spark.createDataFrame([("A", [1.0, 0.0, 0.0], 2, 1.5, True), ("B", [0.0, 1.0, 0.0], 1, 0.7, False)], "label string, prototype array<double>, sample_count int, confidence_sum double, locked boolean")
    full = ids.withColumns({"pos_count": F.lit(1), "neg_count": F.lit(0), "last_used": F.lit(None).cast("timestamp"), "last_corrected_at": F.lit(None).cast("timestamp")})
    m = memory.merged(full, F.lit("B")).first()
    assert m["sample_count"] == 3 and m["locked"] and m["prototype"][:2] == pytest.approx([0.8944, 0.4472], abs=1e-4)
    rows = spark.createDataFrame([("f/1.mp4", "a"), ("f/2.mp4", "A ")], "path string, label string")
    assert {r["label"] for r in memory.relabel(rows, ["label"], "A", "B").collect()} == {"B"}
    assert [r["label"] for r in memory.split(rows, rows.where("path = 'f/2.mp4'"), "C").orderBy("path").collect()] == ["a", "C"]
    moves = spark.createDataFrame([("f/1.mp4", "g/1_1.mp4")], "old string, new string")
    assert [r["path"] for r in memory.moved_paths(rows, moves, "f", "g").orderBy("path").collect()] == ["g/1_1.mp4", "g/2.mp4"]
    assert memory.locked(full, " b", True).where("locked").count() == 2


def test_review_actions_once(spark):
    items = spark.createDataFrame([("i", "pending", "Entity_1", True)], "id string, status string, suggested_folder string, on_disk boolean")
    acts = spark.createDataFrame([("i", "skip", "", None, 2), ("i", "approve_suggested", "", None, 1), ("z", "skip", "", None, 3)], "item_id string, action string, target_folder string, reviewed_at timestamp, seq int")
    done, bad = review.apply_actions(items, acts, spark.createDataFrame([], "folder string"))
    assert done.first()["status"] == "approved" and {(r["seq"], r["error"]) for r in bad.collect()} == {(2, "not pending"), (3, "unknown item")}
    pos = memory.review_feedback(spark.createDataFrame([("e", None, "B", "A", "")], "id string, ts timestamp, final_label string, match_label string, suggested_folder string")).first()
    assert (pos["label"], pos["negative_label"]) == ("B", "A")


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.mp4", "target_found", 0.91234, None, None, False, None)], "path string, decision_label string, confidence double, reason_summary string, error string, applied boolean, destination string")
    review.write_reports(review.tally(rows.withColumn("stopped", F.lit(False))), review.report_rows(rows), str(tmp_path))
    r = spark.read.json(str(tmp_path / "items_json")).first()
    assert r["name"] == "x.mp4" and r["confidence"] == 0.912
    assert sorted(p.name for p in tmp_path.iterdir()) == ["items_csv", "items_json", "summary_csv", "summary_json"]
