"""Merging and splitting identities over their four tables, and versions of tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import identity
from tessera.sources import versions

AT = "2024-05-01 10:00:00"
IDS = "label string, prototype array<double>, sample_count int, confidence_sum double, pos_count int, neg_count int, locked boolean, locked_at string, last_used string, last_corrected_at timestamp, aux_prototype array<double>, aux_sample_count int"
LOG = "event_id string, ts timestamp, event_type string, label string, match_label string, from_label string, to_label string, predicted_label string, negative_label string, confidence double, source_path string, final_path string"


def tables(spark):
    files = ["A/clip.mp4", "A/clip2.MP4", "A/notes.txt", "A/sub/deep.mp4", "B/clip.mp4", "B/clip_1.mp4", "C/x.mp4"]
    ids = [("A", [1.0, 0.0, 0.0], 2, 1.5, 3, 0, True, None, "2024-01-01", None, None, 0), ("B", [0.0, 1.0, 0.0], 1, 0.7, 0, 1, False, None, "2023-01-01", None, None, 0), ("C", [0.0, 0.0, 1.0], 1, 0.1, 0, 0, False, None, None, None, None, 0)]
    log = [("e1", "positive", "a", "A", "B", "A", "A/clip.mp4"), ("e2", "positive", "C", "x", None, "C", "C/x.mp4"), ("e3", "negative", "B", " A ", None, None, "A/old/gone.mp4")]
    rows = [(e, None, k, lab, m, f, t, None, None, 0.5, None, p) for e, k, lab, m, f, t, p in log]
    cache = [("a/CLIP.mp4", [0.0, 2.0, 0.0], 0.9, None, None), ("A/clip2.MP4", [0.0, 0.0, 0.0], 0.8, None, None), ("C/x.mp4", [1.0, 1.0, 0.0], 0.4, None, None)]
    cache[0] = ("A/clip.mp4", *cache[0][1:])
    return {
        "files": spark.createDataFrame([(f, k) for k, f in enumerate(files)], "path string, size bigint"),
        "log": spark.createDataFrame(rows, LOG).withColumn("ts", F.lit("2024-01-01").cast("timestamp")),
        "cache": spark.createDataFrame(cache, "path string, embedding array<double>, confidence double, updated_at timestamp, aux_embedding array<double>"),
        "identities": spark.createDataFrame(ids, IDS),
    }


def test_merge(spark):
    new, moves = identity.merge(tables(spark), "A", "B", AT)
    assert {r["old"]: r["new"] for r in moves.collect()} == {"A/clip.mp4": "B/clip_2.mp4", "A/clip2.MP4": "B/clip2.MP4"}
    assert {r["path"] for r in new["files"].collect()} == {"B/clip_2.mp4", "B/clip2.MP4", "A/notes.txt", "A/sub/deep.mp4", "B/clip.mp4", "B/clip_1.mp4", "C/x.mp4"}
    log = {r["event_id"]: r for r in new["log"].collect()}
    assert (log["e1"]["label"], log["e1"]["match_label"], log["e1"]["to_label"], log["e1"]["final_path"]) == ("B", "B", "B", "B/clip_2.mp4")
    assert log["e3"]["match_label"] == "B" and log["e3"]["final_path"] == "B/old/gone.mp4" and log["e2"]["label"] == "C" and log["e2"]["final_path"] == "C/x.mp4"
    kinds = sorted(r["event_type"] for e, r in log.items() if e.startswith("identity_merge"))
    assert kinds == ["negative", "positive", "structural"]  # one moved file has a usable vector
    cache = {r["path"]: r for r in new["cache"].collect()}
    assert set(cache) == {"B/clip_2.mp4", "B/clip2.MP4", "C/x.mp4"} and cache["B/clip_2.mp4"]["updated_at"] is not None and cache["C/x.mp4"]["updated_at"] is None
    ids = {r["label"]: r for r in new["identities"].collect()}
    assert set(ids) == {"A", "B", "C"}  # the source is there again, for its negative count
    b = ids["B"]
    p = np.array([2.0, 1.0, 0.0]) / np.sqrt(5)
    p = (p * 3 + [0, 1, 0]) / 4
    assert b["sample_count"] == 4 and np.allclose(b["prototype"], p / np.linalg.norm(p)) and b["confidence_sum"] == pytest.approx(1.5 + 0.7 + 0.9)
    assert (b["pos_count"], b["neg_count"], b["locked"], b["locked_at"]) == (4, 1, True, AT) and (ids["A"]["neg_count"], ids["A"]["sample_count"]) == (1, 0)
    assert ids["C"]["last_corrected_at"] is None and b["last_corrected_at"] is not None


def test_split(spark):
    t = tables(spark)
    pick = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    new, moves = identity.split(t, "A", "New: one", pick("A/clip.mp4", "A/notes.txt", "A/none.mp4"), AT)
    assert [(r["old"], r["new"]) for r in moves.collect()] == [("A/clip.mp4", "New_ one/clip.mp4")]
    log = {r["event_id"]: r for r in new["log"].collect()}
    assert (log["e1"]["label"], log["e1"]["match_label"], log["e1"]["final_path"]) == ("New_ one", "A", "New_ one/clip.mp4") and log["e3"]["final_path"] == "A/old/gone.mp4"
    ids = {r["label"]: r for r in new["identities"].collect()}
    assert ids["New_ one"]["sample_count"] == 1 and ids["New_ one"]["prototype"] == [0.0, 1.0, 0.0] and ids["A"]["sample_count"] == 2 and ids["A"]["neg_count"] == 1
    with pytest.raises(ValueError):
        identity.split(t, "A", "D", pick("B/clip.mp4"), AT)
    with pytest.raises(ValueError):
        identity.split(t, "A", "D", pick("A/notes.txt"), AT)
    with pytest.raises(ValueError):
        identity.merge(t, "A", " a ", AT)


def test_versions_change_together(spark, tmp_path):
    """A run that dies between two tables leaves the old version; two runs from one version don't both succeed."""
    root = str(tmp_path / "state")
    assert versions.load(spark, root) == {}
    assert versions.commit(spark, tables(spark), root, 0) == 1
    old = versions.load(spark, root)
    new, _ = identity.merge(old, "A", "B", AT)
    broken = dict(new, identities=new["identities"].withColumn("label", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        versions.commit(spark, broken, root, 1)
    assert {r["path"] for r in versions.load(spark, root)["files"].collect()} == {r["path"] for r in tables(spark)["files"].collect()}
    assert versions.commit(spark, new, root, 1) == 2
    with pytest.raises(RuntimeError):
        versions.commit(spark, new, root, 1)
    now = versions.load(spark, root)
    assert versions.manifest(spark, root)["version"] == 2 and "B/clip_2.mp4" in {r["path"] for r in now["files"].collect()} and now["identities"].count() == 3


def test_changes_from_the_command_line(spark, tmp_path):
    from tessera import __main__ as cli

    root = str(tmp_path / "state")
    versions.commit(spark, tables(spark), root, 0)
    run = lambda *a: cli.result(cli.parser().parse_args(["identity", *a, "--state", root, "--at", AT]), spark).first()
    assert tuple(run("merge", "--source", "A", "--target", "B")) == ("merge", 2, 2, 2)
    assert tuple(run("split", "--source", "B", "--target", "D", "--paths", "B/clip.mp4")) == ("split", 3, 1, 2)
    assert tuple(run("lock", "--source", "d")) == ("lock", 4, 0, 0)
    now = versions.load(spark, root)
    assert {r["path"] for r in now["files"].where("path like 'D/%'").collect()} == {"D/clip.mp4"} and now["identities"].where("label = 'D'").first()["locked"]
