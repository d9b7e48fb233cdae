"""Operators whose result depends on order, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, media, memory, review, sampling, votes


def vectors(n=60, dim=8, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "root bigint, centroid array<double>")


@pytest.mark.parametrize("driver", [True, False])
def test_greedy_merge(spark, monkeypatch, driver):
    v, want, seeds = vectors(25), {}, []
    for i in range(len(v)):
        if i not in want:
            seeds.append(i)
            for j in range(i, len(v)):
                if j not in want and (i == j or v[i] @ v[j] >= 0.3):
                    want[j] = len(seeds)
    if not driver:
        monkeypatch.setattr(clusters, "DRIVER_PAIRS", -1)
    got = {r["root"]: r["cluster_id"] for r in clusters.greedy_merge(table(spark, v), 0.3).collect()}
    assert got == want


def test_prototype_fold(spark):
    v, proto = vectors(40), {}
    rows = [(f"l{i % 3}", i // 2, i, 0.5, x.tolist()) for i, x in enumerate(v)]
    for label, _, _, _, e in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        e = np.array(e)
        if label not in proto:
            proto[label] = (e, 1)
        else:
            p, n = proto[label]
            m = (p / np.linalg.norm(p) * n + e) / (n + 1)
            proto[label] = (m / np.linalg.norm(m), n + 1)
    log = spark.createDataFrame(rows[::-1], "label string, ts bigint, event_id bigint, confidence double, embedding array<double>")
    got = {r["label"]: r for r in memory.prototypes(log).collect()}
    for label, (p, n) in proto.items():
        assert got[label]["sample_count"] == n and np.allclose(got[label]["prototype"], p)


def test_robust_mean_resists_an_outlier(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=64)
    rows = [(1, i, (base + 0.01 * rng.normal(size=64)).tolist()) for i in range(9)] + [(1, 9, rng.normal(size=64).tolist())]
    c = clusters.robust_centroids(spark.createDataFrame(rows, "root bigint, vec_id bigint, embedding array<double>")).first()
    assert np.dot(c["centroid"], base / np.linalg.norm(base)) > 0.95


def test_two_groups_cluster_apart(spark):
    rng, rows = np.random.default_rng(42), []
    for g in range(2):
        base = rng.normal(size=128)
        rows += [(g * 3 + k, (base + 0.02 * rng.normal(size=128)).tolist()) for k in range(3)]
    got = {r["vec_id"]: r["cluster_id"] for r in clusters.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.3, merge=0.85).collect()}
    assert len({got[k] for k in range(3)}) == 1 and len({got[k] for k in range(3, 6)}) == 1 and got[0] != got[3]


def test_stabilized(spark):
    v = vectors(30, 4)
    rows = [(i % 2, i, v[i].tolist(), 10, 10, 20 + i, 20, 100, "target", 0.5) for i in range(30)]
    unit = lambda x: x / (np.linalg.norm(x) + 1e-8)
    want = {}
    for e_id in (0, 1):
        kept, mean, last, box = [], None, None, None
        for _, i, e, x1, y1, x2, y2, ext, _, _ in (r for r in rows if r[0] == e_id):
            e = np.array(e)
            if mean is None:
                kept, mean, last, box = [i], e, e, (x1, y1, x2, y2)
                continue
            if unit(mean) @ unit(e) < 0.2 or abs(x1 + x2 - box[0] - box[2]) + abs(y1 + y2 - box[1] - box[3]) > ext * 0.8 or unit(last) @ unit(e) >= 0.985:
                continue
            kept.append(i)
            last, box = e, (x1, y1, x2, y2)
            mean = mean + (e - mean) / len(kept)
            mean = mean / np.linalg.norm(mean)
        want[e_id] = kept
    t = spark.createDataFrame(rows, "entity_id bigint, seq bigint, embedding array<double>, x1 int, y1 int, x2 int, y2 int, extent int, label string, label_conf double")
    got = {r["entity_id"]: r["kept"] for r in clusters.stabilized(t, same=0.2).collect()}
    assert got == want


def test_move_plan_skips_taken_numbers(spark):
    m = spark.createDataFrame([("a", "f", "x.mp4"), ("b", "f", "x.mp4"), ("c", "f", "x.mp4")], "path string, folder string, name string")
    taken = spark.createDataFrame([("f", "x.mp4"), ("f", "x_2.mp4")], "folder string, name string")
    assert [r["target"] for r in media.move_plan(m, taken).orderBy("path").collect()] == ["x_1.mp4", "x_3.mp4", "x_4.mp4"]


def test_cluster_folders(spark):
    rows = [(1, "a/beach_01.mp4"), (1, "a/beach_02.mp4"), (2, "b/beach_03.mp4"), (2, "b/beach_04.mp4"), (3, "c/001.mp4")]
    got = {r["cluster_id"]: r["folder"] for r in media.cluster_folders(spark.createDataFrame(rows, "cluster_id bigint, path string")).collect()}
    assert got == {1: "Entity_Beach", 2: "Entity_Beach_2", 3: "Entity_3"}


def test_cluster_folders_against_the_plain_loop(spark):
    """Repeats, names in two cases, names that a suffix makes and that were there, and clusters without a name."""
    names = ["beach", "beach", "beach", "lake_2", "lake", "lake", "2", "", "Harbour", "harbour", "park_2", "park_2", "park", "park_2_2"]
    rng = np.random.default_rng(7)
    rows = [(c, names[int(rng.integers(len(names)))]) for c in range(300)]
    named = spark.createDataFrame(rows, "cluster_id bigint, name string").withColumn("name", F.nullif("name", F.lit("")))
    used, want = set(), {}
    for c, name in rows:
        base = f"Entity_{name or c}"
        folder, k = base, 2
        while folder.lower() in used:
            folder, k = f"{base}_{k}", k + 1
        used.add(folder.lower())
        want[c] = folder
    got = {r["cluster_id"]: r["folder"] for r in media.free_folders(named).collect()}
    assert got == want


def test_cluster_folders_of_one_name_are_not_tried_one_by_one(spark, monkeypatch):
    """So many clusters of one name that a search from _2 on for each would not end in time: none goes through the search."""

    def none(batches):
        for b in batches:
            assert not len(b)
            yield b[["cluster_id"]].assign(folder="")

    monkeypatch.setattr(media, "_free_names", none)
    rows = spark.range(40_000).select(F.col("id").alias("cluster_id"), F.when(F.col("id") % 2 == 0, "Beach").alias("name"))
    got = {r["cluster_id"]: r["folder"] for r in media.free_folders(rows).collect()}
    assert got == {c: f"Entity_{c}" if c % 2 else "Entity_Beach" if c == 0 else f"Entity_Beach_{c // 2 + 1}" for c in range(40_000)}


def test_votes_of_just_the_ratio_in_any_order(spark):
    """31 to 19 is a share of 0.62, which sums of doubles miss in this order."""
    pos, neg = [6, 9, 9, 6, 9, 9, 6, 8], [9, 5, 8, 4, 2, 2, 7, 1]
    rows = [(1, "target", x / 10) for x in pos] + [(1, "other", x / 10) for x in neg] + [(2, "target", 0.7), (2, "target", 0.6), (2, "other", 0.9)]
    got = {r["entity_id"]: r for r in votes.verified(spark.createDataFrame(rows, "entity_id int, label string, label_conf double").coalesce(1)).collect()}
    assert got[1]["verified"] and (got[1]["pos_score"], got[1]["neg_score"], got[1]["votes"]) == (6.2, 3.8, 16) and not got[2]["verified"]


def test_exact_group_members_are_never_near(spark):
    rows = [("a", 1, "s", 10.0, 1, 1, 1.0, [0]), ("b", 1, "s", 10.0, 2, 1, 1.0, [0]), ("c", 2, "t", 10.5, 1, 1, 1.0, [0]), ("d", 3, "u", 10.2, 1, 1, 1.0, [1])]
    m = spark.createDataFrame(rows, "path string, size bigint, sha1 string, duration double, width int, height int, bitrate double, phash array<bigint>")
    got = {(r["kind"], r["path"], r["primary_path"], r["distance"]) for r in media.scan_duplicates(m).collect()}
    assert got == {("exact", "a", "b", 0.0), ("exact", "b", "b", 0.0), ("near", "c", "d", 1.0), ("near", "d", "d", 0.0)}


def test_banded_recall(spark):
    """Buckets two seconds wide miss close pairs of long items; geometric ones do not."""
    m = spark.createDataFrame([("a", 100.0, [0]), ("b", 106.5, [0])], "path string, duration double, phash array<bigint>")
    assert media.banded_pairs(m).count() == 0 and media.banded_pairs(m, exact=True).count() == 1


@pytest.mark.parametrize("label,conf,review_mode,threshold,want", [("uncertain", 0.9, True, 0.75, "queue"), ("target_absent", 0.9, True, 0.75, "direct_absent"), ("target_found", 0.60, True, 0.75, "queue"), ("target_found", 0.75, True, 0.75, "direct"), ("target_found", 0.74, True, 0.70, "direct"), ("uncertain", 0.1, False, 0.75, "direct")])
def test_review_route(spark, label, conf, review_mode, threshold, want):
    assert spark.range(1).select(review.review_route(F.lit(label), F.lit(conf), review_mode, threshold).alias("r")).first()["r"] == want


@pytest.mark.parametrize("seeds,covered,step,forced,want", [(2, 20.0, 5, False, list(range(25, 100, 5))), (0, 20.0, 5, False, []), (0, 20.0, 5, True, list(range(25, 100, 5))), (2, 50.0, 5, False, list(range(55, 100, 5))), (2, 20.0, 10, False, list(range(30, 100, 10)))])
def test_checkpoints(spark, seeds, covered, step, forced, want):
    assert spark.range(1).select(sampling.retry_checkpoints(F.lit(100.0), F.lit(covered), F.lit(seeds), step, forced).alias("t")).first()["t"] == want


def test_sample_times(spark):
    t = lambda n: spark.range(1).select(sampling.sample_times(F.lit(n), 2.0).alias("t")).first()["t"]
    assert t(3.5) == [0, 2, 4] and t(5.0) == [0, 2, 4]


def test_one_frame_cannot_verify(spark):
    with pytest.raises(ValueError):
        votes.verified(spark.createDataFrame([], "entity_id int, label string, label_conf double"), frames=1)


def test_exact_pair_statistics_do_not_list_pairs(spark):
    v = vectors(12, 5)
    d = [1 - max(-1, min(1, v[i] @ v[j])) for i in range(12) for j in range(i)]
    t = spark.createDataFrame([("g", i, x.tolist()) for i, x in enumerate(v)], "label string, vec_id bigint, embedding array<double>")
    r = memory.intra_distances(t, "label", "vec_id", "embedding").first()
    assert r["pairs"] == len(d) and r["mean_distance"] == pytest.approx(np.mean(d)) and r["sd_distance"] == pytest.approx(np.std(d))


def test_move_plan_takes_the_first_free_name(spark):
    """Against a loop over paths; wishes and taken names that end in _n."""
    rng = np.random.default_rng(6)
    names = ["a.mp4", "a_1.mp4", "a_1_1.mp4", "a_2.mp4", "b.mp4", "b", "c_7.mp4", "c.mp4"]
    wishes = [(f"p{k:03d}", f"f{k % 3}", str(rng.choice(names))) for k in range(90)] + [(f"z{k}", "g", "only.mkv") for k in range(5)]
    taken = [("f0", "a_3.mp4"), ("f1", "c.mp4"), ("f1", "c_1.mp4"), ("f2", "zzz.mp4")]
    for held in ([], taken):
        used, want = set(held), {}
        for path, folder, name in sorted(wishes):
            stem, dot, end = name.partition(".")
            target, k = name, 0
            while (folder, target) in used:
                k += 1
                target = f"{stem}_{k}{dot}{end}"
            used.add((folder, target))
            want[path] = target
        m = spark.createDataFrame(wishes, "path string, folder string, name string")
        got = media.move_plan(m, spark.createDataFrame(held, "folder string, name string") if held else None)
        assert {r["path"]: r["target"] for r in got.collect()} == want


def test_fold_goes_on_from_stored_prototypes(spark):
    kind = "label string, ts bigint, event_id bigint, confidence double, embedding array<double>"
    log = spark.createDataFrame([("a", 1, 1, 0.5, [0.0, 1.0]), ("b", 1, 2, 0.5, [0.0, 0.0]), ("b", 2, 3, 0.25, [0.0, 2.0]), ("c", 1, 4, 0.5, [1.0, 0.0])], kind)
    start = spark.createDataFrame([("a", [2.0, 0.0], 1, 0.75), ("c", [0.0, 1.0], 0, 9.0), ("d", [0.0, 1.0], 4, 2.0)], "label string, prototype array<double>, sample_count bigint, confidence_sum double")
    got = {r["label"]: (np.round(r["prototype"], 4).tolist(), r["sample_count"], r["confidence_sum"]) for r in memory.prototypes(log, start).collect()}
    assert got == {"a": ([0.7071, 0.7071], 2, 1.25), "b": ([0.0, 2.0], 1, 0.25), "c": ([1.0, 0.0], 1, 0.5), "d": ([0.0, 1.0], 4, 2.0)}


def test_merge_keeps_what_has_no_count(spark):
    kind = "label string, prototype array<double>, sample_count bigint, confidence_sum double, pos_count bigint, neg_count bigint, locked boolean, last_used string, last_corrected_at string, aux_prototype array<double>, aux_sample_count bigint, aux_last_used string, aux_threshold double, locked_at string"
    a = ("a", [0.0, 3.0], 0, 0.0, 1, 0, False, "2", None, [1.0, 0.0], 3, "5", 0.4, None)
    b = ("b", None, 0, 0.0, 0, 2, True, "1", "3", [0.0, 1.0], 1, "4", None, "t")
    r = memory.merged(spark.createDataFrame([a, b], kind), F.lit("b")).first()
    assert r["prototype"] == [0.0, 1.0] and r["sample_count"] == 0 and r["locked"] and r["locked_at"] == "t" and r["aux_threshold"] == 0.4
    assert np.allclose(r["aux_prototype"], np.array([3, 1]) / np.sqrt(10)) and r["aux_sample_count"] == 4 and r["aux_last_used"] == "5" and r["last_used"] == "2"


@pytest.mark.parametrize("parts", ["1", "16"])
def test_last_before_and_ranks_across_parts(spark, parts):
    """A stream of all rows in many parts, with nulls between the values and groups that are null."""
    from tessera.operators.ordered import last_before, numbered

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [("a" if k % 9 else None, k, None if k % 5 < 3 and k < 80 else k) for k in range(200)]
        df = spark.createDataFrame(rows, "g string, k bigint, v bigint").repartition(3)
        got = {r["k"]: (r["n"], r["b"]) for r in numbered(last_before(df, ["g"], ["k"], F.col("v"), "b"), ["g"], ["k"], "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in ("a", None):
        last = None
        for n, (_, k, v) in enumerate(r for r in rows if r[0] == g):
            assert got[k] == (n, last)
            last = v if v is not None else last


def test_first_hits_and_rates_of_one_stream(spark):
    rng = np.random.default_rng(8)
    t = np.sort(rng.choice(4000, 300, replace=False))
    df = spark.createDataFrame([("s", int(x), k, k, bool(k in (170, 200))) for k, x in enumerate(t)], "entity_id string, ts bigint, rank bigint, done bigint, hit boolean").repartition(5)
    hits, seen = sampling.first_hits(df)
    assert [r["rank"] for r in hits.collect()] == [170] and seen.first()["evaluated"] == 171
    p = df.select(F.col("entity_id").alias("stream"), F.timestamp_seconds("ts").alias("ts"), "done")
    got = {r["done"]: r["per_minute"] for r in sampling.rolling_rate(p).collect()}
    for k in range(300):
        o = max([j for j in range(k) if t[j] < t[k] - 300], default=0)
        assert got[k] == pytest.approx((k - o) / (t[k] - t[o]) * 60 if t[k] > t[o] else 0.0)


def test_a_family_of_many_wishes_is_spread(spark):
    """Against the loop: one name wished 400 times, with taken numbers in runs, odd ones among them."""
    taken = [("f", f"x_{k}.mp4") for k in (1, 2, 3, 7, 50, 51, 399, 1000)] + [("f", "x.mp4"), ("f", "x_05.mp4"), ("f", "x_9_1.mp4"), ("f", "x_99999999999999999999.mp4"), ("g", "x_2.mp4")]
    wishes = [(f"p{k:03d}", "f", "x.mp4") for k in range(400)] + [("q0", "g", "x_2.mp4"), ("q1", "g", "x_2.mp4"), ("q2", "h", "y")]
    used, want = set(taken), {}
    for path, folder, name in sorted(wishes):
        stem, dot, end = name.partition(".")
        target, k = name, 0
        while (folder, target) in used:
            k += 1
            target = f"{stem}_{k}{dot}{end}"
        used.add((folder, target))
        want[path] = target
    m = spark.createDataFrame(wishes, "path string, folder string, name string").repartition(4)
    assert {r["path"]: r["target"] for r in media.move_plan(m, spark.createDataFrame(taken, "folder string, name string")).collect()} == want
