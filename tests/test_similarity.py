"""Similarity joins, matches, hash joins and group sums, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.fusion import MODES, Fusion, rerank_arrays
from tessera.operators import clusters, media, memory, moments, similarity
from tessera.session import Shelf


def clustered(n, dim, groups, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)


def pairs(x, least):
    s = x @ x.T
    return {(i, j) for i, j in zip(*np.nonzero(s >= least)) if i < j}


@pytest.mark.parametrize("spread, least", [(0.05, 0.9), (0.4, 0.6), (3.0, 0.3), (0.05, -1.0)])
def test_pairs_are_whole_where_blocks_are_skipped(spark, monkeypatch, spread, least):
    monkeypatch.setattr(similarity, "BLOCK", 24)
    monkeypatch.setattr(similarity, "CELL", 6)
    x = clustered(300, 12, 15, spread, 1)
    df = table(spark, x)
    assert {(r["u"], r["v"]) for r in similarity.similar_pairs(df, least).collect()} == pairs(x, least)
    with Shelf(spark, "test") as shelf:
        dealt, cells = similarity.celled(df, least, shelf, "vec_id", "embedding")
        met = similarity.visited(dealt, cells).select("a", "b").distinct().count()
    every = cells.blocks() * (cells.blocks() + 1) // 2
    assert met <= every and (spread > 0.05 or least < 0 or met < every / 2)  # clusters keep most blocks apart


def test_a_large_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    x = np.tile(np.array([[1.0, 0.0, 0.0]]), (100, 1))
    x[90:] = [0.0, 1.0, 0.0]
    df = table(spark, x)
    got = {(r["u"], r["v"]) for r in similarity.similar_pairs(df, 0.99).collect()}
    assert got == pairs(x, 0.99)
    assert similarity.similar_pairs(df.where("vec_id < 0"), 0.9).count() == 0


def test_text_keys_and_degenerate_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [float("nan"), 1.0]), ("f", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assert [(r["u"], r["v"]) for r in similarity.similar_pairs(df, 0.9).collect()] == [("a", "b")]


@pytest.mark.parametrize("blocks", [(4096, 4096), (7, 30)])
def test_best_identity_by_blocks(spark, monkeypatch, blocks):
    """Second vectors that may be missing on either side, thresholds of each identity, equal prototypes, labels to leave out."""
    monkeypatch.setattr(similarity, "IDENTITIES", blocks[0])
    monkeypatch.setattr(similarity, "RESULTS", blocks[1])
    rng = np.random.default_rng(2)
    p, q, t = rng.normal(size=(40, 6)), rng.normal(size=(40, 6)), rng.uniform(0.3, 0.8, 40)
    p[5], q[5], t[5] = p[30], q[30], t[30]  # a tie: the first position wins
    x, y = p[rng.integers(40, size=120)] + 0.7 * rng.normal(size=(120, 6)), rng.normal(size=(120, 6))
    known = [(k, "" if k == 3 else f"id{k}", p[k].tolist(), None if k % 5 == 0 and k != 5 and k != 30 else q[k].tolist(), None if k % 7 == 0 else float(t[k])) for k in range(40)]
    rows = [(k, None if k == 9 else [0.0] * 6 if k == 10 else x[k].tolist(), None if k % 3 == 0 else y[k].tolist(), "kept") for k in range(120)]
    identities = spark.createDataFrame(known, "position bigint, label string, prototype array<double>, aux_prototype array<double>, same_threshold double")
    results = spark.createDataFrame(rows, "id bigint, embedding array<double>, aux_embedding array<double>, row string").repartition(3)
    rule = Fusion(least_aux=0.1, low=0.3, high=0.3)
    got = {r["id"]: r["match"] for r in similarity.best_identity(results, identities, 0.5, rule).collect()}
    assert len(got) == 120 and got[9] is None and got[10] is None
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    seen = set()
    for k, e, a, _ in rows:
        if k in (9, 10):
            continue
        best = None
        for pos, label, proto, aux, thr in known:
            if not label:
                continue
            s, z = unit(e) @ unit(proto), np.nan if a is None or aux is None else unit(a) @ unit(aux)
            ok, fused, mode = rerank_arrays(np.array([s]), np.array([z]), np.array([0.5 if thr is None else thr]), rule)
            if ok[0] and (best is None or fused[0] > best[1] + 1e-12):
                best = (label, fused[0], s, z if mode[0] == 3 else None, MODES[mode[0]])
        m = got[k]
        assert (m is None) == (best is None)
        if best:
            seen.add(best[4])
            assert (m["label"], m["mode"]) == (best[0], best[4]) and m["score"] == pytest.approx(best[1], abs=1e-6) and m["primary"] == pytest.approx(best[2], abs=1e-6)
            assert (m["aux"] is None) == (best[3] is None) and (best[3] is None or m["aux"] == pytest.approx(best[3], abs=1e-6))
    assert {"direct_accept", "ambiguous_fused", "ambiguous_primary"} <= seen
    none = similarity.best_identity(results, identities.where("position < 0"), 0.5, rule)
    assert none.columns == [*results.columns, "match"] and none.where("match is not null").count() == 0 and none.count() == 120


def distance(a, b):
    n = min(len(a), len(b))
    return sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a[:n], b[:n])) / n


@pytest.mark.parametrize("most, exact", [(8.0, True), (8.0, False), (3.5, True), (0.0, True), (22.0, True)])
def test_hash_pairs(spark, monkeypatch, most, exact):
    """A hot duration and hot frames: most rows have one clip length, and a third begin with one black frame."""
    monkeypatch.setattr(media, "HOT", 20)
    rng = np.random.default_rng(3)
    signed = lambda v: int(v) - 2**64 if v >= 2**63 else int(v)
    base = [[int(rng.integers(0, 2**63)) * 2 + int(rng.integers(2)) for _ in range(4)] for _ in range(12)]
    rows = []
    for k in range(150):
        h = list(base[int(rng.integers(12))])[: int(rng.integers(1, 5))]
        for f in range(len(h)):
            for b in rng.choice(64, int(rng.integers(0, 11)), replace=False):
                h[f] ^= 1 << int(b)
        if k % 3 == 0:
            h[0] = 0
        duration = 30.0 if k % 4 else float(rng.uniform(0.5, 60))
        rows.append((f"p{k:03d}", duration, [signed(x) for x in h]))
    rows += [("none", 30.0, []), ("null", 30.0, None), ("zero", 0.0, [0])]
    df = spark.createDataFrame(rows, "path string, duration double, phash array<bigint>").repartition(3)
    got = {(r["u"], r["v"]): r["distance"] for r in media.near_pairs(df, most, exact).collect()}
    want = {}
    for a, da, ha in rows[:150]:
        for b, db, hb in rows[:150]:
            close = abs(da - db) <= max(1.0, max(da, db) * 0.08) and (exact or abs(da // 2 - db // 2) <= 2)
            if a < b and close and distance(ha, hb) <= most:
                want[a, b] = distance(ha, hb)
    assert got == want and want


@pytest.mark.parametrize("score", ["apart", "equal", "few"])
def test_top_share_without_a_window_over_a_group(spark, monkeypatch, score):
    monkeypatch.setattr(moments, "BINS", 8)
    rng = np.random.default_rng(4)
    value = {"apart": lambda: float(rng.normal()), "equal": lambda: 0.5, "few": lambda: float(rng.integers(3))}[score]
    rows = [(0 if k % 10 else 1 + k % 7, k, value()) for k in range(700)]
    df = spark.createDataFrame(rows, "g bigint, k bigint, s double").repartition(5)
    with Shelf(spark, "test") as shelf:
        out = moments.top_share(df, "g", "s", "k", 0.37, shelf)
        got = sorted(r["k"] for r in out.collect())
    want = []
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        want += [r[1] for r in mine[: int(np.ceil(len(mine) * 0.37))]]
    assert got == sorted(want)


@pytest.mark.parametrize("held", [4_000_000, 50])
def test_sums_and_moments(spark, monkeypatch, held):
    monkeypatch.setattr(moments, "HELD", held)
    x = np.random.default_rng(5).normal(size=(200, 5))
    rows = [(None if k % 50 == 0 else f"g{min(k % 9, 4)}", x[k].tolist()) for k in range(200)] + [("g0", None)]
    df = spark.createDataFrame(rows, "g string, x array<double>").repartition(4)
    got = {r["g"]: r for r in moments.vector_sums(df, "g", "x", second=True).collect()}
    for g in {r[0] for r in rows}:
        mine = np.array([r[1] for r in rows if r[0] == g and r[1] is not None])
        assert got[g]["n"] == len(mine) and np.allclose(got[g]["total"], mine.sum(axis=0)) and np.allclose(np.array(got[g]["moment"]).reshape(5, 5), mine.T @ mine)
    assert len(got) == 6 and moments.vector_sums(df.where("g = 'none'"), "g", "x").count() == 0


def test_distances_and_centroids_of_one_hot_group(spark):
    x = clustered(400, 6, 1, 0.5, 6)
    df = table(spark, x).withColumn("g", F.lit(1))
    r = memory.intra_distances(df, "g", "vec_id", "embedding").first()
    d = 1 - (x @ x.T)[np.triu_indices(400, 1)]
    assert r["pairs"] == len(d) and r["mean_distance"] == pytest.approx(d.mean()) and r["sd_distance"] == pytest.approx(d.std())
    mean = x.mean(axis=0)
    s = x @ mean / np.linalg.norm(mean)
    keep = x[np.argsort(-s, kind="stable")[:320]].mean(axis=0)
    c = clusters.robust_centroids(df, "g").first()
    assert c["n"] == 400 and np.allclose(c["centroid"], keep / np.linalg.norm(keep), atol=1e-6)
    plan = clusters.robust_centroids(df, "g")._jdf.queryExecution().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("spread, least", [(0.05, 0.9), (0.4, 0.6)])
def test_top_pairs_and_pairs_over_tiles(spark, monkeypatch, spread, least):
    """Blocks of several tiles; a task hands on its first pairs alone, and all of them are found."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "BLOCKS", 4)
    x = clustered(300, 12, 15, spread, 8).astype(np.float32)
    df = table(spark, x).withColumn("embedding", F.col("embedding").cast("array<float>"))
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = pairs(x, least)
    assert {(r["u"], r["v"]) for r in similarity.similar_pairs(df, least, score=False).collect()} == want
    top = sorted(want, key=lambda p: (-x[p[0]] @ x[p[1]], p))[:20]
    assert [(r["u"], r["v"]) for r in similarity.top_pairs(df, least, 20).collect()] == top
    handed = similarity.linked(df, least).count()
    assert handed <= 300 * 7 and (spread > 0.05 or handed < len(want))  # forests, not pairs


@pytest.mark.parametrize("samples", [1, 2, 3, 5])
@pytest.mark.parametrize("lot", [1 << 18, 10])
def test_clusters_from_forests(spark, monkeypatch, samples, lot):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "LOT", lot)
    x = clustered(160, 5, 40, 0.25, 9)
    s = x @ x.T >= 0.9
    core = s.sum(axis=1) >= samples
    root = np.arange(160)
    for _ in range(160):
        root = np.array([min([root[i], *(root[j] for j in np.flatnonzero(s[i] & core))]) if core[i] else i for i in range(160)])
    want = {i: int(root[i] if core[i] else min([root[j] for j in np.flatnonzero(s[i] & core)], default=i)) for i in range(160)}
    got = {r["vec_id"]: r["root"] for r in clusters.dbscan(table(spark, x), 0.1, samples).collect()}
    assert got == want and (samples < 3 or not core.all())


@pytest.mark.parametrize("exact", [True, False])
def test_hash_groups_come_as_forests(spark, monkeypatch, exact):
    """Hot durations in several parts: the groups of all pairs, from far fewer links than pairs."""
    monkeypatch.setattr(media, "PART", 40)
    monkeypatch.setattr(media, "TILE", 16)
    rng = np.random.default_rng(10)
    signed = lambda v: int(v) - 2**64 if v >= 2**63 else int(v)
    base = [int(rng.integers(0, 2**63)) for _ in range(6)]
    rows = []
    for k in range(240):
        h = base[int(rng.integers(6))]
        for b in rng.choice(64, int(rng.integers(0, 9)), replace=False):
            h ^= 1 << int(b)
        rows.append((f"p{k:03d}", k, str(k), 30.0 if k % 3 else float(rng.uniform(0.5, 60)), [signed(h)]))
    df = spark.createDataFrame(rows, "path string, size bigint, sha1 string, duration double, phash array<bigint>").repartition(3)
    pairs_ = [(r["u"], r["v"]) for r in media.near_pairs(df, 22.0, exact).collect()]
    close = lambda a, b: abs(a - b) <= max(1.0, max(a, b) * 0.08) and (exact or abs(a // 2 - b // 2) <= 2)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and close(a[3], b[3]) and distance(a[4], b[4]) <= 22}
    assert len(pairs_) == len(set(pairs_)) and set(pairs_) == want
    root = {p: p for pair in want for p in pair}
    for _ in range(240):
        for u, v in want:
            root[u] = root[v] = min(root[u], root[v])
    assert {r["path"]: r["group_id"] for r in media.near_groups(df, 22.0, exact).collect()} == root
    links = media._by_buckets(*media._bucketed(df, exact), 22.0, True).count()
    assert links < len(want) / 2


@pytest.mark.parametrize("exact", [True, False])
def test_close_pairs_by_loops(spark, exact):
    """Blocks smaller than buckets, durations of all sizes, null and repeated paths."""
    rng = np.random.default_rng(11)
    rows = [(f"p{int(k):04d}", float(d)) for k, d in zip(rng.integers(0, 900, 700), rng.choice([rng.uniform(0.1, 30), 25.0, 27.0, 400.0], 700) + rng.integers(0, 3, 700))]
    rows += [(None, 25.0), ("null", None), ("zero", 0.0), ("less", -1.0)]
    m = spark.createDataFrame([(p, d, [1]) for p, d in rows], "path string, duration double, phash array<bigint>").repartition(3)
    near = lambda x, y: abs(x - y) <= max(1.0, max(x, y) * 0.08) and (exact or abs(x // 2 - y // 2) <= 2)
    held = [(p, d) for p, d in rows if p and d and d > 0]
    want = sorted((a, x, b, y) for a, x in held for b, y in held if a < b and near(x, y))
    got = media.banded_pairs(m, exact=exact)
    assert got.columns == ["a", "da", "ha", "b", "db", "hb"] and sorted(tuple(r) for r in got.drop("ha", "hb").collect()) == want
    assert media.banded_pairs(m, exact=exact, hashes=False).columns == ["a", "da", "b", "db"]


@pytest.mark.parametrize("exact", [True, False])
def test_close_pairs_of_one_duration(spark, tmp_path, exact):
    """A bucket's pairs come from several tasks, and take little room when they are written."""
    n = 2500
    m = spark.range(n).select(F.format_string("v%06d", F.col("id") * 7919 % 100_003).alias("path"), F.lit(30.0).alias("duration"), F.array(F.col("id")).alias("phash"))
    pairs = media.banded_pairs(m, exact=exact).select("a", "b")
    pairs.write.parquet(f"{tmp_path}/pairs")
    parts = [spark.read.parquet(str(p)).count() for p in (tmp_path / "pairs").glob("*.parquet")]
    room = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet"))
    assert sum(parts) == n * (n - 1) // 2 and max(parts) < 0.7 * sum(parts)
    assert room < 0.5 * sum(parts), room / sum(parts)


def test_close_pairs_take_little_room_whatever_the_paths(spark, tmp_path):
    """A task's paths fit a dictionary of Parquet, however long they are and however few the parts."""
    n, long = 2500, "d" * 500
    m = spark.range(n).select(F.format_string(f"{long}%06d", F.col("id") * 7919 % 100_003).alias("path"), F.lit(30.0).alias("duration"), F.array(F.col("id")).alias("phash"))
    media.banded_pairs(m).select("a", "b").write.parquet(f"{tmp_path}/pairs")
    room = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/pairs").where("a < b").count() == n * (n - 1) // 2
    assert room < n * (n - 1) // 2, room
