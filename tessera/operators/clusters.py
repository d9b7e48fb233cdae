"""Density clustering of vectors, robust centroids and the greedy merge of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec
from tessera.operators.graph import components
from tessera.operators.moments import top_share, vector_sums
from tessera.operators.similarity import linked, similar_pairs
from tessera.session import Shelf, carried, cut, dealt_by, small

carried(__name__)

#: Similar centroid pairs up to which the greedy pass runs on the driver.
DRIVER_PAIRS = 100_000
#: Mean vectors that may be broadcast; counted first.
MEANS = 20_000


def dbscan(vectors: DataFrame, eps: float = 0.35, min_samples: int = 1, pool_noise: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and root (smallest core member) of every usable vector.

    Core rows have min_samples rows within eps, themselves included; clusters are the components of core rows; a
    border row joins its neighbouring cluster of smallest root; noise stays alone or, with `pool_noise`, shares
    the null root. Links between core rows come as forests from each task (`similarity.linked`), never all of them.
    """
    nodes = vectors.select(F.col(key).alias("node"), vec.normalized(F.col(vector)).alias("x")).where("x is not null").select("node")
    found = cut(linked(vectors, 1 - eps, min_samples - 1, key, vector))
    edges = found.where("v is not null").select("u", "v")
    if min_samples > 2:
        core = cut(found.where("v is null").groupBy("u").agg(F.sum("n").alias("n")).where(F.col("n") + 1 >= min_samples).select("u"))
        ends = lambda c: core.select(F.col("u").alias(c))
        root = components(edges.join(ends("u"), "u", "left_semi").join(ends("v"), "v", "left_semi"))
        roots = ends("node").join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        border = both.join(core, "u", "left_anti").join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("root")).select(F.col("u").alias("node"), "root")
        roots = roots.unionByName(border)
    else:  # every row with a link is core
        roots = components(edges)
    alone = F.lit(None).cast(dict(vectors.dtypes)[key]) if pool_noise and min_samples > 1 else F.col("node")
    return nodes.join(roots, "node", "left").select(F.col("node").alias(key), F.coalesce("root", alone).alias("root"))


def robust_centroids(members: DataFrame, group: str = "root", key: str = "vec_id", vector: str = "embedding", share: float = 0.8) -> DataFrame:
    """group, n and centroid: the mean of the `share` of members nearest the mean direction, normalised.

    Sums combine within tasks before the shuffle; the cut at ceil(share n), ties by key, is found by counts of bins of similarity
    (`moments.top_share`), so a cluster of all rows is spread over all tasks.
    """
    with Shelf(members.sparkSession, "centroids") as shelf:
        u = shelf.put(members.select(F.col(group).alias("g"), F.col(key).alias("k"), vec.normalized(F.col(vector)).alias("x")).where("x is not null"))
        mean = shelf.put(vector_sums(u, "g", "x").select("g", F.col("n").alias("size"), F.transform("total", lambda a: a / F.col("n")).alias("m")))
        near = u.join(small(mean.drop("size"), MEANS), "g").select("g", "k", "x", F.coalesce(vec.cosine(F.col("x"), F.col("m")), F.lit(0.0)).alias("s"))
        kept = top_share(near, "g", "s", "k", share, shelf)
        out = vector_sums(kept, "g", "x").join(mean.select("g", "size"), "g")
        return cut(out.select(F.col("g").alias(group), F.col("size").alias("n"), vec.normalized(F.transform("total", lambda a: a / F.col("n"))).alias("centroid")))


def greedy_merge(centroids: DataFrame, threshold: float = 0.78, group: str = "root") -> DataFrame:
    """group and cluster_id (from 1): each seed in order takes the later groups not yet taken whose centroid is as
    near to the seed's own as the threshold. Neither transitive nor symmetric, as the rule has it.

    Similar pairs are found in Spark; the pass over them is a greedy independent set, run in rounds: a group whose
    earlier neighbours are all taken is a seed, and takes its later neighbours.
    """
    pairs = cut(similar_pairs(centroids, threshold, group, "centroid", score=False))
    nodes = centroids.select(F.col(group).alias("node"))
    if pairs.limit(DRIVER_PAIRS + 1).count() <= DRIVER_PAIRS:
        return _merge_here(nodes, pairs, group)
    state = cut(nodes.withColumn("seed", F.lit(None).cast(dict(centroids.dtypes)[group])))
    while True:
        open_ = state.where("seed is null").select("node")
        if open_.isEmpty():
            break
        live = pairs.join(open_.select(F.col("node").alias("u")), "u", "left_semi").join(open_.select(F.col("node").alias("v")), "v", "left_semi")
        seeds = open_.join(live.select(F.col("v").alias("node")), "node", "left_anti")
        took = live.join(seeds.select(F.col("node").alias("u")), "u").groupBy("v").agg(F.min("u").alias("by")).select(F.col("v").alias("node"), "by")
        new = seeds.select("node", F.col("node").alias("by")).unionByName(took)
        state = cut(state.join(new, "node", "left").select("node", F.coalesce("seed", "by").alias("seed")))
    return _numbered(state, group)


def _merge_here(nodes: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """The pass over a bounded list of pairs: only groups with a pair come to the driver."""
    near: dict = {}
    for r in pairs.collect():
        near.setdefault(r["u"], []).append(r["v"])
    seed: dict = {}
    for u in sorted(set(near) | {v for vs in near.values() for v in vs}):
        if u not in seed:
            seed[u] = u
            for v in near.get(u, ()):
                seed.setdefault(v, u)
    spark, kind = nodes.sparkSession, nodes.schema["node"].dataType.simpleString()
    moved = spark.createDataFrame([(a, b) for a, b in seed.items() if a != b], f"node {kind}, seed {kind}")
    state = nodes.join(moved, "node", "left").select("node", F.coalesce("seed", "node").alias("seed"))
    return _numbered(state, group)


def _numbered(state: DataFrame, group: str) -> DataFrame:
    """Dense ids from 1 in order of seed: seeds are range-partitioned, counted and numbered from where a partition starts."""
    laid = cut(state.select("seed").distinct().repartitionByRange("seed").sortWithinPartitions("seed").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = laid.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    from pyspark.sql import Window

    # one row for each partition
    starts = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "first", "before")
    ids = laid.join(F.broadcast(starts), "part").select("seed", (F.col("before") + F.col("at") - F.col("first") + 1).alias("cluster_id"))
    return state.join(ids, "seed").select(F.col("node").alias(group), "cluster_id")


def cluster(vectors: DataFrame, eps: float = 0.35, min_samples: int = 1, merge: float = 0.78, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and cluster_id of every usable vector: density clusters, robust centroids, greedy merge, dense ids."""
    roots = cut(dbscan(vectors, eps, min_samples, key=key, vector=vector))
    joined = roots.join(vectors.select(key, vector), key)
    ids = greedy_merge(cut(robust_centroids(joined, "root", key, vector)), merge)
    return roots.join(ids, "root").select(key, "cluster_id")


def stabilized(track: DataFrame, same: float = 0.72, repeat: float = 0.985, shift: float = 0.8) -> DataFrame:
    """entity_id, kept positions, votes and score of the running track of detections.

    track: entity_id, seq, embedding, x1, y1, x2, y2, extent (the longer side of the frame), label, label_conf. The
    first row of an entity starts it; a later one is kept if it is like the running mean, has not moved too far and
    is no repeat of the last kept one. State runs in order of seq, a batch at a time.
    """
    laid = dealt_by(track.select("entity_id", "seq", vec.doubles(F.col("embedding")).alias("e"), "x1", "y1", "x2", "y2", "extent", "label", "label_conf").where("e is not null"), "entity_id").sortWithinPartitions("entity_id", "seq")

    def run(batches):
        unit = lambda v: v / (np.linalg.norm(v) + vec.EPS)
        now = None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                e = np.asarray(r.e, float)
                if now is None or now["id"] != r.entity_id:
                    if now is not None:
                        rows.append(_out(now))
                    now = {"id": r.entity_id, "kept": [int(r.seq)], "mean": e.copy(), "last": e, "box": (r.x1, r.y1, r.x2, r.y2), "pos": 0.0, "neg": 0.0, "votes": 1}
                    _vote(now, r.label, r.label_conf)
                    continue
                moved = abs((r.x1 + r.x2) - (now["box"][0] + now["box"][2])) + abs((r.y1 + r.y2) - (now["box"][1] + now["box"][3]))
                if unit(now["mean"]) @ unit(e) < same or moved > r.extent * shift or unit(now["last"]) @ unit(e) >= repeat:
                    continue
                if r.label in ("target", "other") and r.label_conf > 0:
                    now["votes"] += 1
                    _vote(now, r.label, r.label_conf)
                now["kept"].append(int(r.seq))
                now["last"], now["box"] = e, (r.x1, r.y1, r.x2, r.y2)
                mean = now["mean"] + (e - now["mean"]) / len(now["kept"])
                size = np.linalg.norm(mean)
                now["mean"] = mean / size if size > vec.EPS else mean
            if rows:
                yield pd.DataFrame(rows, columns=_COLS)
        if now is not None:
            yield pd.DataFrame([_out(now)], columns=_COLS)

    kind = dict(track.dtypes)["entity_id"]
    return laid.mapInPandas(run, f"entity_id {kind}, kept array<bigint>, votes bigint, pos_score double, neg_score double")


_COLS = ["entity_id", "kept", "votes", "pos_score", "neg_score"]


def _vote(now: dict, label: str, conf: float) -> None:
    if label == "target":
        now["pos"] += float(conf)
    elif label == "other":
        now["neg"] += float(conf)


def _out(now: dict) -> tuple:
    return now["id"], now["kept"], now["votes"], now["pos"], now["neg"]
