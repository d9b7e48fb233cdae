"""Queries over embeddings: similarity, matching, clustering, prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vec
from tessera.functions.fusion import Fusion
from tessera.functions.scalar import half_up
from tessera.config import Config
from tessera.operators import clusters, memory, run
from tessera.operators.similarity import best_identity, rerank_counts, similar_pairs, top_pairs
from tessera.plans.registry import query, table

EPS = 0.60
#: The supplied vectors are nearly orthogonal; matching queries use thresholds at that scale.
SAME, AUTO, SUGGEST = 0.30, 0.42, 0.34

V = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"
PROTO = """d AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / n AS x FROM e),
m AS (SELECT label, i, avg(x) AS x FROM d GROUP BY label, i),
p AS (SELECT label, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM m GROUP BY label)"""


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean direction of each label, as learned identities."""
    u = table(spark, sf_dir, "embeddings").select("label", F.posexplode(vec.normalized(F.col("embedding"))).alias("i", "x"))
    m = u.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("prototype"))
    return m.select(F.col("label").alias("position"), F.col("label").cast("string").alias("label"), "prototype")


@query(f"WITH {V} SELECT label, count(*) AS n, count(*) FILTER (WHERE n > 1e-8) AS usable, round(avg(n), 4) AS mean_norm, round(max(len(v)), 0)::BIGINT AS dims FROM e GROUP BY label")
def vec_normalize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(vec.normalized(F.col("embedding"))).alias("usable"), F.round(F.avg(vec.norm(F.col("embedding"))), 4).alias("mean_norm"), F.max(F.size("embedding")).cast("bigint").alias("dims"))


@query(f"WITH {V} SELECT a.vec_id AS u, b.vec_id AS v, round(list_dot_product(a.v, b.v) / (a.n * b.n), 4) AS similarity FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.3 ORDER BY list_dot_product(a.v, b.v) / (a.n * b.n) DESC, u, v LIMIT 50")
def cosine_topk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return top_pairs(table(spark, sf_dir, "embeddings"), 0.3, 50).withColumn("similarity", F.round("similarity", 4))


@query(f"WITH {V}, {PROTO}, s AS (SELECT e.vec_id, p.label, list_dot_product(e.v, p.v) / (e.n * p.n + 1e-8) AS s FROM e CROSS JOIN p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s WHERE s >= {SAME}) SELECT vec_id, CAST(label AS VARCHAR) AS matched, round(s, 4) AS score FROM r WHERE k = 1")
def prototype_top1_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = best_identity(table(spark, sf_dir, "embeddings"), _identities(spark, sf_dir), SAME, Fusion(enabled=False))
    return m.where("match is not null").select("vec_id", F.col("match.label").alias("matched"), F.round("match.score", 4).alias("score"))


_RERANK = f"""WITH {V}, {PROTO},
s AS (SELECT e.vec_id, p.label, list_dot_product(e.v, p.v) / (e.n * p.n + 1e-8) AS a, list_dot_product(list_reverse(e.v), p.v) / (e.n * p.n + 1e-8) AS b FROM e CROSS JOIN p),
f AS (SELECT *, 0.65 * a + 0.35 * b AS f FROM s),
r AS (SELECT CASE WHEN a >= {SAME} + 0.06 THEN 'direct_accept' WHEN a < {SAME} - 0.08 THEN 'direct_reject' ELSE 'ambiguous_fused' END AS mode,
  CASE WHEN a >= {SAME} + 0.06 THEN true WHEN a < {SAME} - 0.08 THEN false ELSE f >= {SAME} AND b >= 0.1 END AS accepted FROM f)
SELECT mode, accepted, count(*) AS n FROM r GROUP BY mode, accepted"""


@query(_RERANK)
def rerank_mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against every prototype; the vector backwards stands for the second one."""
    p = _identities(spark, sf_dir).select("position", "label", "prototype", F.col("prototype").alias("aux_prototype"))
    e = table(spark, sf_dir, "embeddings").select("embedding", F.reverse("embedding").alias("aux_embedding"))
    return rerank_counts(e, p, SAME, Fusion(least_aux=0.1))


@query(f"""WITH {V}, {PROTO},
s AS (SELECT e.vec_id, p.label, list_dot_product(e.v, p.v) / (e.n * p.n + 1e-8) AS a, list_dot_product(list_reverse(e.v), p.v) / (e.n * p.n + 1e-8) AS b FROM e CROSS JOIN p),
f AS (SELECT vec_id, label, CASE WHEN a >= {SAME} + 0.06 THEN 'direct_accept' WHEN a < {SAME} - 0.08 THEN 'direct_reject' ELSE 'ambiguous_fused' END AS mode, a, b, 0.65 * a + 0.35 * b AS f FROM s),
r AS (SELECT *, CASE mode WHEN 'direct_accept' THEN a WHEN 'ambiguous_fused' THEN CASE WHEN f >= {SAME} AND b >= 0.1 THEN f END END AS score FROM f)
SELECT vec_id, CAST(label AS VARCHAR) AS matched, mode, round(score, 4) AS score, CASE WHEN mode = 'ambiguous_fused' THEN round(b, 4) END AS aux FROM r WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""")
def reid_top1_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best identity by both vectors; the vector backwards stands for the second one."""
    p = _identities(spark, sf_dir).withColumn("aux_prototype", F.col("prototype"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("aux_embedding"))
    m = best_identity(e, p, SAME, Fusion(least_aux=0.1)).where("match is not null")
    return m.select("vec_id", F.col("match.label").alias("matched"), F.col("match.mode").alias("mode"), F.round("match.score", 4).alias("score"), F.round("match.aux", 4).alias("aux"))


_ASSIST = f"""WITH {V}, {PROTO}, s AS (SELECT e.vec_id, p.label, list_dot_product(e.v, p.v) / (e.n * p.n + 1e-8) AS s FROM e CROSS JOIN p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s WHERE s >= {SAME}),
b AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'target_found' WHEN 1 THEN 'uncertain' ELSE 'target_absent' END AS base, (vec_id * 37 % 100) / 100.0::DOUBLE AS conf FROM embeddings),
j AS (SELECT b.*, r.label, r.s, r.label = 0 AS locked, greatest({SUGGEST}, least({AUTO}, 0.44 - 0.01 * r.label)) AS thr FROM b LEFT JOIN r ON r.vec_id = b.vec_id AND r.k = 1),
a AS (SELECT *, coalesce(s >= thr AND (locked OR s - conf >= 0.18 OR conf < 0.65 OR base = 'target_found'), false) AS applied, coalesce(s >= {SUGGEST}, false) AS suggested FROM j)
SELECT vec_id, applied, CASE WHEN applied THEN 'target_found' WHEN suggested THEN 'uncertain' ELSE base END AS final_label,
  floor(least(1.0, greatest(0.0, CASE WHEN applied THEN greatest(conf, s) WHEN suggested THEN greatest({SUGGEST}, least(s, thr)) ELSE conf END)) * 1000 + 0.5) / 1000 AS final_confidence,
  CASE WHEN applied OR suggested THEN CAST(label AS VARCHAR) END AS folder FROM a"""


@query(_ASSIST)
def memory_assist_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's decision after its best learned identity is taken into account."""
    e = table(spark, sf_dir, "embeddings")
    base = e.withColumn("decision_label", F.when(F.col("vec_id") % 3 == 0, "target_found").when(F.col("vec_id") % 3 == 1, "uncertain").otherwise("target_absent")).withColumn("confidence", (F.col("vec_id") * 37 % 100) / 100.0)
    m = best_identity(base, _identities(spark, sf_dir), SAME, Fusion(enabled=False)).withColumn("match", F.when(F.col("match.label").isNotNull(), F.col("match")))
    m = m.withColumn("locked", F.col("match.label") == "0").withColumn("match_threshold", 0.44 - 0.01 * F.col("match.label").cast("int"))
    out = memory.assist(m, memory.Assist(AUTO, SUGGEST))
    return out.select("vec_id", "applied", "final_label", "final_confidence", "folder")


@query(f"WITH {V}, d AS (SELECT a.label, 1 - greatest(-1, least(1, list_dot_product(a.v, b.v) / (a.n * b.n))) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id), g AS (SELECT label, count(*) AS pairs, avg(d) AS m, stddev_pop(d) AS s FROM d GROUP BY label) SELECT label, pairs, round(m, 4) AS mean_distance, round(s, 4) AS sd_distance, round(greatest(0.35, least(0.98, 1 - (m - 2 * s))), 4) AS threshold FROM g")
def intra_label_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = memory.intra_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").where("pairs > 0")
    return s.select("label", "pairs", *(F.round(c, 4).alias(c) for c in ("mean_distance", "sd_distance", "threshold")))


@query(f"""WITH {V}, {PROTO}, s AS (SELECT e.vec_id, e.label, e.v, e.n, list_dot_product(e.v, p.v) / (e.n * p.n + 1e-8) AS s FROM e JOIN p USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS k, count(*) OVER (PARTITION BY label) AS c FROM s),
x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / n AS x FROM r WHERE k <= ceil(c * 0.8)),
y AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i), z AS (SELECT label, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM y GROUP BY label)
SELECT label, (SELECT count(*) FROM e WHERE e.label = z.label) AS n, round(list_dot_product(z.v, p.v) / (z.n * p.n + 1e-8), 4) AS to_mean FROM z JOIN p USING (label)""")
def robust_centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    c = clusters.robust_centroids(e, "label")
    p = _identities(spark, sf_dir).select(F.col("position").alias("label"), "prototype")
    return c.join(p, "label").select("label", "n", F.round(vec.cosine(F.col("centroid"), F.col("prototype")), 4).alias("to_mean"))


_EDGES = f"WITH RECURSIVE {V}, p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= {1 - EPS})"


@query(_EDGES + " SELECT u, v FROM p")
def epsilon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "embeddings"), 1 - EPS, score=False)


_CC = ", b AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p), r AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen)"


@query(_EDGES + _CC + " SELECT e.vec_id, coalesce(min(r.seen), e.vec_id) AS root FROM e LEFT JOIN r ON r.node = e.vec_id GROUP BY e.vec_id")
def dbscan_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dbscan(table(spark, sf_dir, "embeddings"), EPS)


_CORE = """, g AS (SELECT u, count(*) + 1 AS d FROM (SELECT u, v FROM p UNION ALL SELECT v, u FROM p) GROUP BY u), c AS (SELECT u FROM g WHERE d >= 3),
b AS (SELECT u, v FROM (SELECT u, v FROM p UNION ALL SELECT v, u FROM p) WHERE u IN (SELECT u FROM c) AND v IN (SELECT u FROM c)),
r AS (SELECT u AS node, u AS seen FROM c UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen),
k AS (SELECT node, min(seen) AS root FROM r GROUP BY node),
o AS (SELECT x.u AS node, min(k.root) AS root FROM (SELECT u, v FROM p UNION ALL SELECT v, u FROM p) x JOIN k ON k.node = x.v WHERE x.u NOT IN (SELECT u FROM c) GROUP BY x.u)
SELECT e.vec_id, coalesce(k.root, o.root, e.vec_id) AS root FROM e LEFT JOIN k ON k.node = e.vec_id LEFT JOIN o ON o.node = e.vec_id"""


@query(_EDGES + _CORE)
def dbscan_min_samples_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dbscan(table(spark, sf_dir, "embeddings"), EPS, 3)


_GREEDY = _EDGES + _CC + """, k AS (SELECT e.vec_id, coalesce(min(r.seen), e.vec_id) AS root FROM e LEFT JOIN r ON r.node = e.vec_id GROUP BY e.vec_id),
u AS (SELECT vec_id, root, list_transform(v, lambda x: x / n) AS v FROM e JOIN k USING (vec_id)),
h AS (SELECT root, i, avg(x) AS x FROM (SELECT root, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u) GROUP BY root, i), m AS (SELECT root, list(x ORDER BY i) AS m FROM h GROUP BY root),
s AS (SELECT vec_id, root, v, row_number() OVER (PARTITION BY root ORDER BY list_dot_product(v, m) / (sqrt(list_dot_product(m, m)) + 1e-8) DESC, vec_id) AS place, count(*) OVER (PARTITION BY root) AS size FROM u JOIN m USING (root)),
t AS (SELECT root, i, avg(x) AS x FROM (SELECT root, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM s WHERE place <= ceil(size * 0.8)) GROUP BY root, i),
c AS (SELECT root, list(x ORDER BY i) AS c, sqrt(sum(x * x)) AS n FROM t GROUP BY root),
q AS (SELECT a.root AS a, b.root AS b FROM c a JOIN c b ON a.root < b.root WHERE list_dot_product(a.c, b.c) / (a.n * b.n) >= 0.45),
o AS (SELECT root AS node, list_sort(coalesce((SELECT list(b) FROM q WHERE q.a = c.root), [])) AS near FROM c),
g AS (SELECT 0 AS step, CAST(NULL AS BIGINT) AS seed, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS got
  UNION ALL SELECT step + 1, node, list_concat(taken, w), w FROM (SELECT g.step, g.taken, o.node, list_filter(list_prepend(o.node, o.near), lambda x: NOT list_contains(g.taken, x)) AS w FROM g JOIN o ON o.node = (SELECT min(x.node) FROM o x WHERE NOT list_contains(g.taken, x.node)))),
z AS (SELECT step AS cluster_id, unnest(got) AS root FROM g WHERE step > 0)
SELECT vec_id, cluster_id FROM k JOIN z USING (root)"""


@query(_GREEDY)
def greedy_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent; tests hold it against the plain loop, too."""
    return clusters.cluster(table(spark, sf_dir, "embeddings"), EPS, merge=0.45)


_FOLD = """WITH RECURSIVE e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
f AS (SELECT label, k, v AS p FROM e WHERE k = 1
  UNION ALL SELECT label, k, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) FROM (SELECT e.label, e.k, list_transform(range(1, len(v) + 1), lambda i: (p[i] / sqrt(list_dot_product(p, p)) * f.k + v[i]) / (f.k + 1)) AS m FROM f JOIN e ON e.label = f.label AND e.k = f.k + 1))
SELECT CAST(label AS VARCHAR) AS label, k AS sample_count, k * 0.5::DOUBLE AS confidence_sum, round(p[1], 4) AS x0, round(p[2], 4) AS x1 FROM f QUALIFY k = max(k) OVER (PARTITION BY label)"""


@query(_FOLD)
def prototype_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent; tests hold it against the plain loop, too."""
    e = table(spark, sf_dir, "embeddings")
    log = e.select(F.col("label").cast("string").alias("label"), F.col("vec_id").alias("ts"), F.col("vec_id").alias("event_id"), F.lit(0.5).alias("confidence"), "embedding")
    f = memory.prototypes(log)
    return f.select("label", "sample_count", "confidence_sum", F.round(F.element_at("prototype", 1), 4).alias("x0"), F.round(F.element_at("prototype", 2), 4).alias("x1"))


_MERGE = f"""WITH {V}, {PROTO}, c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
w AS (SELECT label % 3 AS target, i, sum(c.n * x / p.n) AS x FROM m JOIN p USING (label) JOIN c USING (label) GROUP BY label % 3, i),
q AS (SELECT target, sqrt(sum(x * x)) AS n, max(CASE WHEN i = 1 THEN x END) AS x0 FROM w GROUP BY target)
SELECT CAST(target AS VARCHAR) AS label, (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE c.label % 3 = target) AS sample_count, (SELECT bool_or(label = 4) FROM c WHERE c.label % 3 = target) AS locked, round(x0 / n, 4) AS x0 FROM q"""


@query(_MERGE)
def identity_merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("position")).agg(F.count(F.lit(1)).alias("sample_count"))
    i = _identities(spark, sf_dir).join(n, "position").withColumns({"confidence_sum": F.lit(0.0), "pos_count": F.lit(0), "neg_count": F.lit(0), "locked": F.col("position") == 4, "last_used": F.lit(None).cast("timestamp"), "last_corrected_at": F.lit(None).cast("timestamp")})
    m = memory.merged(i, (F.col("position") % 3).cast("string"))
    return m.select("label", "sample_count", "locked", F.round(F.element_at("prototype", 1), 4).alias("x0"))


_TRACK = """WITH RECURSIVE e AS (SELECT label AS entity_id, CAST(embedding AS DOUBLE[]) AS v, vec_id * 3 % 50 + vec_id * 7 % 50 AS x, vec_id * 5 % 50 + vec_id * 11 % 50 AS y, vec_id % 4 <> 0 AS pos, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
s AS (SELECT entity_id, k, CAST(1 AS BIGINT) AS kept, v AS mean, v AS last, x, y, CAST(1 AS BIGINT) AS votes, CASE WHEN pos THEN 1 ELSE 0 END AS p, CASE WHEN pos THEN 0 ELSE 1 END AS o FROM e WHERE k = 1
  UNION ALL SELECT entity_id, k, CASE WHEN ok THEN kept + 1 ELSE kept END, CASE WHEN ok THEN list_transform(m, lambda a: a / sqrt(list_dot_product(m, m))) ELSE mean END, CASE WHEN ok THEN v ELSE last END, CASE WHEN ok THEN nx ELSE x END, CASE WHEN ok THEN ny ELSE y END, CASE WHEN ok THEN votes + 1 ELSE votes END, CASE WHEN ok AND pos THEN p + 1 ELSE p END, CASE WHEN ok AND NOT pos THEN o + 1 ELSE o END
  FROM (SELECT s.*, e.k AS nk, e.v, e.x AS nx, e.y AS ny, e.pos, list_transform(range(1, len(e.v) + 1), lambda i: mean[i] + (e.v[i] - mean[i]) / (kept + 1)) AS m,
    list_dot_product(mean, e.v) / ((sqrt(list_dot_product(mean, mean)) + 1e-8) * (sqrt(list_dot_product(e.v, e.v)) + 1e-8)) >= -0.1 AND abs(e.x - s.x) + abs(e.y - s.y) <= 640 * 0.8 AND list_dot_product(last, e.v) / ((sqrt(list_dot_product(last, last)) + 1e-8) * (sqrt(list_dot_product(e.v, e.v)) + 1e-8)) < 0.985 AS ok
    FROM s JOIN e ON e.entity_id = s.entity_id AND e.k = s.k + 1) t(entity_id, old, kept, mean, last, x, y, votes, p, o, k, v, nx, ny, pos, m, ok))
SELECT entity_id, kept, votes, floor(p * 0.8::DOUBLE * 10000 + 0.5) / 10000 AS pos_score, floor(o * 0.8::DOUBLE * 10000 + 0.5) / 10000 AS neg_score FROM s QUALIFY k = max(k) OVER (PARTITION BY entity_id)"""


@query(_TRACK)
def stabilize_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential state; tests hold it against the plain loop, too."""
    e = table(spark, sf_dir, "embeddings")
    t = e.select(F.col("label").alias("entity_id"), F.col("vec_id").alias("seq"), "embedding", *((F.col("vec_id") * k % 50).alias(c) for k, c in ((3, "x1"), (5, "y1"), (7, "x2"), (11, "y2"))), F.lit(640).alias("extent"), F.when(F.col("vec_id") % 4 == 0, "other").otherwise("target").alias("label"), F.lit(0.8).alias("label_conf"))
    return clusters.stabilized(t, same=-0.1).select("entity_id", F.size("kept").cast("bigint").alias("kept"), "votes", half_up(F.col("pos_score"), 4).alias("pos_score"), half_up(F.col("neg_score"), 4).alias("neg_score"))


_RUN = f"""WITH {V}, {PROTO}, s AS (SELECT e.vec_id, p.label, list_dot_product(e.v, p.v) / (e.n * p.n + 1e-8) AS s FROM e CROSS JOIN p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s WHERE s >= {SAME}),
i AS (SELECT vec_id AS i, 'in/' || vec_id || '/' || (vec_id % 40) || '.mp4' AS path, vec_id % 17 = 5 AS bad, vec_id % 19 = 3 AS stopped, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 12 END AS cluster FROM embeddings),
b AS (SELECT *, CASE WHEN i % 4 = 0 THEN 'target_absent' WHEN i % 5 = 0 OR i % 6 < 3 OR i % 8 < 3 THEN 'uncertain' ELSE 'target_found' END AS base,
  CASE WHEN i % 4 = 0 THEN 0.9::DOUBLE WHEN i % 5 = 0 THEN 0.5::DOUBLE WHEN i % 6 < 3 OR i % 8 < 3 THEN 0.45::DOUBLE ELSE floor((0.8::DOUBLE + 0.2::DOUBLE * (i % 10) / 10.0::DOUBLE) * 1000 + 0.5) / 1000 END AS conf FROM i),
j AS (SELECT b.*, r.label, r.s, greatest({SUGGEST}, least({AUTO}, 0.44 - 0.01 * r.label)) AS thr FROM b LEFT JOIN r ON r.vec_id = b.i AND r.k = 1 AND NOT bad AND NOT stopped),
a AS (SELECT *, coalesce(s >= thr AND (label = 0 OR s - conf >= 0.18 OR conf < 0.65 OR base = 'target_found'), false) AS applied, coalesce(s >= {SUGGEST}, false) AS suggested FROM j),
f AS (SELECT *, CASE WHEN bad THEN 'error' WHEN stopped THEN 'stopped' WHEN applied THEN 'target_found' WHEN suggested THEN 'uncertain' ELSE base END AS decision_label,
  CASE WHEN bad OR stopped THEN 0 ELSE floor(least(1.0, greatest(0.0, CASE WHEN applied THEN greatest(conf, s) WHEN suggested THEN greatest({SUGGEST}, least(s, thr)) ELSE conf END)) * 1000 + 0.5) / 1000 END AS confidence FROM a),
g AS (SELECT *, CASE WHEN bad OR stopped THEN NULL WHEN applied THEN CAST(label AS VARCHAR) WHEN cluster IS NOT NULL THEN 'Entity_' || cluster WHEN decision_label = 'uncertain' THEN 'Needs_Review' END AS folder FROM f),
h AS (SELECT *, CASE WHEN bad OR stopped THEN NULL WHEN decision_label = 'uncertain' THEN 'queue' WHEN decision_label = 'target_found' AND confidence < 0.85 THEN 'queue' WHEN decision_label = 'target_absent' THEN 'direct_absent' ELSE 'direct' END AS route FROM g),
t AS (SELECT *, CASE WHEN bad OR stopped THEN NULL WHEN decision_label = 'uncertain' THEN 'Uncertain' WHEN route = 'queue' THEN 'Review_Pending/' || coalesce(folder, 'Entity_Unknown') WHEN decision_label = 'target_found' THEN coalesce(folder, 'Absent') ELSE 'Absent' END AS destination FROM h),
w AS (SELECT i, row_number() OVER (PARTITION BY destination, i % 40 ORDER BY path) - 1 AS k FROM t WHERE destination IS NOT NULL)
"""


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over every embedding as a track, with made-up measures and clusters."""
    i = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("in/"), i, F.lit("/"), i % 40, F.lit(".mp4"))
    m = e.select(
        "vec_id", path.alias("path"), "embedding", F.when(i % 17 == 5, "failed").alias("error"), (i % 19 == 3).alias("stopped"), (i % 4).alias("seeds"), F.lit(True).alias("verified"), F.lit(0.5).alias("best_seed"), F.lit(True).alias("subject_found"),
        F.lit(1.0).alias("appearance"), F.lit(9).alias("subject_frames"), F.lit(1.0).alias("consistency"), ((i % 10) / 10.0).alias("subject_confidence"), F.when(i % 5 == 0, 9).otherwise(i % 6).alias("stable"),
        F.when(i % 5 == 0, 9).otherwise(i % 8).alias("votes"), F.lit(4.0).alias("pos_score"), F.when(i % 5 == 0, 4.0).otherwise(0.0).alias("neg_score"), F.lit(5).alias("faces"), F.lit(1).alias("low_area"),
    )
    known = _identities(spark, sf_dir).withColumn("locked", F.col("label") == "0").withColumn("match_threshold", 0.44 - 0.01 * F.col("label").cast("int"))
    cfg = Config(review=True, review_threshold=0.85, same_threshold=SAME, auto_threshold=AUTO, suggest_threshold=SUGGEST)
    return run.sort_run(m, known, cfg, e.where(i % 7 != 0).select(path.alias("path"), (i % 12).alias("cluster_id")))


@query(_RUN + "SELECT i AS vec_id, decision_label, confidence, applied, folder, route, destination, CASE WHEN k IS NOT NULL THEN (i % 40) || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.mp4' END AS target FROM t LEFT JOIN w USING (i)")
def sort_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).select("vec_id", "decision_label", "confidence", "applied", "folder", "route", "destination", "target")


@query(_RUN + "SELECT count(*) AS scanned, count(*) FILTER (NOT bad AND NOT stopped) AS processed, count(*) FILTER (decision_label = 'target_found') AS found, count(*) FILTER (decision_label = 'uncertain') AS uncertain, count(*) FILTER (decision_label = 'target_absent') AS absent, count(*) FILTER (bad) AS errors, count(destination) AS moved, count(*) - count(destination) AS left_in_source, count(*) FILTER (route = 'queue') AS queued, count(*) FILTER (applied) AS memory_applied, count(*) FILTER (stopped) AS stopped, 0.0::DOUBLE AS seconds FROM t")
def sort_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.run_summary(_run(spark, sf_dir))


@query(f"WITH {V}, d AS (SELECT a.label % 7 AS g, 1 - greatest(-1, least(1, list_dot_product(a.v, b.v) / (a.n * b.n))) AS d FROM e a JOIN e b ON a.label % 7 = b.label % 7 AND a.vec_id < b.vec_id), g AS (SELECT g, count(*) AS pairs, avg(d) AS m, stddev_pop(d) AS s FROM d GROUP BY g), i AS (SELECT DISTINCT label FROM embeddings WHERE label < 5) SELECT coalesce('ID' || i.label, 'Id' || g.g) AS label, CASE WHEN g.g IS NULL THEN 0.5::DOUBLE ELSE round(greatest(0.35, least(0.98, 1 - (m - 2 * s))), 4) END AS same_threshold, pairs, CASE WHEN i.label IS NULL THEN 0 ELSE 3 END::INTEGER AS sample_count FROM g FULL JOIN i ON i.label = g.g")
def thresholds_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of seven groups set on five identities; two groups make new ones."""
    e = table(spark, sf_dir, "embeddings")
    known = e.where("label < 5").select(F.concat(F.lit("ID"), "label").alias("label"), F.lit(0.5).alias("same_threshold"), F.lit(3).alias("sample_count")).distinct()
    stats = memory.intra_distances(e.withColumn("g", F.concat(F.lit("Id"), F.col("label") % 7)), "g", "vec_id", "embedding").withColumnsRenamed({"g": "label", "threshold": "same_threshold"})
    return memory.set_thresholds(known, stats).select("label", F.round("same_threshold", 4).alias("same_threshold"), "pairs", "sample_count")
