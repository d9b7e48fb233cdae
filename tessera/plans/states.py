"""Queries over the supplied tables as detections, folders, review items, identities and feedback logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar, vec
from tessera.functions.scalar import half_up
from tessera.operators import frames, media, memory, review, sampling, votes
from tessera.plans.events import _DEC, _EV, _decided, _events
from tessera.plans.registry import query, table
from tessera.sources import files


@query("WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'Uncertain/' WHEN 1 THEN '.dot/' WHEN 2 THEN 'c' || (p_partkey % 9) || '/' WHEN 3 THEN 'a/b/' ELSE '' END || 'v' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.M4V' WHEN 1 THEN '.wmv' ELSE '.mov' END AS path FROM part) SELECT path FROM t WHERE k % 5 = 2 AND k % 3 <> 1")
def identity_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media that lie directly in a folder of their own, neither reserved nor hidden."""
    k = F.col("p_partkey")
    folder = F.when(k % 5 == 0, "Uncertain/").when(k % 5 == 1, ".dot/").when(k % 5 == 2, F.concat(F.lit("c"), k % 9, F.lit("/"))).when(k % 5 == 3, "a/b/").otherwise("")
    path = F.concat(folder, F.lit("v"), k, F.when(k % 3 == 0, ".M4V").when(k % 3 == 1, ".wmv").otherwise(".mov"))
    return media.listed(table(spark, sf_dir, "part").select(path.alias("path")), depth=2)


@query(f"""WITH {_EV}, b AS (SELECT event_id, k - 20 AS x1, event_id % 90 - 10 AS y1, k + 30 AS x2, event_id % 90 + 40 AS y2 FROM ev),
e AS (SELECT event_id, CAST(greatest(0, least(floor(x1 - 0.2::DOUBLE * 50), 99)) AS INTEGER) AS bx1, CAST(greatest(0, least(floor(y1 - 0.2::DOUBLE * 50), 79)) AS INTEGER) AS by1, CAST(greatest(0, least(floor(x2 + 0.2::DOUBLE * 50), 100)) AS INTEGER) AS bx2, CAST(greatest(0, least(floor(y2 + 0.2::DOUBLE * 50), 80)) AS INTEGER) AS by2 FROM b)
SELECT event_id, bx1, by1, bx2, by2, floor(greatest(0, bx2 - bx1) * greatest(0, by2 - by1) / 8000.0::DOUBLE * 1000000 + 0.5) / 1000000 AS area_ratio FROM e""")
def boxes_to_the_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes held to the frame's extent, both axes."""
    i, k = F.col("event_id"), F.col("k")
    b = _events(spark, sf_dir).select("event_id", (k - 20).alias("x1"), (i % 90 - 10).alias("y1"), (k + 30).alias("x2"), (i % 90 + 40).alias("y2"), F.lit(100).alias("frame_w"), F.lit(80).alias("frame_h"))
    return votes.boxes(b, 0.2, inclusive=False).select("event_id", "bx1", "by1", "bx2", "by2", half_up(F.col("area_ratio"), 6).alias("area_ratio"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 3 = 1 THEN 'other' WHEN event_id % 3 = 0 THEN 'target' ELSE 'unknown' END AS strict, CASE WHEN event_id % 7 = 0 THEN 'target' WHEN event_id % 3 = 1 THEN 'other' ELSE 'target' END AS kind FROM events")
def attribute_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 attribute that may be missing or neither, under both policies."""
    i = F.col("event_id")
    a = F.when(i % 7 != 0, (i % 3).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", votes.class_of(a).alias("strict"), votes.class_of(a, "positive").alias("kind"))


@query("SELECT event_id FROM events WHERE event_id % 2 <> 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0")
def complete_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    fields = (("ts", 2), ("box", 3), ("embedding", 5), ("label", 7), ("label_conf", 11))
    return frames.complete_seed(table(spark, sf_dir, "events").select("event_id", *(F.when(i % n != 0, F.lit(1.0)).alias(c) for c, n in fields))).select("event_id")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 1 AND vec_id % 4 <> 0 AND vec_id % 5 <> 0 THEN 'provisional' ELSE 'track' END AS embedding_source, vec_id % 4 = 0 OR (vec_id % 3 = 1 AND vec_id % 5 <> 0) AS there FROM embeddings")
def provisional_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain rows without a vector take the seed's, unless that one is zero."""
    i, e = F.col("vec_id"), F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(i % 3 == 1, " Uncertain").otherwise("target_found").alias("decision_label"), F.when(i % 4 == 0, e).alias("embedding"), F.lit("track").alias("embedding_source"), F.when(i % 5 == 0, F.transform(e, lambda x: x * 0)).otherwise(e).alias("seed_embedding"))
    return frames.provisional(rows).select("vec_id", "embedding_source", F.col("embedding").isNotNull().alias("there"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that wait and whose file, a customer with a balance, is there."""
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 0, "approved").otherwise("pending").alias("status"), F.concat(F.lit("q/"), "o_custkey").alias("pending_path"))
    there = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("q/"), "c_custkey").alias("path"))
    return frames.pending(items, there).select("id")


@query("WITH d AS (SELECT l_orderkey AS frame_id, l_linenumber AS det_id, floor(l_quantity / 10) AS s FROM lineitem) SELECT frame_id, det_id, s AS similarity FROM d QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY s DESC, det_id) = 1")
def frame_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as detections of a frame; scores tie often."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("det_id"), "l_quantity")
    return votes.best_match(d, F.floor(F.col("l_quantity") / 10).cast("double")).select("frame_id", "det_id", "similarity")


@query("WITH d AS (SELECT l_orderkey AS e, l_linenumber AS seq, l_discount * 10 AS a, CASE WHEN l_linenumber % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS p, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 0.8::DOUBLE END AS l FROM lineitem) SELECT e AS entity_id, seq FROM d QUALIFY row_number() OVER (PARTITION BY e ORDER BY greatest(0, a) * greatest(0, p) * coalesce(l, p) DESC, seq) = 1")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), n.alias("seq"), (F.col("l_discount") * 10).alias("area_ratio"), F.when(n % 2 == 0, 0.5).otherwise(1.0).alias("prob"), F.when(n % 3 != 0, 0.8).alias("landmark"))
    return frames.representative(d).select("entity_id", "seq")


@query("SELECT n_name AS folder, coalesce(n_nationkey % 3 = 0 AND n_nationkey % 5 = 1, false) AS locked, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE 0 END AS sample_count FROM nation")
def identity_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as folders, every third of which has an identity under another case."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    known = n.where(k % 3 == 0).select(F.concat(F.lit(" "), F.lower("n_name")).alias("label"), (k % 5 == 1).alias("locked"), k.alias("sample_count"))
    return memory.identity_list(n.select(F.col("n_name").alias("folder")), known)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN true WHEN lower(s_name) = lower((SELECT min(s_name) FROM supplier)) THEN true ELSE s_suppkey % 2 = 0 END AS locked FROM supplier")
def locked_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label locked whatever its case; others keep what they had."""
    s = table(spark, sf_dir, "supplier")
    name = s.agg(F.min("s_name").alias("n")).first()["n"]
    k = F.col("s_suppkey")
    ids = s.select("s_suppkey", F.col("s_name").alias("label"), ((k % 4 == 1) | (k % 2 == 0)).alias("locked"))
    return memory.locked(ids, f" {name.upper()} ", True).select("s_suppkey", "locked")


@query("WITH b AS (SELECT c_custkey // 2 AS id, CASE c_custkey // 2 % 3 WHEN 0 THEN 'Beach' WHEN 1 THEN 'Garden' END AS name FROM customer), g AS (SELECT DISTINCT id, name FROM b WHERE id > 0 AND id < (SELECT max(c_custkey) // 2 FROM customer)), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM g) SELECT id AS cluster_id, CASE WHEN name IS NULL THEN 'Entity_' || id WHEN k = 1 THEN 'Entity_' || name ELSE 'Entity_' || name || '_' || k END AS folder FROM k")
def cluster_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers as clusters; a third are named alike, another third too, the rest go by their ids."""
    c = table(spark, sf_dir, "customer")
    top = c.agg(F.floor(F.max("c_custkey") / 2).alias("m")).first()["m"]
    i = F.floor(F.col("c_custkey") / 2)
    name = F.when(i % 3 == 0, "beach_").when(i % 3 == 1, "garden_").otherwise("")
    return media.cluster_folders(c.select(i.alias("cluster_id"), F.concat(F.lit("x/"), name, F.col("c_custkey") % 100, F.lit(".mp4")).alias("path")).where((i > 0) & (i < top)))


@query("SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 7 > 0 THEN list_transform(range(0, 5), lambda j: 2.0::DOUBLE + (o_orderkey % 7) * j / 4.0::DOUBLE) ELSE [2.0::DOUBLE] END) AS ts FROM orders")
def uniform_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(sampling.uniform_times(F.lit(2.0), 2.0 + k % 7, 5)).alias("ts"))


@query("SELECT c_custkey, coalesce(nullif(replace(replace(lower(trim(CASE c_custkey % 4 WHEN 0 THEN ' High Accuracy ' WHEN 1 THEN c_mktsegment || '-X y' WHEN 2 THEN '  ' ELSE 'FAST' END)), '-', '_'), ' ', '_'), ''), 'balanced') AS profile FROM customer")
def profile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, " High Accuracy ").when(k % 4 == 1, F.concat("c_mktsegment", F.lit("-X y"))).when(k % 4 == 2, "  ").otherwise("FAST")
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.profile_key(raw).alias("profile"))


_SAID = "WITH e AS (SELECT event_id, 'L' || (event_id % 6) AS final, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'l' || (event_id % 5) WHEN 2 THEN 'Target_Absent' ELSE '  ' END AS matched, CASE WHEN event_id % 3 = 0 THEN 'L' || (event_id % 7) ELSE '' END AS suggested FROM events), c AS (SELECT *, coalesce(nullif(trim(matched), ''), nullif(trim(suggested), '')) AS candidate FROM e) "


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 4 == 0, "").when(i % 4 == 1, F.concat(F.lit("l"), i % 5)).when(i % 4 == 2, "Target_Absent").otherwise("  ")
    return table(spark, sf_dir, "events").select(i.alias("id"), "ts", F.concat(F.lit("L"), i % 6).alias("final_label"), text.alias("match_label"), F.when(i % 3 == 0, F.concat(F.lit("L"), i % 7)).otherwise("").alias("suggested_folder"))


@query(_SAID + "SELECT event_id, final AS label, CASE WHEN lower(candidate) <> lower(final) AND lower(candidate) <> 'target_absent' THEN candidate END AS negative_label FROM c")
def review_feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.review_feedback(_reviewed(spark, sf_dir)).select("event_id", "label", "negative_label")


@query(_SAID + "SELECT count(*) AS feedback_events, count(*) AS positive_events, count(*) FILTER (lower(candidate) <> lower(final) AND lower(candidate) <> 'target_absent') AS negative_events, 0 AS structural_events, count(*) AS identity_updates, 0 AS absent_events FROM c")
def feedback_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = memory.log_totals(memory.review_feedback(_reviewed(spark, sf_dir)))
    return t.select(*(F.col(c).cast("int").alias(c) if c in ("structural_events", "absent_events") else F.col(c) for c in t.columns))


@query("SELECT event_id, event_id % 2 = 0 AS was_there FROM events ORDER BY ts DESC, event_id DESC LIMIT 700")
def log_after_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of even events after the odd ones; the cap is the operator."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    log = e.where(i % 2 == 0).select("event_id", "ts", F.lit(True).alias("was_there"))
    return memory.appended(log, e.where(i % 2 != 0).select("event_id", "ts"), 700).select("event_id", F.coalesce("was_there", F.lit(False)).alias("was_there"))


@query(f"WITH {_DEC} SELECT 'in/' || event_id || '.mp4' AS path, event_id || '.mp4' AS name, conf AS confidence, CASE WHEN bad THEN 'failed' ELSE '' END AS error, false AS memory_applied, '' AS destination FROM dec")
def item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decided(spark, sf_dir).withColumns({"reason_summary": F.lit(None).cast("string"), "applied": F.lit(None).cast("boolean"), "destination": F.lit(None).cast("string")})
    return review.report_rows(d).select("path", "name", "confidence", "error", "memory_applied", "destination")


@query("SELECT vec_id, vec_id % 5 NOT IN (0, 1, 2) AS usable, vec_id % 5 <> 0 AND vec_id % 5 <> 1 AS finite FROM embeddings")
def usable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are empty, hold a NaN, or are zero, beside sound ones."""
    i, e = F.col("vec_id"), F.col("embedding").cast("array<double>")
    odd = F.when(i % 5 == 0, F.slice(e, 1, 0)).when(i % 5 == 1, F.concat(F.array(F.lit(float("nan"))), e)).when(i % 5 == 2, F.transform(e, lambda x: x * 0)).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", vec.normalized(odd).isNotNull().alias("usable"), vec.finite(odd).alias("finite"))


@query("WITH s AS (SELECT s_suppkey, trim(s_name) AS label, greatest(0, s_suppkey % 30 - 5) AS p, greatest(0, s_suppkey % 11 - 2) AS n FROM supplier) SELECT label, p AS pos_count, n AS neg_count, floor(CASE WHEN p + n > 0 THEN p / (p + n) ELSE 0 END * 10000 + 0.5) / 10000 AS consistency, floor(greatest(0.74, least(0.82, 0.82::DOUBLE - least(0.08, 0.08::DOUBLE * least(1, p / 20) * CASE WHEN p + n > 0 THEN p / (p + n) ELSE 0 END) + least(0.05, 0.05::DOUBLE * least(1, n / 20) * (1 + greatest(0, 0.6::DOUBLE - CASE WHEN p + n > 0 THEN p / (p + n) ELSE 0 END))))) * 10000 + 0.5) / 10000 AS adaptive_threshold, CASE WHEN s_suppkey % 2 = 0 THEN least(1.0::DOUBLE, s_suppkey / 40) END AS same_threshold FROM s")
def identity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored identities with counts below 0, thresholds over 1 and stale derived fields."""
    k = F.col("s_suppkey")
    raw = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), "s_name").alias("label"), F.lit(None).cast("array<double>").alias("prototype"), F.lit(None).cast("int").alias("sample_count"), F.lit(None).cast("double").alias("confidence_sum"), F.lit(None).cast("boolean").alias("locked"), (k % 30 - 5).alias("pos_count"), (k % 11 - 2).alias("neg_count"), F.when(k % 2 == 0, k / 40).alias("same_threshold"), F.lit(0.1).alias("adaptive_threshold"))
    r = files.identity_records(raw)
    return r.select("label", *(F.col(c).cast("bigint").alias(c) for c in ("pos_count", "neg_count")), "consistency", "adaptive_threshold", "same_threshold")
