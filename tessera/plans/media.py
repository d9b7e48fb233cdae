"""Queries over documents, pages and parts as media, paths and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vec
from tessera.functions.scalar import base_name, folder_name, normal_path, stem, suffix
from tessera.operators import media, sampling
from tessera.plans.registry import query, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("%s/doc_%08d.mp4", F.col("source"), F.col("doc_id")).alias("path"), "doc_id", "source", F.col("n_chars").alias("size"), F.sha1(F.encode("text", "utf-8")).alias("sha1"), (F.col("n_chars") / 100.0).alias("duration"), (F.col("doc_id") % 7 * 160).alias("width"), (F.col("doc_id") % 5 * 90).alias("height"), F.lit(100.0).alias("bitrate"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.format_string("v%06d", F.col("vec_id")).alias("path"), F.col("vec_id").alias("size"), F.col("vec_id").cast("string").alias("sha1"), (F.lit(20.0) + F.col("vec_id") % 40).alias("duration"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(1.0).alias("bitrate"), F.array(vec.hash_bits(F.col("embedding"))).alias("phash"))


_MEDIA = "d AS (SELECT format('{}/doc_{:08d}.mp4', source, doc_id) AS path, doc_id, source, n_chars AS size, sha1(text) AS sha1, n_chars / 100.0::DOUBLE AS duration, doc_id % 7 * 160 AS width, doc_id % 5 * 90 AS height FROM documents)"
_HASH = """h AS (SELECT vec_id, format('v{:06d}', vec_id) AS path, 20.0::DOUBLE + vec_id % 40 AS duration, CAST(embedding AS DOUBLE[]) AS v, median(x) AS m FROM (SELECT vec_id, embedding, unnest(CAST(embedding AS DOUBLE[])[2:]) AS x FROM embeddings) GROUP BY vec_id, embedding),
s AS (SELECT vec_id, path, duration, array_to_string(list_transform(v, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS bits FROM h),
p AS (SELECT a.path AS u, b.path AS v, hamming(a.bits, b.bits) AS distance FROM s a JOIN s b ON a.path < b.path AND abs(a.duration - b.duration) <= greatest(1, greatest(a.duration, b.duration) * 0.08) AND abs(floor(a.duration / 2) - floor(b.duration / 2)) <= 2)"""


@query(f"WITH {_MEDIA} SELECT size, sha1, min(path) AS group_id, count(*) AS n FROM d GROUP BY size, sha1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.exact_groups(_documents(spark, sf_dir))


@query(f"WITH {_MEDIA}, g AS (SELECT *, min(path) OVER (PARTITION BY size, sha1) AS group_id, count(*) OVER (PARTITION BY size, sha1) AS members, row_number() OVER (PARTITION BY size, sha1 ORDER BY width * height DESC, size DESC, path) AS k FROM d) SELECT group_id, path AS primary_path, members FROM g WHERE k = 1 AND members > 1")
def dup_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return media.primaries(d.join(media.exact_groups(d).select("size", "sha1", "group_id"), ["size", "sha1"]))


@query(f"WITH {_MEDIA} SELECT path FROM d QUALIFY count(*) OVER (PARTITION BY size, sha1) = 1")
def exact_excluded_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.without_exact(_documents(spark, sf_dir)).select("path")


_BAND = "SELECT a.path AS a, b.path AS b FROM s a JOIN s b ON a.path < b.path AND abs(a.duration - b.duration) <= greatest(1, greatest(a.duration, b.duration) * 0.08)"


@query(f"WITH {_HASH} {_BAND} AND abs(floor(a.duration / 2) - floor(b.duration / 2)) <= 2")
def dup_candidates_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.banded_pairs(_vectors(spark, sf_dir), hashes=False).select("a", "b")


@query(f"WITH {_HASH} {_BAND}")
def dup_candidates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.banded_pairs(_vectors(spark, sf_dir), exact=True, hashes=False).select("a", "b")


@query(f"WITH {_HASH} SELECT u, v, CAST(distance AS DOUBLE) AS distance FROM p WHERE distance <= 22")
def phash_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.near_pairs(_vectors(spark, sf_dir), 22.0)


@query(f"WITH RECURSIVE {_HASH}, q AS (SELECT u, v FROM p WHERE distance <= 22), b AS (SELECT u, v FROM q UNION ALL SELECT v, u FROM q), r AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen) SELECT node AS path, min(seen) AS group_id FROM r GROUP BY node")
def phash_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.near_groups(_vectors(spark, sf_dir), 22.0)


@query("WITH t AS (SELECT page_id % 40 AS g, lower(regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\\.[^.]+$', '\\1')) AS stem FROM pages), n AS (SELECT g, count(*) AS files FROM t GROUP BY g), k AS (SELECT g, unnest(list_distinct(list_filter(regexp_split_to_array(stem, '[^a-z0-9]+'), lambda x: len(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN (" + ",".join(f"'{w}'" for w in media.STOPWORDS) + ")))) AS token FROM t), c AS (SELECT g, token, count(*) AS c FROM k GROUP BY g, token), b AS (SELECT g, token, c, row_number() OVER (PARTITION BY g ORDER BY c DESC, len(token) DESC, token DESC) AS rn FROM c) SELECT n.g AS group_id, CASE WHEN b.c >= greatest(2, (files + 1) // 2) THEN upper(token[1]) || token[2:] END AS name FROM n LEFT JOIN b ON b.g = n.g AND b.rn = 1")
def folder_name_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("group_id"), F.col("url").alias("path"))
    return media.infer_names(p)


@query("""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), '_+', '_', 'g'), ''), 'Unknown') AS folder, regexp_extract(url, '([^/]*)/*$', 1) AS name FROM pages""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", folder_name(F.col("url")).alias("folder"), base_name(F.col("url")).alias("name"))


@query("WITH t AS (SELECT url AS path, 'f' || (page_id % 3) AS folder, 'page' || (page_id % 20) || '.mp4' AS name FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY path) - 1 AS k FROM t) SELECT path, folder, CASE WHEN k = 0 THEN name ELSE replace(name, '.mp4', '') || '_' || k || '.mp4' END AS target FROM k")
def move_plan_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return media.move_plan(p.select(F.col("url").alias("path"), F.concat(F.lit("f"), F.col("page_id") % 3).alias("folder"), F.concat(F.lit("page"), F.col("page_id") % 20, F.lit(".mp4")).alias("name")))


@query("WITH t AS (SELECT 'f' || (page_id % 3) AS folder, 'page' || (page_id % 20) AS base FROM pages) SELECT folder, base, count(*) AS files, count(*) AS targets FROM t GROUP BY folder, base")
def move_plan_distinct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wishes that end in _1 or _2 beside those that do not: as many targets as files."""
    n, tail = F.col("page_id"), F.when(F.col("page_id") % 4 == 1, "_1").when(F.col("page_id") % 4 == 2, "_2").otherwise("")
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.concat(F.lit("f"), n % 3).alias("folder"), F.concat(F.lit("page"), n % 20, tail, F.lit(".mp4")).alias("name"))
    plan = media.move_plan(p).withColumn("base", F.regexp_extract("target", r"^(page\d+)", 1))
    return plan.groupBy("folder", "base").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("target").alias("targets"))


@query("""WITH t AS (SELECT p_partkey AS k, 'lib/' || CASE WHEN p_partkey % 7 = 0 THEN 'Uncertain' ELSE 'c' || (p_partkey % 11) END || '/' || (p_partkey // 11) || '/clip' || (p_partkey % 9) || CASE WHEN p_partkey % 10 = 0 THEN '.txt' WHEN p_partkey % 5 = 0 THEN '.wmv' WHEN p_partkey % 2 = 0 THEN '.m4v' ELSE '.mp4' END AS path, p_partkey % 13 <> 0 AS there FROM part),
c AS (SELECT *, CASE WHEN NOT there THEN 'missing' WHEN k % 5 = 0 THEN 'not_media' WHEN k % 7 = 0 THEN 'excluded_folder' ELSE 'move' END AS outcome FROM t),
m AS (SELECT path, k, row_number() OVER (PARTITION BY k % 11, k % 9, k % 2 ORDER BY path) - 1 AS n FROM c WHERE outcome = 'move')
SELECT c.path, outcome, 'lib/Duplicates/c' || (c.k % 11) || '/clip' || (c.k % 9) || CASE WHEN n = 0 THEN '' ELSE '_' || n END || CASE WHEN c.k % 2 = 0 THEN '.m4v' ELSE '.mp4' END AS destination FROM c LEFT JOIN m USING (path)""")
def duplicates_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    top = F.when(k % 7 == 0, "Uncertain").otherwise(F.concat(F.lit("c"), k % 11))
    path = F.concat(F.lit("lib/"), top, F.lit("/"), F.floor(k / 11), F.lit("/clip"), k % 9, F.when(k % 10 == 0, ".txt").when(k % 5 == 0, ".wmv").when(k % 2 == 0, ".m4v").otherwise(".mp4"))
    return media.duplicate_moves(table(spark, sf_dir, "part").select(path.alias("path"), (k % 13 != 0).alias("exists")), "lib")


@query("WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'Uncertain/' WHEN 1 THEN 'Entity_1/' WHEN 2 THEN 'Absent/' WHEN 3 THEN 'a/b/' ELSE '' END || replace(p_name, ' ', '_') || CASE p_partkey % 7 WHEN 0 THEN '.MP4' WHEN 1 THEN '.txt' WHEN 2 THEN '.m4v' WHEN 3 THEN '.wmv' WHEN 4 THEN '.MOV' WHEN 5 THEN '.webm' ELSE '.mkv' END AS path FROM part) SELECT path FROM t WHERE k % 5 IN (3, 4) AND k % 7 NOT IN (1, 3)")
def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    folder = F.when(k % 5 == 0, "Uncertain/").when(k % 5 == 1, "Entity_1/").when(k % 5 == 2, "Absent/").when(k % 5 == 3, "a/b/").otherwise("")
    end = F.element_at(F.array(*map(F.lit, (".MP4", ".txt", ".m4v", ".wmv", ".MOV", ".webm", ".mkv"))), (k % 7 + 1).cast("int"))
    return media.listed(table(spark, sf_dir, "part").select(F.concat(folder, F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), end).alias("path"))).select("path")


@query("WITH d AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS duration FROM documents) SELECT doc_id, unnest(list_transform(range(0, CAST(ceil((least(60.0, duration) + 1.0) / 2.0) AS BIGINT)), lambda k: CAST(k * 2.0 AS DOUBLE))) AS ts FROM d")
def sample_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select("doc_id", F.explode(sampling.sample_times(F.least(F.lit(60.0), F.col("duration")), 2.0)).alias("ts"))


@query("WITH d AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS duration, doc_id % 4 AS seeds FROM documents), t AS (SELECT doc_id, duration, unnest(range(5, 100, 5)) / 100.0::DOUBLE AS r FROM d WHERE seeds > 0 AND duration > 20) SELECT doc_id, CAST(count(*) AS BIGINT) AS n, round(sum(round(duration * r, 6)), 4) AS total FROM t WHERE round(duration * r, 6) > 20 + 1e-6 AND round(duration * r, 6) < duration GROUP BY doc_id")
def retry_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    t = d.select("doc_id", F.explode(sampling.retry_checkpoints(F.col("duration"), F.lit(20.0), F.col("doc_id") % 4)).alias("t"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("t"), 4).alias("total"))


@query("WITH d AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS duration FROM documents WHERE n_chars / 100.0 > 40.0), t AS (SELECT doc_id, duration, duration * unnest([0.35, 0.60, 0.80]::DOUBLE[]) AS s FROM d) SELECT doc_id, floor(s * 1000 + 0.5) / 1000 AS start_s, floor(least(duration, s + 30.0) * 1000 + 0.5) / 1000 AS end_s FROM t WHERE s + 1 < duration AND least(duration, s + 30.0) > s + 1")
def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _documents(spark, sf_dir).select("doc_id", F.inline(sampling.late_windows(F.col("duration"), 30.0)))
    r = lambda c: F.floor(F.col(c) * 1000 + 0.5) / 1000
    return w.select("doc_id", r("start").alias("start_s"), r("end").alias("end_s"))


@query("WITH t AS (SELECT url FROM pages) SELECT url, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\\.[^.]+$', '\\1') AS stem, regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '^.+(\\.[^.]+)$', 1) AS suffix FROM t")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", stem(F.col("url")).alias("stem"), suffix(F.col("url")).alias("suffix"))


@query("SELECT p_partkey, greatest(0, p_size - 10) AS width, CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, p_partkey % 40 - 8) END AS fps, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 40 <= 8 OR p_partkey % 100 <= 20 THEN 0.0::DOUBLE ELSE (p_partkey % 100 - 20) / (p_partkey % 40 - 8)::DOUBLE END AS duration, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 40 <= 8 THEN 25.0::DOUBLE ELSE p_partkey % 40 - 8 END AS scan_fps, CASE WHEN p_partkey % 100 <= 20 THEN 0.0::DOUBLE ELSE (p_partkey % 100 - 20) / (CASE WHEN p_partkey % 5 = 0 OR p_partkey % 40 <= 8 THEN 25.0::DOUBLE ELSE p_partkey % 40 - 8 END) END AS scan_duration FROM part")
def media_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, rates and counts that may be null, NaN or negative."""
    k = F.col("p_partkey")
    fps = F.when(k % 10 == 0, float("nan")).when(k % 5 != 0, (k % 40 - 8).cast("double"))
    raw = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 10).alias("width"), F.lit(None).cast("int").alias("height"), fps.alias("fps"), (k % 100 - 20).alias("frames"))
    scan = media.scan_meta(raw).select("p_partkey", F.col("fps").alias("scan_fps"), F.col("duration").alias("scan_duration"))
    return media.described(raw).select("p_partkey", "width", "fps", "duration").join(scan, "p_partkey")


@query("SELECT CASE p_partkey % 6 WHEN 0 THEN 'Uncertain' WHEN 1 THEN '.hidden' ELSE 'c' || (p_partkey % 6) END AS folder, count(*) AS files FROM part WHERE p_partkey % 4 NOT IN (0, 1) AND p_partkey % 6 NOT IN (0, 1) AND p_partkey % 7 <> 0 GROUP BY 1")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    folder = F.when(k % 6 == 0, "Uncertain").when(k % 6 == 1, ".hidden").otherwise(F.concat(F.lit("c"), k % 6))
    path = F.concat(folder, F.when(k % 7 == 0, "/sub/").otherwise("/"), k, F.when(k % 4 == 0, ".txt").when(k % 4 == 1, ".wmv").when(k % 4 == 2, ".M4V").otherwise(".MKV"))
    return media.folder_counts(table(spark, sf_dir, "part").select(path.alias("path")))


@query(f"""WITH {_MEDIA}, g AS (SELECT *, min(path) OVER (PARTITION BY size, sha1) AS group_id, count(*) OVER (PARTITION BY size, sha1) AS members, first_value(path) OVER (PARTITION BY size, sha1 ORDER BY width * height DESC, size DESC, path) AS primary_path, first_value(width * height) OVER (PARTITION BY size, sha1 ORDER BY width * height DESC, size DESC, path) AS resolution FROM d)
SELECT group_id, primary_path, string_agg(path, ',' ORDER BY path) FILTER (path <> primary_path) AS duplicates, CAST(max(members) - 1 AS INTEGER) AS duplicate_count, max(resolution) AS resolution, 100.0::DOUBLE AS bitrate, max(size) AS size FROM g WHERE members > 1 GROUP BY group_id, primary_path""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts with their copies in order (no item is near another here: hashes are far apart)."""
    m = _documents(spark, sf_dir).withColumn("phash", F.array().cast("array<bigint>"))
    r = media.duplicate_report(media.scan_duplicates(m), m)
    return r.select("group_id", "primary_path", F.array_join("duplicate_paths", ",").alias("duplicates"), "duplicate_count", "quality.resolution", "quality.bitrate", "quality.size")


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/' || g || '/' || n WHEN 1 THEN g || '/' || n WHEN 2 THEN '../' || n WHEN 3 THEN n WHEN 4 THEN '/' || n ELSE '.' END AS path FROM (SELECT page_id, 'g' || (page_id % 7) AS g, CAST(page_id AS VARCHAR) AS n FROM pages)")
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    g, n = F.concat(F.lit("g"), F.col("page_id") % 7), F.col("page_id").cast("string")
    forms = [F.concat(F.lit("//"), g, F.lit("/./x/../"), n, F.lit("/")), F.concat(F.lit("./"), g, F.lit("//"), n), F.concat(g, F.lit("/../../"), n), F.concat(g, F.lit("/h/../../"), n), F.concat(F.lit("/../"), g, F.lit("/../"), n), F.concat(g, F.lit("/.."))]
    raw = forms[-1]
    for k, form in enumerate(forms[:-1]):
        raw = F.when(F.col("page_id") % 6 == k, form).otherwise(raw)
    return p.select("page_id", normal_path(raw).alias("path"))
