"""Line dedup by distinct-site spread.

A line is a text's part between newlines, trimmed of spaces; blank lines are never touched. A line whose
spread, the number of distinct sites (`source`) whose documents hold it, reaches `min_sites` is boilerplate:
it stays at its first place (the smallest doc_id, there the first position) and goes everywhere else.

A line is known by 128 bits of hashes. Documents that hold boilerplate are few as a rule: what they lose is broadcast to
the scan of texts if its counted rows stay within `BROADCAST_ROWS`, else texts shuffle.

Spread is estimated by a HyperLogLog sketch of sites per line hash, built on each partition and merged by
aggregation. A line seen fewer than `min_sites` times cannot reach the threshold and needs no sketch.
Estimates beyond `MARGIN` of the threshold decide (over ten standard errors at 2^12 registers); lines
nearer to it get exact distinct counts.

Edge cases: a null text stays null and an empty one empty; a null source is no site; a document with a null
doc_id is cleaned too but is the first place of a line only if no document with an id holds it. Repeated
rows (equal doc_id) are one document and are cleaned alike. Empty tables give empty results. All columns of
the input are kept; names starting with `_ld_` are this operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, saved

MIN_SITES = 10
MARGIN = 0.25
REGISTERS = 12
BROADCAST_ROWS = 200_000


def _lines(text):
    return F.split(text, "\n")


def _key(line):
    """128 bits that stand for a line: among 10^11 lines two that differ share them with a chance below 10^-16."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def line_table(docs: DataFrame) -> DataFrame:
    """h, site and doc_id of every line that is not blank, one row for each document and line."""
    at = docs.select("doc_id", "source", F.explode(_lines(F.col("text"))).alias("line")).select("doc_id", F.xxhash64("source").alias("site"), F.col("source").isNotNull().alias("sited"), F.trim("line").alias("line"))
    return at.where("line <> ''").select(_key(F.col("line")).alias("h"), F.when(F.col("sited"), F.col("site")).alias("site"), "doc_id")


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, first (smallest doc_id) and spread's origin ('sketch' or 'exact') of each line at min_sites or more."""
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= min_sites)
    often = cut(often)
    held = rows.where("site is not null").join(_small(often.select("h")), "h", "left_semi")
    spread = cut(held.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", REGISTERS)).alias("sites")))
    sure = spread.where(F.col("sites") >= min_sites * (1 + MARGIN)).select("h", F.lit("sketch").alias("by"))
    near = spread.where((F.col("sites") < min_sites * (1 + MARGIN)) & (F.col("sites") >= min_sites * (1 - MARGIN))).select("h")
    exact = held.join(_small(near), "h", "left_semi").select("h", "site").distinct().groupBy("h").count().where(F.col("count") >= min_sites).select("h", F.lit("exact").alias("by"))
    return often.select("h", "first").join(sure.unionByName(exact), "h")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast, if a count shows that it may be."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines removed from text, and _ld_lines and _ld_removed: lines before, and taken out."""
    rows = saved(line_table(docs), "lines")
    bad = cut(boilerplate(rows, min_sites).select("h", "first"))
    # per document the boilerplate hashes that it holds: those to drop, and those whose first place it is
    hit = rows.join(_small(bad), "h").select("doc_id", "h", F.col("doc_id").eqNullSafe(F.col("first")).alias("own")).distinct()
    hit = hit.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("own"), F.col("h"))).alias("_ld_drop"), F.collect_list(F.when(F.col("own"), F.col("h"))).alias("_ld_once"))
    hit = cut(hit.withColumnRenamed("doc_id", "_ld_id"))
    joined = docs.join(_small(hit), F.col("doc_id").eqNullSafe(F.col("_ld_id")), "left")
    cols = [c for c in docs.columns if c != "text"]
    split = joined.select(*cols, "text", "_ld_drop", "_ld_once", _lines(F.col("text")).alias("_ld_parts"))
    hashed = split.withColumn("_ld_hash", F.when(F.col("_ld_drop").isNotNull(), F.transform("_ld_parts", lambda x: _key(F.trim(x)))))
    parts = F.filter(
        F.arrays_zip(F.col("_ld_parts").alias("line"), F.col("_ld_hash").alias("h"), F.sequence(F.lit(1), F.size("_ld_parts")).alias("at")),
        lambda x: ~F.array_contains(F.col("_ld_drop"), x["h"]) & (~F.array_contains(F.col("_ld_once"), x["h"]) | (F.array_position("_ld_hash", x["h"]) == x["at"])),
    )
    kept = hashed.withColumn("_ld_kept", F.when(F.col("_ld_hash").isNotNull(), F.transform(parts, lambda x: x["line"])))
    out = kept.withColumn("_ld_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("_ld_parts"))).withColumn("_ld_removed", F.when(F.col("_ld_kept").isNull(), 0).otherwise(F.size("_ld_parts") - F.size("_ld_kept")))
    text = F.when(F.col("_ld_kept").isNotNull(), F.array_join("_ld_kept", "\n")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.columns, "_ld_lines", "_ld_removed")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The columns of docs, text without boilerplate and n_chars anew; documents left without a word go."""
    got = clean(docs, min_sites)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("_ld_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return got.where((F.col("_ld_removed") == 0) | (F.trim(F.translate("text", "\n", " ")) != "")).select(docs.columns)


ORACLE = f"""
WITH parts AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
l AS (SELECT *, trim(line) AS key FROM parts),
bad AS (SELECT key, min(doc_id) AS first FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}),
seen AS (SELECT l.*, bad.first, row_number() OVER (PARTITION BY l.doc_id, l.key ORDER BY pos) AS nth FROM l LEFT JOIN bad USING (key)),
flag AS (SELECT *, first IS NOT NULL AND NOT (doc_id = first AND nth = 1) AS gone FROM seen)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
FROM flag GROUP BY doc_id
"""
