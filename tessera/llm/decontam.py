"""Benchmark decontamination: which test items stand inside which documents.

Words are lower-cased runs of letters and digits; shingles are runs of five words. An item of k distinct shingles is contained in a
document that holds at least 0.8 k of them. An item of one to four words is one run of its own width, and contained in every document
that holds that run; documents are cut into runs of such a width only if an item has it.

Items are partitioned by size, [2^c, 2^(c+1)) shingles. An item's sketch is a bottom-m MinHash: its m
shingles of least order, m = k' - ceil(0.8 k') + 1 for the largest k' of its partition, those that fewest items hold first, then by
hash. A document that holds 0.8 k of k shingles misses at most m - 1, so it holds one of the sketch whatever the order: the search loses
no containment, however long the document, where banded signatures would (a 30-word item in a 20,000-word document has a
Jaccard similarity near 0.001), and an opening that many items share is in no sketch while they have words of their own.
Documents meet sketches in a hash join; pairs that share a sketch hash are candidates. Each candidate's item shingles are then looked
up among the document's own, by their words, so the work follows candidates, not pairs that share a common shingle.

Sketches, the items' shingles and the ids of candidate documents are each broadcast only if their own counted
rows stay within `BROADCAST_ROWS`; else both sides shuffle.

Edge cases: a null or empty text holds nothing and an item without words is in no document; rows of one
doc_id (or item_id) are one document (item), their shingles united; rows with a null id are left out of
the pairs, and never removed from documents; empty tables give no pairs. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

WIDTH = 5
BROADCAST_ROWS = 500_000


def _runs(words: Column, width: int) -> Column:
    """Structs w0..w4 of all runs of `width` words, the columns beyond it null."""
    count = F.greatest(F.lit(0), F.size(words) - width + 1)
    if width < WIDTH:
        none = F.array_repeat(F.lit(None).cast("string"), count)
        return F.arrays_zip(*((F.slice(words, k + 1, count) if k < width else none).alias(f"w{k}") for k in range(WIDTH)))
    return F.arrays_zip(*(F.slice(words, k + 1, count).alias(f"w{k}") for k in range(WIDTH)))


def _shingles(df: DataFrame, key: str, widths: list[int] | None = None) -> DataFrame:
    """key and the columns w0..w4 of each shingle, repeats included: runs of each of the widths, or by default
    of five words, of all words where a text has fewer."""
    words = F.array_remove(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), "")
    at = df.where(F.col(key).isNotNull()).select(F.col(key), words.alias("w")).where(F.size("w") > 0)
    w = F.col("w")
    if widths is None:
        runs = _runs(w, WIDTH)
        for k in range(1, WIDTH):
            runs = F.when(F.size(w) == k, _runs(w, k)).otherwise(runs)
    else:
        runs = _runs(w, widths[0]) if len(widths) == 1 else F.concat(*(_runs(w, k) for k in widths))
    return at.select(key, F.inline(runs).alias(*(f"w{k}" for k in range(WIDTH))))


def _width() -> Column:
    return sum((F.col(f"w{k}").isNotNull().cast("int") for k in range(1, WIDTH)), F.lit(1))


def _hash():
    return F.xxhash64(*(F.col(f"w{k}") for k in range(WIDTH)))


def _spelt():
    return F.concat_ws(" ", *(F.col(f"w{k}") for k in range(WIDTH)))


def least_sketch(k):
    """m for items of k shingles: k - ceil(0.8 k) + 1."""
    return k - F.floor((k * 4 + 4) / 5) + 1


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_shingles, shared and containment of every pair at 0.8 or more."""
    own = cut(_shingles(items.select("item_id", "text"), "item_id").select("item_id", _hash().alias("h"), _spelt().alias("shingle"), _width().alias("width")).distinct())
    widths = sorted({WIDTH, *(r["width"] for r in own.select("width").distinct().collect())}, reverse=True)  # five values at most
    by = Window.partitionBy("item_id")
    held_by = own.groupBy("h", "shingle").agg(F.count(F.lit(1)).alias("often"))
    sized = cut(own.join(held_by, ["h", "shingle"]).withColumn("k", F.count(F.lit(1)).over(by)).withColumn("part", F.floor(F.log2("k")).cast("int")))
    most = (F.pow(F.lit(2.0), F.col("part") + 1) - 1).cast("int")
    sketch = sized.withColumn("m", least_sketch(most)).withColumn("place", F.row_number().over(by.orderBy("often", "h", "shingle"))).where("place <= m")
    sketch = cut(sketch.select("h", "item_id").distinct())
    hint = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    text = docs.select("doc_id", "text")
    pairs = _shingles(text, "doc_id", widths).select("doc_id", _hash().alias("h")).join(hint(sketch, sketch.count()), "h").select("doc_id", "item_id").distinct()
    pairs = cut(pairs)
    some = pairs.select("doc_id").distinct()
    near = text.join(F.broadcast(some) if pairs.count() <= BROADCAST_ROWS else some, "doc_id", "left_semi")
    held = _shingles(near, "doc_id", widths).select("doc_id", _hash().alias("h"), _spelt().alias("shingle"), _width().alias("width"))
    held = held.join(hint(own.select("h", "shingle", "width").distinct(), own.count()), ["h", "shingle", "width"], "left_semi").distinct()
    asked = pairs.join(hint(sized.select("item_id", "h", "shingle", "width", "k"), own.count()), "item_id")
    met = asked.join(held, ["doc_id", "h", "shingle", "width"], "left_semi")
    out = met.groupBy("doc_id", "item_id").agg(F.max("k").cast("long").alias("item_shingles"), F.count(F.lit(1)).alias("shared"))
    return out.where("shared * 5 >= item_shingles * 4").withColumn("containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item; rows with a null doc_id stay."""
    bad = cut(contained(docs, items).select("doc_id").distinct())
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, "doc_id", "left_anti").select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT DISTINCT least(len(w), 5) AS n FROM i WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS s FROM d JOIN n ON len(w) >= n),
bs AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS s FROM (SELECT *, least(len(w), 5) AS n FROM i WHERE len(w) > 0)),
k AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s, n) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, CAST(shared AS DOUBLE) / item_shingles AS containment
FROM m JOIN k USING (item_id) WHERE shared * 5 >= item_shingles * 4
"""
