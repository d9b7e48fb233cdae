"""Packing into optimal length buckets.

A text's length is its number of words (runs free of space, tab, newline and return). Texts longer than
`MAX_LEN` are cut into pieces of MAX_LEN words and a rest, so nothing is lost and the global histogram of
lengths has at most MAX_LEN + 1 entries; that bounded histogram alone goes to the driver. Dynamic programming
over it finds the bucket boundaries (each bucket pads to its largest length) of least total padding:
    best[k][j] = min over i < j of best[k-1][i] + padding of lengths i+1..j to length j
with ties to the smaller i. Within a bucket, pieces in order of doc_id fill batches of
budget // boundary pieces (one at least), so a batch pads to at most the token budget.

Edge cases: null and empty texts are one piece of length 0; rows with a null doc_id come first in their
bucket; repeated rows are packed one by one; fewer distinct lengths than buckets give a bucket each; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, ranked

MAX_LEN = 2048
BUCKETS = 8
BUDGET = 16384


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\r]+")))


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Largest lengths of at most `buckets` buckets with the least padding over a histogram {length: rows}."""
    lengths = sorted(histogram)
    if not lengths:
        return []
    size = np.array(lengths, dtype=np.int64)
    rows = np.array([histogram[x] for x in lengths], dtype=np.int64)
    # object integers where products could pass 64 bits
    kind = np.int64 if int(size[-1] + 1) * int(rows.astype(object).sum() + 1) < 2**62 else object
    c = np.concatenate([[0], np.cumsum(rows.astype(kind))])
    s = np.concatenate([[0], np.cumsum(rows.astype(kind) * size.astype(kind))])
    n, k = len(lengths), min(buckets, len(lengths))
    best = size.astype(kind) * c[1:] - s[1:]  # one bucket up to each length
    came = []
    for level in range(1, k):
        now, by = best.copy(), np.full(n, -1)
        for j in range(level, n):
            cost = best[level - 1 : j] + size[j] * (c[j + 1] - c[level : j + 1]) - (s[j + 1] - s[level : j + 1])
            i = int(np.argmin(cost))
            now[j], by[j] = cost[i], i + level - 1
        best = now
        came.append(by)
    out, j = [int(size[-1])], n - 1
    for by in reversed(came):
        j = int(by[j])
        out.append(int(size[j]))
    return out[::-1]


def pieces(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, chunk and length of every piece."""
    n = docs.select("doc_id", word_count(F.col("text")).alias("words"))
    cut_ = n.select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("words") - 1) / max_len).cast("int")))).alias("chunk"))
    return cut_.select("doc_id", "chunk", F.least(F.lit(max_len), F.col("words") - F.col("chunk") * max_len).alias("length"))


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, chunk, length, bucket, boundary, batch (in its bucket) and slot (in its batch) of every piece."""
    all_ = cut(pieces(docs, max_len))
    edges = boundaries({r["length"]: r["count"] for r in all_.groupBy("length").count().collect()}, buckets) or [0]
    bucket = F.lit(0)
    for b in edges[:-1]:
        bucket = bucket + (F.col("length") > b).cast("int")
    at = all_.withColumn("bucket", bucket).withColumn("boundary", F.element_at(F.lit(edges), F.col("bucket") + 1))
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("boundary")))).cast("long")
    out = ranked(at, ["bucket"], [F.col("doc_id").asc_nulls_first(), F.col("chunk"), F.col("length")], "place")
    return out.select("doc_id", "chunk", "length", "bucket", "boundary", F.floor(F.col("place") / per).cast("long").alias("batch"), F.pmod(F.col("place"), per).cast("int").alias("slot"))


def oracle(buckets: int = BUCKETS, budget: int = BUDGET, max_len: int = MAX_LEN) -> str:
    """The same in SQL: one step of the dynamic program for each bucket."""
    steps = ["s1 AS (SELECT j, CAST(len * cc - ss AS BIGINT) AS cost, -1 AS came FROM h)"]
    for k in range(2, buckets + 1):
        steps.append(f"""s{k} AS (SELECT j, cost, came FROM (SELECT h.j, CAST(p.cost + h.len * (h.cc - g.cc) - (h.ss - g.ss) AS BIGINT) AS cost, p.j AS came,
  row_number() OVER (PARTITION BY h.j ORDER BY p.cost + h.len * (h.cc - g.cc) - (h.ss - g.ss), p.j) AS rn
  FROM s{k - 1} p JOIN h g ON g.j = p.j JOIN h ON h.j > p.j) WHERE rn = 1)""")
    # from the last bucket to the first; fewer distinct lengths than buckets: each is a boundary
    back = [f"b{buckets} AS (SELECT max(j) AS j FROM h)"]
    back += [f"b{k} AS (SELECT came AS j FROM s{k + 1} WHERE j = (SELECT j FROM b{k + 1}))" for k in range(buckets - 1, 0, -1)]
    every = " UNION ".join(f"SELECT j FROM b{k}" for k in range(1, buckets + 1))
    return f"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS words FROM documents),
p AS (SELECT doc_id, CAST(unnest(range(0, greatest(1, (words + {max_len} - 1) // {max_len}))) AS INTEGER) AS chunk, words FROM d),
q AS (SELECT doc_id, chunk, CAST(least({max_len}, words - chunk * {max_len}) AS INTEGER) AS length FROM p),
g0 AS (SELECT length AS len, count(*) AS n FROM q GROUP BY 1),
h AS (SELECT CAST(row_number() OVER (ORDER BY len) AS INTEGER) AS j, CAST(len AS BIGINT) AS len, CAST(sum(n) OVER (ORDER BY len) AS BIGINT) AS cc, CAST(sum(n * len) OVER (ORDER BY len) AS BIGINT) AS ss FROM g0),
{", ".join(steps)}, {", ".join(back)},
e AS (SELECT j FROM h WHERE (SELECT count(*) FROM h) <= {buckets} UNION SELECT j FROM ({every}) WHERE j IS NOT NULL AND (SELECT count(*) FROM h) > {buckets}),
f AS (SELECT CAST(h.len AS INTEGER) AS boundary, CAST(row_number() OVER (ORDER BY h.len) - 1 AS INTEGER) AS bucket FROM h JOIN e USING (j)),
r AS (SELECT q.*, (SELECT min(bucket) FROM f WHERE boundary >= length) AS bucket FROM q),
t AS (SELECT r.*, f.boundary, row_number() OVER (PARTITION BY r.bucket ORDER BY doc_id NULLS FIRST, chunk, length) - 1 AS place, greatest(1, {budget} // greatest(1, f.boundary)) AS per FROM r JOIN f USING (bucket))
SELECT doc_id, chunk, length, bucket, boundary, CAST(place // per AS BIGINT) AS batch, CAST(place % per AS INTEGER) AS slot FROM t
"""
