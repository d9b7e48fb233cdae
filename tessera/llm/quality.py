"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

A preference pair is a labelled good document set against a labelled bad one. The model is linear:
P(i preferred to j) = sigmoid(w . (x_i - x_j)); w minimises the logistic loss over pairs plus an L2
term. A threshold taken as a quantile of the training scores turns a score into a decision.

Features are hashed n-grams of the whole text: four character classes in a row, three bytes in a row, and words
and word pairs, each as the root of their (shrunken) share, beside the shares of distinct words and pairs and of words
that repeat the one before. Shares are shrunken so that a text of a few words, which gives no evidence, stays near the
empty one. The threshold is the score quantile at `QUANTILE` of the bad labels' share, raised by `MARGIN` of what lies
between the classes' medians.

Edge cases: a null text counts as empty; an empty text has no n-gram and gets a score like any
other; a null doc_id is scored but never learnt from; repeated rows are scored alike; an empty table
gives an empty result; with no labels, or labels of one class, every score is 0.5. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried

carried(__name__)

#: Labelled rows of each class that the fit takes at most.
SAMPLE = 1000
#: Preference pairs drawn from them.
PAIRS = 30000
#: See the threshold above.
QUANTILE, MARGIN = 0.95, 0.15
#: Classes of characters, slots of byte triples and of words and word pairs (powers of two), and numbers beside them.
CLASSES, SLOTS, NUMBERS = 6, 10, 5
DIMENSIONS = CLASSES**4 + 2 * 2**SLOTS + NUMBERS
#: Words remembered by a worker; beyond this the memory starts anew.
REMEMBERED = 300_000
MIX = np.uint32(2654435761)


def _classes() -> np.ndarray:
    """By byte: capital, small letter (or part of a letter beyond ASCII), digit, space, newline, other."""
    kind = np.full(256, 5, np.uint8)
    for i in range(256):
        c = chr(i)
        kind[i] = 1 if i >= 128 or c.islower() else 0 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5
    return kind


KIND = _classes()


class Words(dict):
    """CRC-32 of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


def features(text: str | None, known: Words | None = None) -> np.ndarray:
    """Shrunken shares of the n-grams of a whole text."""
    known = Words() if known is None else known
    x, text = np.zeros(DIMENSIONS, np.float32), text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    first, second, third = CLASSES**4, CLASSES**4 + 2**SLOTS, CLASSES**4 + 2 * 2**SLOTS
    if len(raw) >= 4:
        k = KIND[raw].astype(np.int32)
        runs = ((k[:-3] * CLASSES + k[1:-2]) * CLASSES + k[2:-1]) * CLASSES + k[3:]
        x[:first] = np.sqrt(np.bincount(runs, minlength=first) / (len(runs) + 64))
        b = raw.astype(np.uint32)
        triples = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * MIX >> np.uint32(32 - SLOTS)
        x[first:second] = np.sqrt(np.bincount(triples, minlength=2**SLOTS) / (len(triples) + 64))
    words = text.lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
    pairs, n = (h[:-1] * np.uint32(0x9E3779B1)) ^ h[1:], len(h)
    x[second:third] = np.sqrt(np.bincount(np.concatenate([h, pairs]) * MIX >> np.uint32(32 - SLOTS), minlength=2**SLOTS) / (2 * n + 20))
    again = int((h[1:] == h[:-1]).sum())
    x[third:] = (len(np.unique(h)) + 10) / (n + 10), (len(np.unique(pairs)) + 10) / (max(0, n - 1) + 10), again / (n + 10), np.log1p(again) / 5, np.log1p(n) / 10
    return x


@dataclass(frozen=True)
class BradleyTerry:
    weights: tuple[float, ...]
    threshold: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of standing above the threshold."""
        known, w = Words(), np.array(self.weights, np.float32)
        raw = [features(t, known) @ w for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(raw, float) - self.threshold, -40, 40)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, bad_share: float, pairs: int = PAIRS, rounds: int = 300, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> BradleyTerry:
    """Logistic loss on the score differences of drawn pairs, by Adam; threshold by score quantile."""
    if not len(good) or not len(bad):
        return BradleyTerry((0.0,) * DIMENSIONS, 0.0)
    rng = np.random.default_rng(seed)
    x = np.concatenate([good, bad]).astype(np.float32)
    i, j = rng.integers(len(good), size=pairs), len(good) + rng.integers(len(bad), size=pairs)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        s = x @ w
        p = 1 / (1 + np.exp(np.clip(s[i] - s[j], -40, 40)))  # of the wrong order
        pull = (np.bincount(j, p, len(x)) - np.bincount(i, p, len(x))).astype(np.float32) / pairs
        g = x.T @ pull + l2 * w
        m += 0.1 * (g - m)
        v += 0.001 * (g**2 - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = (x @ w).astype(float)
    weight = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(s, kind="stable")
    below = np.cumsum(weight[order])
    k = min(int(np.searchsorted(below, QUANTILE * bad_share - 1e-9)), len(s) - 1)
    between = float(np.median(s[: len(good)]) - np.median(s[len(good) :]))
    return BradleyTerry(tuple(map(float, w)), float(s[order][k]) + MARGIN * max(0.0, between))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most `per_class` labelled rows of each class, chosen by a hash of doc_id, and the class counts.

    The chosen ids are bounded by the parameter, so they are broadcast to the scan of documents. Of rows that share a chosen id the
    one whose text has the least hash counts, so the rows are bounded as the ids are.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    by = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = usable.where("y = 1").orderBy(by, "doc_id").limit(per_class).unionByName(usable.where("y = 0").orderBy(by, "doc_id").limit(per_class))
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y")
    return held.agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("t")).select("t.text", "y"), counts


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = SAMPLE) -> BradleyTerry:
    """Learns from labels(doc_id, quality) on rows where `learn` (a predicate on doc_id) holds."""
    rows, counts = labelled_sample(docs, labels, "quality", F.lit(True) if learn is None else learn, per_class)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            x = [features(t, known).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "x": pa.array(x, pa.binary())})

    got = rows.mapInArrow(described, "y int, x binary").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))
    x = {k: np.frombuffer(b"".join(r["x"] for r in got if r["y"] == k), np.float16).reshape(-1, DIMENSIONS) for k in (0, 1)}
    del got
    return fit_pairs(x[1], x[0], counts.get(0, 0) / max(1, sum(counts.values())))


def score_column(model: BradleyTerry, text: Column) -> Column:
    """The model's score as a column, for filters that keep every other column of their input."""
    @F.pandas_udf("double")
    def scored(s: pd.Series) -> pd.Series:
        return pd.Series(model.scores(s.tolist()))

    return scored(text)


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, score and predicted for every row of docs."""
    out = docs.select("doc_id", score_column(model, F.coalesce(F.col("text"), F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns."""
    return docs.where(score_column(model, F.coalesce(F.col("text"), F.lit(""))) >= 0.5)
