import hashlib

import numpy as np
import pytest

from tessera.llm import repeats
from tessera.llm.queries import QUERIES
from tessera.session import Shelf


def expected(rows, window=50):
    """Every window of every document, against the smallest doc_id that has it."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                first[x] = min(first.get(x, d), d)
    out = []
    for d, w in split:
        off = np.zeros(len(w), bool)
        if d is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < d:
                    off[k : k + window] = True
        out.append((d, len(w), int(off.sum()), hashlib.sha256(b" ".join(x for x, o in zip(w, off) if not o)).hexdigest()))
    return sorted(out, key=repr)


def got(df, window=50):
    with Shelf(df.sparkSession, "test") as shelf:
        rows = repeats.cleaned(df, shelf, window).collect()
    for r in rows:
        assert r["n_removed"] == sum(x["length"] for x in r["removed"])
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows), key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op12_substring_dedup"](spark, sf_dir)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    found = sorted((tuple(r) for r in out.collect()), key=repr)
    assert found == expected(rows) and any(r[2] for r in found)


def made(seed, window, docs=120):
    """Texts over few words, with passages at all offsets, copies with edits, repeats inside a text and texts that repeat one word."""
    rng = np.random.default_rng(seed)
    word = lambda n, most: [f"w{x}" for x in rng.integers(0, most, n)]
    passages = [word(int(rng.integers(window - 2, 3 * window)), 40) for _ in range(4)]
    rows, texts = [], []
    for k in range(docs):
        kind = k % 6
        if kind == 0 or not texts:
            t = word(int(rng.integers(0, 6 * window)), 400)
        elif kind == 1:
            t = word(int(rng.integers(0, window)), 400) + passages[int(rng.integers(4))] + word(int(rng.integers(0, window)), 400) + passages[int(rng.integers(4))]
        elif kind == 2:
            t = list(texts[int(rng.integers(len(texts)))])
            for _ in range(int(rng.integers(0, 3))):
                if t:
                    t[int(rng.integers(len(t)))] = "edit"
        elif kind == 3:
            t = ["x"] * int(rng.integers(0, 3 * window)) + word(int(rng.integers(0, 9)), 9)
        elif kind == 4:
            t = word(2, 9) * int(rng.integers(1, 2 * window))
        else:
            p = passages[0]
            t = p + p[: int(rng.integers(len(p)))] + p
        texts.append(t)
        rows.append((int(rng.integers(0, 80)), " \n".join(t)))
    return rows


@pytest.mark.parametrize("seed, window, unit", [(1, 50, 2_000_000), (2, 50, 700), (3, 8, 300), (4, 9, 2_000_000)])
def test_against_every_window(docs, monkeypatch, seed, window, unit):
    monkeypatch.setattr(repeats, "UNIT", unit)
    rows = made(seed, window)
    assert got(docs(rows), window) == expected(rows, window)


def test_hot_group(docs):
    """A third of all rows are copies of one text, another third hold one passage at offsets of their own."""
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    copy, passage = word(140), word(70)
    rows = [(k, copy) for k in range(300)] + [(300 + k, f"{word(k % 60)} {passage} {word(k % 31)}") for k in range(300)] + [(600 + k, word(90)) for k in range(300)]
    assert got(docs(rows)) == expected(rows)


def test_odd_rows(docs, odd, empty):
    long = "word " * 30000
    assert {(r[0], r[1], r[2]) for r in got(odd)} == {(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 30000, 0), (5, 1, 0), (None, 3, 0), (None, 0, 0), (7, 2, 0), (8, 0, 0)}
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(9, long), (9, long), (3, long + passage), (None, passage), (2, passage + " x " + passage), (2, passage), (5, passage), (6, passage[:-4]), (7, "p0 " + passage)]
    assert got(docs(rows)) == expected(rows)
    assert got(empty) == []


def test_text_ids(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    df = spark.createDataFrame([("b", passage), ("a", "x " + passage), (None, passage)], "doc_id string, text string")
    assert [(r[0], r[2]) for r in got(df)] == [("a", 0), ("b", 60), (None, 0)]


def test_packing_of_numbers():
    rng = np.random.default_rng(1)
    for top in (1, 200, 60_000, 1 << 23, 1 << 31):
        x = rng.integers(0, top, 50)
        assert (repeats.wide(repeats.narrow(x)) == x).all()
    assert len(repeats.wide(repeats.narrow(np.zeros(0, np.int64)))) == 0
