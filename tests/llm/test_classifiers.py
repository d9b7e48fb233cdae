import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.queries import QUERIES


@pytest.mark.parametrize("name,label,by,rest,least", [("op6_quality", "quality", 3, 1, 0.97), ("op2_toxicity", "toxic", 5, 0, 0.85)])
def test_held_out_accuracy(spark, name, label, by, rest, least):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % by == rest for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_interaction_beyond_the_linear_part():
    """Terms that matter only together are told apart."""
    rng = __import__("random").Random(1)
    rows = []
    for k in range(400):
        a, b = k % 2, k // 2 % 2
        terms = {100 + rng.randrange(50)} | ({1} if a else set()) | ({2} if b else set())
        rows.append((int(a and b), terms))
    m = toxicity.train(rows, 0.25, rounds=400)
    i, j = list(m.terms).index(1), list(m.terms).index(2)
    assert float(m.factors[i] @ m.factors[j]) != 0
    y = lambda s: m.bias + m.linear[s].sum() + 0.5 * ((m.factors[s].sum(0) ** 2).sum() - (m.factors[s] ** 2).sum())
    assert y([i, j]) > 0 > max(y([i]), y([j]))


def test_pairs_that_say_nothing_alone_are_found():
    """Toxic if exactly one of two terms stands there: each alone is as frequent in both classes."""
    rng = __import__("random").Random(2)
    rows = []
    for k in range(800):
        a, b = k % 2, k // 2 % 2
        rows.append((a ^ b, np.array(sorted({rng.randrange(100, 160) for _ in range(6)} | ({1} if a else set()) | ({2} if b else set())), np.uint32)))
    assert not {1, 2} & set(toxicity.select_terms(rows, 512).tolist())
    assert toxicity.select_pairs(rows).tolist() == [1, 2]
    m = toxicity.train([(y, set(t.tolist())) for y, t in rows], 0.5, rounds=600)
    y = lambda s: m.bias + m.linear[s].sum() + 0.5 * ((m.factors[s].sum(0) ** 2).sum() - (m.factors[s] ** 2).sum())
    i, j = list(m.terms).index(1), list(m.terms).index(2)
    assert min(y([i]), y([j])) > 0 > max(y([i, j]), y([]))


def test_scores_by_brute_force():
    """Scores of both models, term by term and n-gram by n-gram."""
    rng = np.random.default_rng(3)
    texts = ["", "One two two, THREE!!!", "a b c d e f g " * 40, "é|x|9\n\n" * 7]
    m = quality.BradleyTerry(tuple(rng.normal(size=quality.DIMENSIONS).tolist()), 0.25)
    for t, got in zip(texts, m.scores(texts)):
        x = [0.0] * quality.DIMENSIONS
        raw, n4, n3 = t.encode(), quality.CLASSES**4, 2**quality.SLOTS
        for k in range(max(0, len(raw) - 3)):
            at = 0
            for c in raw[k : k + 4]:
                at = at * quality.CLASSES + int(quality.KIND[c])
            x[at] += 1 / (len(raw) - 3 + 64)
        for k in range(len(raw) - 2 if len(raw) >= 4 else 0):
            at = ((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435761 % 2**32) >> (32 - quality.SLOTS)
            x[n4 + at] += 1 / (len(raw) - 2 + 64)
        words = t.lower().split()
        h = [zlib.crc32(w.encode()) for w in words]
        two = [(a * 0x9E3779B1 % 2**32) ^ b for a, b in zip(h, h[1:])]
        for g in h + two:
            x[n4 + n3 + ((g * 2654435761 % 2**32) >> (32 - quality.SLOTS))] += 1 / (2 * len(h) + 20)
        again = sum(a == b for a, b in zip(h, h[1:]))
        tail = [(len(set(h)) + 10) / (len(h) + 10), (len(set(two)) + 10) / (max(0, len(h) - 1) + 10), again / (len(h) + 10), np.log1p(again) / 5, np.log1p(len(h)) / 10]
        x = [v**0.5 for v in x[:-5]] + tail
        want = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, m.weights)) - 0.25)))
        assert got == pytest.approx(want, rel=1e-4)
    words = ["one", "two", "three"]
    terms = sorted({h for w in words for h in toxicity.term_hashes(w)})
    f = toxicity.FactorizationMachine(-0.5, np.array(terms), rng.normal(size=len(terms)), rng.normal(size=(len(terms), 3)))
    for t, got in zip(texts, f.scores(texts)):
        held = [k for k, h in enumerate(terms) if h in toxicity.text_terms(t)]
        y = -0.5 + sum(f.linear[k] for k in held) + sum(f.factors[a] @ f.factors[b] for a in held for b in held if a < b)
        assert got == pytest.approx(1 / (1 + np.exp(-y)))


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        m = module.fit(odd, labels)
        rows = module.score(odd, m).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
        assert module.score(empty, m).count() == 0
        none = module.fit(odd, labels.where("doc_id > 99"))
        assert all(abs(r["score"] - 0.5) < 1e-3 for r in module.score(odd, none).collect())
    assert all(r["predicted"] == 0 for r in toxicity.score(odd, toxicity.fit(odd, labels.where("toxic = 0"))).collect())


def test_only_learning_rows_count(docs, spark):
    """Labels outside the learning fold change nothing."""
    d = docs([(k, ("GOOD text here " if k % 2 else "bad!!! ") * 5) for k in range(60)])
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    rows = [(k, k % 2, k % 2) for k in range(60)]
    flipped = [(k, y if zlib.crc32(str(k).encode()) % 3 != 1 else 1 - y, t) for k, y, t in rows]
    kind = "doc_id bigint, quality int, toxic int"
    assert quality.fit(d, spark.createDataFrame(rows, kind), learn) == quality.fit(d, spark.createDataFrame(flipped, kind), learn)


def test_repeated_ids_do_not_swell_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(1, None), (2, "b"), (3, "c"), (3, "c")], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    rows, counts = quality.labelled_sample(docs, labels, "quality", F.lit(True), 10)
    got = sorted((r["y"], r["text"] or "") for r in rows.collect())
    assert [y for y, _ in got] == [0, 0, 1] and counts == {1: 1, 0: 2}
    assert sorted((r["y"], r["text"] or "") for r in quality.labelled_sample(docs.repartition(7), labels, "quality", F.lit(True), 10)[0].collect()) == got
