import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import runs
from tessera.llm.queries import QUERIES


def slow_runs(w):
    """Every maximal stretch of every period, with the least period of each stretch."""
    least = {}
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k + q < len(w):
            if w[k] != w[k + q]:
                k += 1
                continue
            e = k
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e - k + q >= max(6, 4 * q):
                least.setdefault((k, e + q), q)
            k = e
    return sorted((a, b - a, q) for (a, b), q in least.items())


def slow_kept(w, found):
    off = {i for a, n, q in found for i in range(a + q, a + n)}
    return [x for i, x in enumerate(w) if i not in off]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, text in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = slow_runs(w)
        a, m, q = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((d, len(found), a, m, q, 1000 * m // q if found else None, sha("".join(f"{x},{y},{z}\n" for x, y, z in found).encode()), sha(b" ".join(slow_kept(w, found)))))
    out = QUERIES["op11_periodic_runs"](spark, sf_dir)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(want) and sum(r[1] > 0 for r in got) > 5


@pytest.mark.parametrize("seed, places", [(1, 1 << 19), (2, 50)])
def test_against_every_stretch(monkeypatch, seed, places):
    """Texts over two to five words, random or of nested periods, laid together."""
    monkeypatch.setattr(runs, "PLACES", places)
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(300):
        t = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 90))).tolist()
        for _ in range(int(rng.integers(0, 3))):
            t += (t[-int(rng.integers(1, 9)) :] or [0]) * int(rng.integers(1, 8))
        texts.append(np.array(t, np.int64))
    got = runs.runs_of(texts, 6)
    assert [list(zip(*(x.tolist() for x in r))) for r in got] == [slow_runs(t.tolist()) for t in texts]


def test_names_are_equal_where_stretches_are():
    rng = np.random.default_rng(3)
    t = rng.integers(0, 2, 200)
    for k, names in enumerate(runs.named(t, 5)):
        stretches = [t[i : i + 2**k].tobytes() for i in range(len(t) - 2**k + 1)]
        assert len(names) == len(stretches)
        assert len(set(zip(names.tolist(), stretches))) == len(set(stretches)) == len(set(names.tolist()))


def test_odd_rows(docs, odd, empty):
    got = {(r["doc_id"], tuple(map(tuple, r["runs"])), r["text"]) for r in runs.detected(odd).collect()}
    assert got == {(1, (), ""), (2, (), ""), (3, (), "a"), (4, ((0, 30000, 1),), "word"), (5, (), "a"), (None, (), "no id here"), (None, (), ""), (7, (), "é中\U0001f600 x"), (8, (), "")}
    assert runs.detected(odd).count() == 10 and runs.detected(empty).count() == 0
    rows = [(1, "a a a a a"), (2, "a a a a a a"), (3, "a b " * 4), (4, "a b a b a b a"), (5, "x " + "a b c " * 4 + "a y y y y y y")]
    got = {r["doc_id"]: (list(map(tuple, r["runs"])), r["text"]) for r in runs.detected(docs(rows)).collect()}
    assert got[1] == ([], "a a a a a") and got[2] == ([(0, 6, 1)], "a") and got[3] == ([(0, 8, 2)], "a b") and got[4][0] == []
    assert got[5] == ([(1, 13, 3), (14, 6, 1)], "x a b c y")


def test_long_text():
    rng = np.random.default_rng(4)
    block = rng.integers(0, 1000, 7000)
    t = np.r_[rng.integers(0, 1000, 500), np.tile(block, 5), rng.integers(0, 1000, 300)]
    got = runs.runs_of([t, np.zeros(40_000, np.int64)], 1000)
    assert (got[1][0].tolist(), got[1][1].tolist(), got[1][2].tolist()) == ([0], [40_000], [1])
    assert any((a <= 500 and n >= 35_000 and q == 7000) for a, n, q in zip(*got[0]))


def test_query_on_texts_without_words(spark, tmp_path):
    """Rows that the contract has repeat their words, and have none."""
    ids = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0][:4]
    texts = ["", " \t\n ", None, "a b c d e f g h i j k l"]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert len(got) == 4
    for d in ids[:3]:
        assert (got[d]["n_runs"], got[d]["start"], got[d]["runs_sha256"], got[d]["collapsed_sha256"]) == (0, None, none, none)
