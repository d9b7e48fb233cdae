import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import alike, simhash
from tessera.llm.queries import QUERIES


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints, linked=None):
    """Smallest member reached; linked tells of two keys."""
    linked = linked or (lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    ids, root = list(prints), {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def test_query_by_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    comp = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash"](spark, sf_dir).collect()}
    assert got == {d: (f"{prints[d]:016x}", comp[d]) for d in texts}


def test_spark_hash_is_the_same(spark):
    v = spark.range(1).select(F.xxhash64(F.lit("a b ç")).alias("h")).first()["h"]
    assert v % 2**64 == xxhash.xxh64("a b ç".encode(), seed=42).intdigest()


@pytest.mark.parametrize("bucket", [1024, 3])
def test_crowded_shards_lose_no_link(spark, monkeypatch, bucket):
    """Clusters around a few centres, with shards split at every level or at none."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(2)
    prints = []
    for _ in range(6):
        c = int(rng.integers(0, 2**63))
        for _ in range(30):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            prints.append(x)
    prints = sorted(set(prints))
    want = plain_components(dict(enumerate(prints)))
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint")
    roots = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    got = [roots.get(p, p) for p in prints]
    for i in range(len(prints)):
        for j in range(i):
            assert (got[i] == got[j]) == (want[i] == want[j])


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    tree, all_ = simhash.BKTree(), [int(x) for x in rng.integers(0, 2**12, 300)]
    for x in set(all_):
        tree.add(x)
    for q in all_[:40]:
        assert sorted(tree.within(q, 2)) == sorted(x for x in set(all_) if (x ^ q).bit_count() <= 2)


def test_odd_rows(odd, empty):
    rows = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.classes(odd).collect()}
    blank = {r for r in rows if r[1] == 0}
    assert blank == {(1, 0, 1), (2, 0, 1), (8, 0, 1), (None, 0, 1)}
    assert {r[2] for r in rows if r[0] in (3, 5)} == {3}
    kept = simhash.keep_one(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "7", "None", "None"] and kept.columns == odd.columns
    assert simhash.classes(empty).count() == 0


def test_repeated_rows_stay_once(docs):
    assert simhash.keep_one(docs([(5, "some text"), (5, "some text"), (6, "some text")])).count() == 1


def test_edited_copies_are_found(docs):
    rng = np.random.default_rng(8)
    vocab = [f"w{k}" for k in range(5000)]
    rows, bases = [], {}
    for g in range(12):
        base = list(rng.choice(vocab, int(rng.integers(60, 400))))
        for _ in range(4):
            w = list(base)
            for at in rng.integers(0, len(w), max(1, len(w) // 120)):
                w[at] = str(rng.choice(vocab))
            bases[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + k, " ".join(rng.choice(vocab, 200)) + " " + "a passage that all of these texts share word for word " * 3) for k in range(30)]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    want = plain_components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(docs(rows), similarity=0.8).collect()}
    assert got == want and len({want[d] for d in bases}) < 24


def test_odd_rows_with_similarity(odd, empty):
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(odd, similarity=0.8).collect()) == ["1", "3", "4", "7", "None", "None"]
    assert simhash.keep_one(empty, similarity=0.8).count() == 0


def edited(base, rng, edits, k):
    w = list(base)
    for at in rng.permutation(len(w))[:edits]:
        w[at] = f"x{k}-{at}"
    return " ".join(w)


def five(rows):
    return {d: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in rows}


def test_chains_within_a_key_are_joined(docs):
    """Texts of one key that only link through others, neither first nor last."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 9000, 300)]
    rows = [(k, edited(base, rng, int(rng.integers(0, 14)), k)) for k in range(40)]
    sets = five(rows)
    want = plain_components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(docs(rows), similarity=0.8).collect()}
    assert got == want and 1 < len(set(want.values())) < 40


def test_a_large_group_of_near_copies(docs):
    """One original and 700 copies of it, from alike to far from all others, beside texts that share a long passage."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(160)]
    rows = [(5000 - k, edited(base, rng, int(rng.integers(0, 14)), k)) for k in range(700)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(9000 + k, passage + " " + " ".join(f"q{k}-{x}" for x in range(90))) for k in range(300)]
    sets, prints = five(rows), {d: plain_fingerprint(t) for d, t in rows}
    want = plain_components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(docs(rows), similarity=0.8).collect()}
    assert got == want and len(set(want.values())) > 400


@pytest.mark.parametrize("low, high, least", [(0.8, 0.82, 0.999), (0.82, 0.9, 0.9999), (0.9, 1, 1)])
def test_recall_of_keys_by_similarity(low, high, least):
    """Pairs of shingle sets of 3 to 3000, unequal in size too: how many of a band of similarity share a key."""
    rng = np.random.default_rng(int(low * 100))
    none, met, all_ = np.zeros(0, np.uint64), 0, 0
    while all_ < 6000:
        union = int(np.exp(rng.uniform(np.log(3), np.log(3000))))
        both = int(np.ceil(rng.uniform(low, high) * union))
        h = rng.integers(0, 2**63, union, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        left = rng.integers(0, union - both + 1)
        a, b = np.sort(h[: both + left]), np.sort(np.r_[h[:both], h[both + left :]])
        keys = [np.concatenate([alike.prefix(x, 0.8, none) if len(x) <= int((alike.SHORT - 1) / 0.8) else none, alike.group_prints(x) if len(x) >= alike.SHORT else none]) for x in (a, b)]
        all_ += 1
        met += len(np.intersect1d(*keys)) > 0
    assert met >= least * all_


def test_counts_of_common_members(monkeypatch):
    monkeypatch.setattr(alike, "COLUMNS", 16)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 70)).astype(np.uint64)) for _ in range(12)]
    both = alike.counts(sets)
    for i in range(12):
        for j in range(12):
            if i != j:
                assert both[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_sketches_rule_out_no_pair():
    rng = np.random.default_rng(2)
    for _ in range(200):
        h = rng.integers(0, 2**62, 300).astype(np.uint64)
        a, b = h[: int(rng.integers(150, 300))], h[int(rng.integers(0, 150)) :]
        x, y = (np.frombuffer(alike.sketch(s), np.uint8).astype(int) for s in (a, b))
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("block", [256, 7])
def test_members_of_large_keys_are_all_compared(docs, monkeypatch, block):
    """Copies of one original, each edited in a way of its own and alike to few others only, under one key; in one block and in several."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        w = list(base)
        for at in rng.permutation(400)[:60]:
            w[at] = f"x{k}-{at}"
        rows.append((1000 - 3 * k, " ".join(w)))
        for c in range(int(rng.integers(0, 3))):
            rows.append((1000 - 3 * k + c + 1, " ".join([*w[:-2], f"y{c}", f"z{c}"])))
    monkeypatch.setattr(alike, "BLOCK", block)
    monkeypatch.setattr(alike, "group_prints", lambda hashes: np.array([7], np.uint64))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    want = plain_components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(docs(rows), similarity=0.8).collect()}
    assert got == want and len(set(want.values())) == 60


def test_short_copies_with_words_added_are_found(docs):
    """Texts of 12 to 150 words and copies with words added at the end, which share a common opening of five words or more."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(150):
        n = int(rng.integers(12, 16)) if k < 90 else int(rng.integers(16, 150))
        w = ["all", "of", "these", "texts", "begin", "so"][: 6 * (k % 2)] + [f"w{x}" for x in rng.integers(0, 9000, n)]
        rows.append((2 * k, " ".join(w)))
        more = (len(w) - 4) // 4 if k % 5 else (len(w) - 4) // 4 + 1
        rows.append((2 * k + 1, " ".join(w + [f"e{k}-{x}" for x in range(more)])))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    want = plain_components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(docs(rows), similarity=0.8).collect()}
    assert len(set(want.values())) == 180
    assert got == want


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(12)
    for _ in range(300):
        n = int(rng.integers(1, 150))
        more = int(rng.integers(0, n // 4 + 1))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a, rng.integers(0, 2**63, min(more, len(a) // 4)).astype(np.uint64)])
        common = rng.permutation(b)[: int(rng.integers(0, len(b) + 1))]
        assert len(np.intersect1d(alike.prefix(a, 0.8, common), alike.prefix(b, 0.8, common)))
