import itertools
import random

from tessera.llm import packing


def padding(h, edges):
    return sum(n * (min(e for e in edges if e >= x) - x) for x, n in h.items())


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for _ in range(30):
        h = {x: rng.randint(1, 9) for x in rng.sample(range(40), 9)}
        got = packing.boundaries(h, 3)
        best = min(padding(h, (*c, max(h))) for c in itertools.combinations(sorted(h)[:-1], 2))
        assert padding(h, got) == best and got == sorted(set(got)) and got[-1] == max(h)


def test_few_lengths():
    assert packing.boundaries({3: 1, 5: 2}, 8) == [3, 5] and packing.boundaries({}, 8) == []


def test_odd_rows(odd, empty):
    rows = packing.packed(odd, 3, 4096, 1000).collect()
    assert sum(r["length"] for r in rows) == 30000 + 1 + 1 + 1 + 3 + 2 + 1 - 1
    assert len([r for r in rows if r["doc_id"] == 4]) == 30
    assert len([r for r in rows if r["doc_id"] == 5]) == 2 and len([r for r in rows if r["doc_id"] is None]) == 2
    per = {}
    for r in rows:
        assert r["length"] <= r["boundary"]
        per.setdefault((r["bucket"], r["batch"]), []).append(r)
    for group in per.values():
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
        assert len(group) * group[0]["boundary"] <= 4096 or len(group) == 1
    assert packing.packed(empty).count() == 0
