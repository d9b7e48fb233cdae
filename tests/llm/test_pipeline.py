"""The pipeline against plain Python over the same rows."""

import re

import corpus_pipeline
from test_simhash import plain_components, plain_fingerprint

from tessera.llm import lines, packing


def shingles(text):
    w = [x for x in re.split(r"[^\w]|_", text.lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_stages_and_run(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "simhash", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outs, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf_dir).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        outs.append(now)
    assert all(o.dtypes == docs.dtypes for o in outs[:-1])
    cols = lambda o: {r["doc_id"]: (r["text"], r["source"]) for r in o.select("doc_id", "text", "source").collect()}
    all_, good, clean, single, safe = [cols(x) for x in (docs, *outs[:4])]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum((d in good) == (labels[d] == 1) for d in labels if d in all_) >= 0.95 * len(labels)
    # lines
    sites, first = {}, {}
    for d, (t, s) in sorted(good.items()):
        for k, x in enumerate(t.split("\n")):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(s)
                first.setdefault(x.strip(" "), (d, k))
    bad = {x for x, s in sites.items() if len(s) >= lines.MIN_SITES}
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if x.strip(" ") not in bad or first[x.strip(" ")] == (d, k)) for d, (t, _) in good.items()}
    want = {d: t for d, t in want.items() if t.replace("\n", " ").strip(" ") or t == good[d][0]}
    assert {d: t for d, (t, _) in clean.items()} == want
    # near-duplicates
    prints = {d: plain_fingerprint(t) for d, t in want.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, t.lower().split()) for d, t in want.items())}
    comp = plain_components(want, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert set(single) == {d for d, c in comp.items() if d == c}
    # benchmark
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {d for d, (t, _) in single.items() if any(len(i & shingles(t)) * 5 >= len(i) * 4 for i in items if i)}
    assert set(safe) == set(single) - held
    # packing
    rows = outs[4].collect()
    words = {d: len([w for w in re.split(r"[ \t\n\r]+", t) if w]) for d, (t, _) in safe.items()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert r["length"] <= r["boundary"] <= packing.MAX_LEN
    assert got == words
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, rows))
