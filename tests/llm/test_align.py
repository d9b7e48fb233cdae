import hashlib
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import align
from tessera.llm.queries import QUERIES
from tessera.session import Shelf


def expected(rows):
    """Whole texts, tokens one by one."""
    a_path, b_path = align.tokenizers()
    ta, tb = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    ta.encode_special_tokens = True
    letters = align.byte_letters()
    out, held = [], []
    for d, text in rows:
        links, groups, a, b = Counter(), [], [], []
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            xa = [bytes(letters[c] for c in ta.id_to_token(i)) for i in a]
            xb = [bytes([int(tb.id_to_piece(i)[1:-1], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
                a, b = [], []
            else:
                ea, eb = np.cumsum([len(x) for x in xa]), np.cumsum([len(x) for x in xb])
                la = lb = 0
                for e in np.intersect1d(ea, eb):
                    na, nb = int(np.searchsorted(ea, e)) + 1, int(np.searchsorted(eb, e)) + 1
                    groups.append((a[la:na], b[lb:nb]))
                    links.update((x, y) for x in a[la:na] for y in b[lb:nb])
                    la, lb = na, nb
        held.append(links)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([d, len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest() if said else ""])
    n = Counter(p for x in held for p in x)
    best = {}
    for (x, _), c in n.items():
        best[x] = max(best.get(x, 0), c)
    for r, links in zip(out, held):
        r[5:5] = [sum(t for p, t in links.items() if n[p] == best[p[0]]), sum(t * n[p] for p, t in links.items())]
    return sorted(map(tuple, out), key=repr)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    from pyspark.sql import functions as F

    a, b = align.tokenizers()
    rows = align.aligned(df, a, b).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    with Shelf(df.sparkSession, "test") as shelf:
        return sorted((tuple(r) for r in align.scored(rows, align.vocabulary(b), shelf).select(NAMES).collect()), key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op13_alignment"](spark, sf_dir)
    assert out.columns == NAMES
    found = sorted((tuple(r) for r in out.collect()), key=repr)
    assert found == expected(rows) and all(r[5] <= r[4] for r in found)


@pytest.mark.parametrize("broadcast", [True, False])
def test_odd_texts(docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(align, "PAIRS", 0)
    rng = np.random.default_rng(7)
    pool = list("aAbBzZeE019 .,!?'\"-_()  \n\n\t\r") + ["\x0b", "\x1c", "\x85", "\xa0", " ", "　", "é", "é", "中", "文", "\U0001f600", "ﬁ", "‍", "the ", " of", "n't", "'s", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", " ", "\x00"]
    rows = [(k, "".join(rng.choice(pool, int(rng.integers(1, 30))))) for k in range(400)]
    rows += [(500, "a▁b"), (501, "▁"), (502, " "), (503, "\n"), (504, "x  "), (505, "  \n x \n\n "), (506, None), (507, ""), (508, "the the the"), (508, "the the the"), (None, "the end"), (None, None), (509, "word " * 3000), (510, "x" * 20000)]
    assert got(docs(rows)) == expected(rows)


def test_odd_rows(odd, empty):
    assert len(got(odd)) == 10 and got(empty) == []


def test_memory_starts_anew(docs, monkeypatch):
    monkeypatch.setattr(align, "PIECES", 3)
    monkeypatch.setattr(align, "BATCH", 40)
    monkeypatch.setattr(align, "PARTIAL", 5)
    rows = [(k, f"word{k % 7} and then word{k % 3} the end {k}") for k in range(60)]
    assert got(docs(rows)) == expected(rows)


def test_pieces_by_splitting():
    """Texts that are cut by a plain split give the pieces of the pattern."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab \n\t\xa0　\x1c"), int(rng.integers(1, 9))))
        assert align.cut_up(text) == align.PIECE.findall(" " + text) and "".join(align.cut_up(text)) == " " + text
    assert align.cut_up(None) == align.cut_up("") == []


def test_memory_of_a_long_batch(monkeypatch):
    """A task's Python objects and arrays do not grow with the Arrow batch that it is given."""

    class Docs:
        dtypes = [("doc_id", "bigint")]
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: f

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    run, words = align.aligned(Docs(), *align.tokenizers()), [f"word{k}" for k in range(200)]
    texts = [" ".join(words[k % 50 :]) for k in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    assert sum(map(len, texts)) > 3_500_000
    list(run(iter([batch.slice(0, 50)])))
    tracemalloc.start()
    rows = sum(sum(x.column("row").is_valid().to_pylist()) for x in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 25_000_000, peak
