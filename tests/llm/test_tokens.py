import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import arrow_tokens
from tessera.llm.queries import QUERIES


@pytest.fixture(scope="module")
def path():
    return arrow_tokens.default_tokenizer()


def expected(rows, path):
    t, out, at = Tokenizer.from_file(path), [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query(spark, sf_dir, path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op9_arrow_tokens"](spark, sf_dir).collect())) == expected(rows, path)


def test_words_encode_as_the_whole(path):
    odd = ["Hello, HELLO!? don't I'LL '", "İstanbul, É! e\u0301, x=\u0338 =, <\u0338.", "a•b • c !•! ™©", "x<|endoftext|>y <|startoftext|>", "J\u030c Σς ΑΣ", "a\tb c\x1c d\x85e  f\r\n", "", None, "  ", "x\u0301.'", "½ ²a a² ①.", "ǅ ŉ ß ﬁ K Å"]
    e, t = arrow_tokens.Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):  # unknown, then remembered
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(odd)] == [t.encode(x or "", add_special_tokens=False).ids for x in odd]


def test_random_texts_encode_as_the_whole(path):
    """20,000 texts of Latin, Greek, Cyrillic and wide letters, marks, digits, punctuation and white space of all kinds."""
    rng = np.random.default_rng(17)
    pool = list("aAbBzZeEiIoO019 .,!?'\"-_()•\n\t ") + ["İ", "ı", "ß", "ẞ", "é", "É", "Σ", "ς", "ǅ", "Ω", "Ж", "ﬁ", "²", "①", "中", "\U0001f600", "\u0301", "\u0307", "\u0338", "\u0345", "\u200d", "\u00a0", "\u2028", "\x1c", "\x85", "<|endoftext|>", "n't", "'s"]
    texts = ["".join(rng.choice(pool, rng.integers(1, 14))) for _ in range(20_000)] + ["ALİ.", "ALİ, VELİ!", "TEKİ'", "İ.", ".İ", "Iİ?!x"]
    e, t = arrow_tokens.Encoder(path), Tokenizer.from_file(path)
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [x for x, a, b in zip(texts, got, want) if a != b] == []


def test_odd_rows(docs, empty, path, spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a"), (4, "word " * 9000), (7, "\u00e9\u4e2d\U0001f600 x"), (None, "no id")]
    folder, files = arrow_tokens.write(docs(rows), path, str(tmp_path / "out"), sequence=128)
    got = sorted((tuple(r) for r in arrow_tokens.read(spark, folder, files).collect()), key=lambda r: r[1])
    assert got == expected(rows, path)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]
    folder, files = arrow_tokens.write(empty, path, str(tmp_path / "none"))
    assert files == [] and arrow_tokens.read(spark, folder, files).count() == 0


def test_views_and_masks(tmp_path):
    w = arrow_tokens.SequenceWriter(str(tmp_path / "a.arrow"), 16, 4, wide=False)
    docs = [np.arange(n, dtype="<u4") for n in (1, 70, 5, 200, 3)]
    starts = []
    for d in docs:
        starts.append(w.ids)
        w.add(d.tobytes())
    w.close()
    with pa.memory_map(str(tmp_path / "a.arrow")) as f:
        r = arrow_tokens.SequenceReader(f)
        assert all((r.ids(s, len(d)) == d).all() for s, d in zip(starts, docs))
        assert not r.batch(0).flags.owndata and r.file.schema.field("ids").type.list_size == 16
        views = [r.mask(k) for k in range(r.file.num_record_batches)]
        assert all(pa.types.is_boolean(v.type) for v in views)
        assert r.mask(0).buffers()[1].address == r.mask(0).buffers()[1].address  # the mapped file itself
        masks = np.concatenate([v.to_numpy(zero_copy_only=False) for v in views])
        assert masks.sum() == w.ids and masks[: w.ids].all() and len(masks) % 16 == 0
        with pytest.raises(ValueError):
            r.ids(len(masks), 1)


def test_rows_of_one_id_have_one_order(spark, docs, path, tmp_path):
    """One id for all rows: starts are the same whatever the order of the rows, and the rows may lie in several files."""
    rows = [(7, f"text {k % 40} of {k % 40}") for k in range(120)]
    seen = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for n, order in enumerate((rows, rows[::-1])):
        folder, files = arrow_tokens.write(docs(order).repartition(2 + n), path, str(tmp_path / f"o{n}"), sequence=64)
        seen.append(sorted(tuple(r)[1:] for r in arrow_tokens.read(spark, folder, files).collect()))
        assert len(files) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1] and len(seen[0]) == 120
