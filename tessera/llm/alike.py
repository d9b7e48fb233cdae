"""Links between texts at a Jaccard similarity of their word shingles, for the near-duplicate stage.

Candidates. A text of up to `SHORT` * 1.25 shingles has the keys of its prefix: the first n - ceil(0.8 n) + 1 of its n
shingles in an order that all texts share, rare ones first. Two texts at 0.8 share one, so no pair is lost. A text of
`SHORT` shingles or more has the SimHashes of `GROUPS` groups of its shingles (see group_prints()): of two such texts at
0.8 a group is the same with a chance of 0.28 at least, so that all are different in fewer than one of 30,000 pairs, and
rarer above 0.8.

Comparison. All texts that share a key are compared, in keys of any size, unless they are in one component already.
Members of a key fall into blocks; a task holds two blocks, as sketches first, which rule out nothing that is at the
similarity, then as whole shingle sets. Of what it finds a task gives the links of a spanning forest, so the links are
fewer than the members that it read. In a first pass each text stands under one of its keys alone, which joins most
groups; the second pass has all keys that still hold more than one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried, cut
from tessera.operators.graph import components
from tessera.session import Shelf, dealt_by, looked_up, small

carried(__name__)

#: Groups of shingles of a level that give a key, and the least mean size of a group.
GROUPS, THIN = 32, 2.5
#: Shingles from which on texts have keys by groups; up to 1.25 times as many, they have keys by prefix.
SHORT = 120
#: A shingle of so many short texts counts as common, and the most common ones that are told to the tasks.
COMMON, TOLD = 8, 100_000
#: Members, and shingles of all members, that a block of a key has on average at most; counters of a sketch.
BLOCK, WEIGHT, SLOTS = 256, 1 << 18, 256
#: Words whose hashes a task remembers, rows whose shingles it holds at once, and columns of a part of the incidence matrix.
WORDS, ROWS, COLUMNS = 1 << 17, 1024, 8192


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def shingle_hashes(text: str | None, width: int = 5, known: Words | None = None) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of `width` words; a shorter text is one run, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = Words() if known is None else known
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def group_prints(hashes: np.ndarray) -> np.ndarray:
    """SimHashes of groups of a text's shingles, as keys.

    Shingles fall into 2^l groups by the low bits of their hashes, l so that a group has `THIN` to 2 `THIN` of them on
    average; the first `GROUPS` groups give a key each. A text so short that one at similarity 0.8 may be on the level
    below has the keys of that level too.
    """
    out = []
    if len(hashes):
        own = max(0, int(np.floor(np.log2(max(1.0, len(hashes) / THIN)))))
        for level in {own, max(0, own - 1)} if len(hashes) < 1.25 * THIN * 2**own else {own}:
            group = hashes & np.uint64((1 << level) - 1)
            h, group = hashes[group < GROUPS], group[group < GROUPS]
            if not len(h):
                continue
            order = np.argsort(group, kind="stable")
            h, group = h[order], group[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            sizes = np.diff(np.r_[starts, len(h)])
            fp = np.packbits(sums * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
            out.append((fp ^ (group[starts] * np.uint64(64) + np.uint64(level))) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def prefix(hashes: np.ndarray, least: float, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(least * n) + 1 of a text's n shingles in an order that all texts share: two sets at Jaccard
    similarity `least` share `least` of the larger's size at least, so their prefixes meet. `common` has the common
    shingles, the most common first; they come last, others by their hash. The order decides the work alone."""
    if not len(hashes):
        return hashes
    n = len(hashes)
    late = np.zeros(n, np.int64)
    if len(common):
        by = np.argsort(common)
        at = np.minimum(np.searchsorted(common, hashes, sorter=by), len(common) - 1)
        late = np.where(common[by[at]] == hashes, len(common) - by[at], 0)
    return hashes[np.lexsort((hashes, late))[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each of `SLOTS` slots, 255 at most. Two sketches differ by no more than their sets do."""
    return np.minimum(np.bincount((hashes >> np.uint64(32)).astype(np.int64) % SLOTS, minlength=SLOTS), 255).astype(np.uint8).tobytes()


def counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets have in common, from products of their incidence matrix, a part of its columns at a time."""
    k = len(sets)
    if k == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], float)
    who = np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1  # others are in no intersection
    column, who = (np.cumsum(shared) - 1)[column[shared[column]]], who[shared[column]]
    out = np.zeros((k, k))
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[order]
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        m = np.zeros((k, COLUMNS), np.float32)
        m[who[a:b], column[a:b] - start] = 1
        out += m @ m.T
    return out


def forest(sets: list[np.ndarray], root: np.ndarray, own: np.ndarray, i: int, j: int, least: float) -> list[tuple[int, int]]:
    """Pairs of rows that link what was apart, of the rows of block i with those of block j."""
    n = np.array([len(s) for s in sets], float)
    both = counts(sets)
    near = (both >= least * (n[:, None] + n[None, :] - both) - 1e-9) & (root[:, None] != root[None, :])
    near &= (own[:, None] == i) & (own[None, :] == j)
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    out = []
    for a, b in zip(*np.nonzero(near)):
        if (x := top(int(root[a]))) != (y := top(int(root[b]))):
            parent[x] = y
            out.append((int(a), int(b)))
    return out


def by_cell(work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs work on tables of whole cells (equal key, i and j) and the rows at which the cells start."""

    def starts(t: pa.Table) -> np.ndarray:
        cols = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                new = pa.Table.from_batches([b])
                held = new if held is None else pa.concat_tables([held, new])
                at = starts(held)
                if len(at) > 1:
                    yield work(held.slice(0, at[-1]), at[:-1])
                    held = held.slice(at[-1])
        if held is not None and held.num_rows:
            yield work(held, starts(held))

    return run


def celled(rows: DataFrame, payload: DataFrame, shelf: Shelf) -> DataFrame:
    """rows(key, doc_id, n, root) with payload(doc_id, x), dealt in cells (key, i, j) of two blocks of a key.

    Keys whose members are all in one component are left out, and of keys with the same members all but one.
    """
    rows = shelf.put(rows)
    mark = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight"), F.min("root").alias("r1"), F.max("root").alias("r2"), *mark).where("r1 <> r2")
    one = keys.groupBy("m", "weight", "mark1", "mark2").agg(F.min("key").alias("key"))
    one = shelf.put(one.select("key", "m", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("weight") / WEIGHT)).cast("int").alias("blocks")))
    at = looked_up(rows, one, "key", "m", rows.count()).join(payload, "doc_id")
    at = at.withColumn("own", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"))
    cells = at.select("key", "doc_id", "root", "n", "x", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("far"))
    cells = cells.select("key", F.least("own", "far").alias("i"), F.greatest("own", "far").alias("j"), "doc_id", "root", "n", "own", "x")
    return dealt_by(cells, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def sifted(cells: DataFrame, least: float) -> DataFrame:
    """key and doc_id of the members that have one of another component in their cell that their sketches do not rule out:
    sets at the similarity differ by (1 - least) / (1 + least) of their summed sizes at most, and the shorter has `least` of the longer's size."""
    kind = dict(cells.dtypes)["doc_id"]

    def work(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        n, own, i, j = (t.column(c).to_numpy() for c in ("n", "own", "i", "j"))
        root = t.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        h = np.frombuffer(b"".join(t.column("x").to_pylist()), np.uint8).reshape(-1, SLOTS).astype(np.int16)

        def near(a, b) -> np.ndarray:
            ok = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9)
            ok[ok] = np.abs(h[b[ok]] - h[a[ok] if np.ndim(a) else a]).sum(-1) <= (1 - least) / (1 + least) * (n[a[ok] if np.ndim(a) else a] + n[b[ok]]) + 1e-9
            return ok

        keep = np.zeros(len(n), bool)
        ends = np.r_[starts[1:], len(n)]
        two = starts[ends - starts == 2]
        for k in range(0, len(two), 4096):
            a = two[k : k + 4096]
            keep[a] = keep[a + 1] = near(a, a + 1)
        for s, e in zip(starts, ends):
            if e - s > 2:
                rows = np.arange(s, e)
                far = rows[own[s:e] == j[s]]
                for a in rows[own[s:e] == i[s]]:
                    ok = near(a, far)
                    if ok.any():
                        keep[a] = True
                        keep[far[ok]] = True
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.select(["key", "doc_id"]).filter(pa.array(keep)).columns], names=["key", "doc_id"])

    return cells.mapInArrow(by_cell(work), f"key bigint, doc_id {kind}").distinct()


def linked(cells: DataFrame, least: float) -> DataFrame:
    """(u, v), u > v, distinct: links of spanning forests of the cells, by whole sets."""
    kind = dict(cells.dtypes)["doc_id"]

    def work(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
        root = t.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        sets = t.column("x")
        found: list[tuple[int, int]] = []
        for s, e in zip(starts, np.r_[starts[1:], len(own)]):
            held = [np.frombuffer(sets[int(r)].as_buffer(), np.uint64) for r in range(s, e)]
            if len(held) > 1:
                found += [(int(s) + a, int(s) + b) for a, b in forest(held, root[s:e], own[s:e], i[s], j[s], least)]
        at = np.array(found, np.int64).reshape(-1, 2)
        ids = t.column("doc_id").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at[:, k])) for k in (0, 1)], names=["a", "b"])

    return cells.mapInArrow(by_cell(work), f"a {kind}, b {kind}").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def similar(docs: DataFrame, known: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """(node, root) of the components of known(u, v), where v is the root of u, and of the links between different texts
    at Jaccard similarity `least` of their shingles. Rows whose doc_id is null are left out; equal texts count once, by
    their smallest doc_id; texts without words have no link."""
    kind = dict(docs.dtypes)["doc_id"]
    named = docs.where("doc_id is not null").select("doc_id", "text")
    most = int((SHORT - 1) / least + 1e-9)  # shingles of a text that one below SHORT can be alike to

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches):
            got = [g for t in b.column("text") if len(g := shingle_hashes(t.as_py(), width, words)) <= most]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got or [np.zeros(0, np.uint64)]).view(np.int64))], names=["s"])

    told = named.mapInArrow(short, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(TOLD)
    common = np.array([r["s"] for r in told.select("s").collect()], np.int64).view(np.uint64)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches):
            n, keys, h, same = [], [], [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                g = shingle_hashes(text, width, words)
                found = ([prefix(g, least, common)] if len(g) <= most else []) + ([group_prints(g)] if len(g) >= SHORT else [])
                n.append(len(g))
                keys.append(np.unique(np.concatenate(found)).view(np.int64))
                h.append(sketch(g))
                same.append(xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass")))
            offsets = np.cumsum([0, *(len(k) for k in keys)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(same, pa.binary()), pa.array(n, pa.int32()), lists, pa.array(h, pa.binary())], names=["doc_id", "same", "n", "keys", "x"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches):
            sets = [shingle_hashes(t.as_py(), width, words).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "x"])

    with Shelf(docs.sparkSession, "alike") as shelf:
        every = shelf.put(named.mapInArrow(printed, f"doc_id {kind}, same binary, n int, keys array<bigint>, x binary"))
        texts = every.join(every.groupBy("same").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi")
        keyed = shelf.put(texts.select("doc_id", "n", F.explode("keys").alias("key")))
        often = shelf.put(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        shared = shelf.put(looked_up(keyed, often, "key", "m", keyed.count()).select("key", "doc_id", "n"))
        sketches = every.select("doc_id", "x")

        def joined(rows: DataFrame, roots: DataFrame) -> DataFrame:
            """Roots after the comparison of all rows(key, doc_id, n) that share a key."""
            rooted = lambda df: df.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
            met = shelf.put(sifted(celled(rooted(rows), sketches, shelf), least))
            ids = shelf.put(met.select("doc_id").distinct())
            sets = shelf.put(named.join(small(ids), "doc_id", "left_semi").mapInArrow(hashed, f"doc_id {kind}, x binary"))
            sizes = sets.select("doc_id", (F.length("x") / 8).cast("int").alias("n"))
            found = shelf.put(linked(celled(rooted(met.join(sizes, "doc_id")), sets, shelf), least))
            return cut(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found)))

        roots = known.select(F.col("u").alias("node"), F.col("v").alias("root"))
        first = shared.groupBy("doc_id").agg(F.min_by("key", F.xxhash64("key")).alias("key"), F.first("n").alias("n"))
        return joined(shared, joined(first, roots))
