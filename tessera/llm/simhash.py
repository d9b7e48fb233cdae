"""SimHash near-duplicates: fingerprints, BK-trees in pigeonhole shards, connected components.

A text's A-Z are lower-cased; its words are the runs free of ASCII white space; its shingles are all runs
of `width` words joined by one space (a shorter text is one shingle, an empty one has fingerprint 0). A bit
of the fingerprint is set if it is set in over half of the shingles' XXH64 hashes (seed 42).

Fingerprints within `RADIUS` = 2 bits link. Two such fingerprints agree in at least two of four 16-bit
blocks, so each distinct fingerprint is sent to six shards, one for each pair of blocks, keyed by those 32
bits. A shard's fingerprints form a BK-tree: a child hangs on the edge numbered by its Hamming distance to
the parent, and a search with radius r at distance d follows the edges d-r to d+r alone. A shard above
`BUCKET` fingerprints is split again: the bits not yet fixed fall into three parts, of which one agrees.
After two such splits 14 or 15 bits are free, so no tree can hold more than 2^15 fingerprints. Trees stay in
the tasks that own them; sending them all to every executor would need memory that grows with the corpus.

Each shard gives the links of a spanning forest only, which leaves components as they are. Components
come from alternating large-star and small-star rounds, with lineage cut in the shared folder.

Two bits tell apart what word edits change: most copies with one word in a hundred edited differ by more. `keep_one`
with `similarity` therefore also links texts whose exact Jaccard similarity of five-word shingles is high enough (see alike.py).

Edge cases: a null text counts as empty; all empty texts are one group. A null doc_id takes part, but a
component's id is its smallest doc_id that is not null (null if there is none). Repeated rows share a
fingerprint. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.alike import similar
from tessera.llm.common import carried, cut, saved
from tessera.operators.graph import components
from tessera.session import Shelf, dealt_by, looked_up, small

carried(__name__)

RADIUS = 2
#: Fingerprints of a shard beyond which it is split.
BUCKET = 1024


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), seed)
    h = np.array([digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(width)))], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        at = self.root
        while (d := (at[0] ^ x).bit_count()) in at[1]:
            at = at[1][d]
        at[1][d] = (x, {})

    def within(self, x: int, radius: int) -> list[int]:
        found, ahead = [], [self.root] if self.root else []
        while ahead:
            value, children = ahead.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            for edge in range(d - radius, d + radius + 1):
                if edge in children:
                    ahead.append(children[edge])
        return found


def forest(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within the radius that join what was apart, over distinct fingerprints."""
    tree, parent, out = BKTree(), {}, []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in members:
        parent[x] = x
        for y in tree.within(x, radius):
            if (a := top(x)) != (b := top(y)):
                parent[a] = b
                out.append((x, y))
        tree.add(x)
    return out


def _masks(free: list[int], parts: int, agree: int) -> list[tuple[list[int], list[int]]]:
    """Ways to fix `agree` of `parts` near-equal runs of the free bits: (bits fixed, bits still free)."""
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    runs = [free[a:b] for a, b in zip(cuts, cuts[1:])]
    return [([x for k in held for x in runs[k]], [x for k in range(parts) if k not in held for x in runs[k]]) for held in combinations(range(parts), agree)]


def _signed(bits: list[int]) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def _rooms() -> list[list[tuple[list[int], list[int], int]]]:
    """By level: (all bits fixed, bits free, index of the room it came from)."""
    levels = [[(held, free, 0) for held, free in _masks(list(range(64)), 4, 2)]]
    while len(levels) < 3:
        levels.append([(fixed + held, rest, k) for k, (fixed, free, _) in enumerate(levels[-1]) for held, rest in _masks(free, 3, 1)])
    return levels


def links(nodes: DataFrame) -> DataFrame:
    """(u, v), u > v, over distinct fingerprints: links that span every component of the radius graph."""
    spark, rooms = nodes.sparkSession, _rooms()

    def housed(df: DataFrame, level: int, come_from: int | None = None) -> DataFrame:
        mine = [(k, r) for k, r in enumerate(rooms[level]) if come_from is None or r[2] == come_from]
        keys = F.array(*(F.struct(F.lit(k).alias("room"), F.col("fp").bitwiseAND(F.lit(_signed(r[0]))).alias("key")) for k, r in mine))
        return df.select("fp", F.inline(keys))

    def treed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e.max(1)), pa.array(e.min(1))], names=["u", "v"])

        last, members, edges = None, [], []
        for b in batches:
            room, key, fp = (b.column(c).to_numpy() for c in ("room", "key", "fp"))
            starts = np.flatnonzero(np.r_[True, (room[1:] != room[:-1]) | (key[1:] != key[:-1])]) if len(fp) else []
            for s, e in zip(starts, [*starts[1:], len(fp)]):
                if (now := (room[s], key[s])) != last:
                    if len(members) > 1:
                        edges += forest(members)
                    last, members = now, []
                members += fp[s:e].view(np.uint64).tolist()
            if len(edges) > 50_000:
                yield out(edges)
                edges = []
        if len(members) > 1:
            edges += forest(members)
        yield out(edges)

    found, here, level = None, housed(nodes, 0), 0
    while True:
        crowded = None
        if level < 2:
            crowded = here.groupBy("room", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("room", "key")
            crowded = cut(crowded)
            if crowded.isEmpty():
                crowded = None
        # every crowded room holds over BUCKET rows, so their list is shorter than the rows by that factor
        easy = here if crowded is None else here.join(crowded, ["room", "key"], "left_anti")
        e = dealt_by(easy, "room", "key").sortWithinPartitions("room", "key").mapInArrow(treed, "u bigint, v bigint")
        found = e if found is None else found.unionByName(e)
        if crowded is None:
            return found.distinct()
        full = here.join(crowded, ["room", "key"], "left_semi")
        parts = [housed(full.where(F.col("room") == k).select("fp"), level + 1, k) for k in range(len(rooms[level]))]
        here = parts[0]
        for p in parts[1:]:
            here = here.unionByName(p)
        # equal fingerprints reach a room by one way only: its parent's key is part of its own
        here, level = cut(here), level + 1


def classes(docs: DataFrame, width: int = 3, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, fp and component_id of every row of docs. `keep` writes what the result still reads."""
    prints = (keep or (lambda df: saved(df, "fingerprints")))(fingerprints(docs, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    roots = components(links(nodes.select("fp")))
    at = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    ids = at.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(at.join(ids, "root").select("fp", "component_id", "rows"))
    return looked_up(prints, named, "fp", "rows", prints.count()).select("doc_id", "fp", "component_id")


def groups(docs: DataFrame, width: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id and group_id (the smallest doc_id of the group), one row for each doc_id that is not null.

    Groups are the components of the fingerprint links; with `similarity`, of those and of similar().
    """
    with Shelf(docs.sparkSession, "fingerprints") as shelf:
        found = cut(classes(docs, width, shelf.put).where("doc_id is not null").select("doc_id", F.col("component_id").alias("group_id")))
    if similarity is None:
        return found.groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    edges = found.where("doc_id <> group_id").select(F.col("doc_id").alias("u"), F.col("group_id").alias("v"))
    roots = similar(docs, edges, similarity)
    return found.select("doc_id").distinct().join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))


def keep_one(docs: DataFrame, width: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the document with the smallest doc_id stays.

    Rows whose doc_id is null stay, since no id tells them apart; rows with equal doc_id and text stay once.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = not ids.where("n > 1").isEmpty()
    gone = cut(groups(docs, width, similarity).where("doc_id <> group_id").select("doc_id"))
    left = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    return left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(left.where("doc_id is null")) if again else left
