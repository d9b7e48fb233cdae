"""Substring dedup: passages of `window` words that also begin in a document with a smaller doc_id go.

Words are the runs free of ASCII white space, unchanged. A window is `window` consecutive words of one document; a
word goes if a window that covers it has the same words as a window of a document with a smaller doc_id. Windows are
judged on the input, not on what is left.

Anchors. The non-overlapping blocks of half a window at word 0, `block`, 2 `block`, ... of every document are the index.
Any window of `2 block` words or more holds one whole block, so a repeat shows as a hit when every rolling run of
`block` words of every document is looked up in the index. Run hashes go to the partition that owns their leading bits,
each once for a unit of up to `UNIT` words, so a passage that a third of all rows hold sends one row per unit. A run that
is indexed somewhere and occurs twice is active, and whether it is depends on its words alone.

Extension. Of the active anchors in a window the least by hash stands for it, so equal windows have equal anchors at equal
places, whatever surrounds them. The windows that one anchor stands for are consecutive and form a span, its extension to
both sides. Spans with the same words are settled as a whole against the least doc_id that has them. Where spans around
one anchor differ, as at the ends of a repeat, the first of each kind are settled window by window. Neighbouring
windows and spans join to the maximal repeat. Equal means equal in two 64-bit hashes, of the anchor's words and of all
words, over independent hashes of the words.

No step lists pairs: a span or window is compared with the smallest doc_id of its kind, which partial aggregation finds
before the shuffle, and heavy kinds are looked up in a broadcast (`session.looked_up`).

Edge cases: null and empty texts have no words. A row whose doc_id is null is in no order: it loses nothing and nothing
goes on its account. Rows with one doc_id are not smaller than one another; equal rows lose the same words. Documents
below `window` words are kept. An empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried, shards
from tessera.session import Shelf, looked_up, small

carried(__name__)

WINDOW = 50
#: Words whose runs a task holds at once, fewer than 2^24; a longer document is a unit of its own.
UNIT = 1_000_000
#: Characters of text for each partition of the index at most.
PART = 1 << 25
#: Words whose hashes a task remembers.
WORDS = 1 << 18
#: Bases of the two polynomials, odd.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Words(dict):
    """128-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_128_digest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Runs:
    """Hashes of runs of words, from sums of word hashes times powers of an odd base."""

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        n = len(hashes)
        power = np.full(n + 1, base, np.uint64)
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(hashes) * np.multiply.accumulate(power)[:n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.back[starts])


def narrow(values: np.ndarray) -> bytes:
    """Numbers below 2^32 in as many bytes each as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def wide(raw: bytes) -> np.ndarray:
    """What narrow() was given."""
    width = raw[0]
    out = np.zeros((len(raw) // width if width > 1 else len(raw) - 1, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u4").ravel()


def unit_rows(hashes: np.ndarray, lengths: np.ndarray, block: int, parts: int) -> tuple[list[tuple], bytes, bytes]:
    """A unit's distinct runs as (part, hash gaps, places, flags), and its repeated runs as places and their first places.

    A part's hashes are 32 bits, ascending; flags say (bit 0) that the run is an aligned block, (bit 1) that it occurs twice."""
    starts = np.cumsum(lengths) - lengths
    room = lengths - block + 1
    at = np.arange(int(room.sum())) + np.repeat(starts - np.cumsum(room) + room, room)
    aligned = (at - np.repeat(starts, room)) % block == 0
    h = Runs(hashes[:, 0], BASES[0]).hashes(at, block)
    order = np.argsort(h, kind="stable")
    h, at, aligned = h[order], at[order], aligned[order]
    new = np.r_[True, h[1:] != h[:-1]]
    first = np.flatnonzero(new)
    flags = np.logical_or.reduceat(aligned, first).astype(np.uint8) | ((np.diff(np.r_[first, len(h)]) > 1).astype(np.uint8) << 1)
    twins, roots = at[~new], np.repeat(at[first], np.diff(np.r_[first, len(h)]))[~new]
    h, at = h[first], at[first]
    part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    rows, cuts = [], np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        o = np.argsort(low[a:b], kind="stable")
        x = low[a:b][o]
        rows.append((int(part[a]), narrow(np.diff(x, prepend=0)), narrow(at[a:b][o]), flags[a:b][o].tobytes()))
    return rows, narrow(twins), narrow(roots)


def rolled(docs: DataFrame, block: int, window: int, parts: int) -> DataFrame:
    """Units' rows for the parts of the index, and for each unit one row with its documents."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, known, nth = TaskContext.get().partitionId(), Words(), 0
        ids, marks, hashes, size = [], [], [], 0

        def unit() -> pa.RecordBatch:
            lengths = np.array([len(h) for h in hashes])
            rows, twins, roots = unit_rows(np.concatenate(hashes), lengths, block, parts)
            name = xxhash.xxh64_intdigest(np.array([task, nth, *marks], np.int64).tobytes()) >> 1  # so a unit that is made again of other rows has another name
            n = len(rows)
            none = [None] * n
            cols = {
                "part": pa.array([*(r[0] for r in rows), name % parts], pa.int32()), "unit": pa.array([name] * (n + 1), pa.int64()), "gaps": pa.array([*(r[1] for r in rows), None], pa.binary()),
                "places": pa.array([*(r[2] for r in rows), None], pa.binary()), "flags": pa.array([*(r[3] for r in rows), None], pa.binary()), "ids": pa.array([*none, ids], pa.list_(kinds)),
                "marks": pa.array([*none, marks], pa.list_(pa.int64())), "lengths": pa.array([*none, narrow(lengths)], pa.binary()), "twins": pa.array([*none, twins], pa.binary()), "roots": pa.array([*none, roots], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(cols)

        for b in batches:
            kinds = b.schema.field("doc_id").type
            for d, t, mark in zip(*(b.column(c) for c in ("doc_id", "text", "mark"))):
                words = split(t.as_py())
                if len(words) >= window:
                    if size and size + len(words) > UNIT:
                        yield unit()
                        ids, marks, hashes, size, nth = [], [], [], 0, nth + 1
                    ids.append(d.as_py())
                    marks.append(mark.as_py())
                    hashes.append(known.of(words))
                    size += len(words)
        if size:
            yield unit()

    return docs.mapInArrow(run, f"part int, unit bigint, gaps binary, places binary, flags binary, ids array<{kind}>, marks array<bigint>, lengths binary, twins binary, roots binary")


def active(rows: DataFrame, parts: int) -> DataFrame:
    """Of each unit the places of its active runs, beside the units' own rows. A task owns a part of the index."""
    carry = ["unit", "places", "ids", "marks", "lengths", "twins", "roots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            own = b.filter(b.column("gaps").is_null())
            if own.num_rows:
                yield own.select(carry)
            held += zip(*(b.column(c).to_pylist() for c in ("unit", "gaps", "places", "flags")))
        held = [x for x in held if x[1] is not None]
        if not held:
            return
        h = [np.cumsum(wide(gaps), dtype=np.int64).astype(np.uint32) for _, gaps, _, _ in held]
        flags = [np.frombuffer(f, np.uint8) for *_, f in held]
        sizes = [len(x) for x in h]
        h, flags = np.concatenate(h), np.concatenate(flags)
        index = np.unique(h[flags & 1 == 1])
        slot = np.minimum(np.searchsorted(index, h), max(len(index) - 1, 0))
        hit = index[slot] == h if len(index) else np.zeros(len(h), bool)
        times = np.bincount(slot[hit], weights=1 + (flags[hit] >> 1), minlength=len(index))
        hit[hit] = times[slot[hit]] > 1
        for (unit, _, places, _), mine in zip(held, np.split(hit, np.cumsum(sizes)[:-1])):
            if mine.any():
                row = {"unit": pa.array([unit], pa.int64()), "places": pa.array([narrow(wide(places)[mine])], pa.binary())}
                yield pa.RecordBatch.from_arrays([row.get(c, pa.nulls(1, rows_type[c])) for c in carry], names=carry)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = rows.select(carry).schema
    rows_type = {f.name: f.type for f in to_arrow_schema(schema)}
    return rows.repartitionById(parts, "part").mapInArrow(run, schema)


def by_document(found: DataFrame) -> DataFrame:
    """(doc_id, mark, at): the active places of each document that has any."""
    kind = dict(found.dtypes)["ids"][6:-1]

    def run(t: pa.Table) -> pa.Table:
        own = t.filter(t.column("ids").is_valid())
        if own.num_rows != 1:
            raise RuntimeError("a unit's rows were made twice, of different rows; run the query again")
        one = {c: own.column(c)[0] for c in own.column_names}
        hits = [wide(x) for x, mine in zip(t.column("places").to_pylist(), t.column("ids").is_valid().to_pylist()) if not mine]
        at = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.uint32)
        twins, roots = wide(one["twins"].as_py()), wide(one["roots"].as_py())
        at = np.sort(np.r_[at, twins[np.isin(roots, at)]]).astype(np.int64)
        lengths = wide(one["lengths"].as_py()).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        cuts = np.searchsorted(at, np.r_[starts, starts[-1] + lengths[-1]])
        some = np.flatnonzero(np.diff(cuts))
        lists = pa.array([narrow(at[cuts[d] : cuts[d + 1]] - starts[d]) for d in some], pa.binary())
        pick = pa.array(some)
        return pa.table({"doc_id": one["ids"].values.take(pick), "mark": one["marks"].values.take(pick), "at": lists})

    out = found.groupBy("unit").applyInArrow(run, f"doc_id {kind}, mark bigint, at binary")
    return out.groupBy("doc_id", "mark").agg(F.first("at").alias("at"))


def spans_of(hashes: np.ndarray, at: np.ndarray, block: int, window: int) -> tuple[np.ndarray, ...]:
    """Spans of a document: first window, windows, the anchor's hash, the span's hash, and the hash of every window."""
    n = len(hashes)
    runs, whole = Runs(hashes[:, 0], BASES[0]), Runs(hashes[:, 1], BASES[1])
    h = runs.hashes(at, block)
    at, h = at[h != ~np.uint64(0)], h[h != ~np.uint64(0)]
    every = np.full(n - block + 1, ~np.uint64(0))
    every[at] = h
    views = np.lib.stride_tricks.sliding_window_view(every, window - block + 1)  # one row for each window
    best = views.argmin(axis=1)
    s = np.arange(n - window + 1)
    anchor = s + best
    s = s[every[anchor] != ~np.uint64(0)]
    if not len(s):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    anchor = anchor[s]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(s) != 1)])
    count = np.diff(np.r_[first, len(s)])
    begin = s[first]
    span = whole.hashes(begin, count - 1 + window)
    span = mixed(span ^ (count.astype(np.uint64) << np.uint64(32)) ^ (anchor[first] - begin).astype(np.uint64))
    return begin, count, every[anchor[first]], span, whole.hashes(s, window)


def spanned(rows: DataFrame, block: int, window: int) -> DataFrame:
    """rows(doc_id, mark, text, at) to (doc_id, mark, begin, n, h, k, w): spans and their windows."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                got = [spans_of(known.of(split(t)), wide(at).astype(np.int64), block, window) for t, at in zip(part.column("text").to_pylist(), part.column("at").to_pylist())]
                who = pa.array(np.repeat(np.arange(part.num_rows), [len(g[0]) for g in got]))
                begin, n, h, k, w = (np.concatenate([g[c] for g in got]) for c in range(5))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(w.view(np.int64)))
                cols = [part.column("doc_id").take(who), part.column("mark").take(who), pa.array(begin, pa.int32()), pa.array(n, pa.int32()), pa.array(h.view(np.int64)), pa.array(k.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "begin", "n", "h", "k", "w"])

    return rows.select("doc_id", "mark", "text", "at").mapInArrow(run, f"doc_id {kind}, mark bigint, begin int, n int, h bigint, k bigint, w array<bigint>")


def kinds_of(rows: DataFrame, shelf: Shelf) -> DataFrame:
    """For each kind: how many rows have it, the first doc_id and whether others have it too."""
    return shelf.put(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("first"), (F.max("doc_id") > F.min("doc_id")).alias("again")))


def repeated(docs: DataFrame, shelf: Shelf, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, gone): the windows to remove of each text as an array of (begin, n), n windows from word `begin` on.

    `mark` is the xxhash64 of the text. The result reads tables of the shelf.
    """
    block = window // 2
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    parts = max(shards(docs), -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // PART))
    hits = shelf.put(by_document(active(rolled(rows, block, window, parts), parts)))
    spans = shelf.put(spanned(rows.join(hits, ["doc_id", "mark"]), block, window))
    total = spans.count()
    whole = spans.select("doc_id", "mark", "begin", "n", F.struct("h", "k").alias("kind"))
    kinds = kinds_of(whole, shelf)
    settled = looked_up(whole, kinds.where("again"), "kind", "m", total).where("doc_id > first").select("doc_id", "mark", "begin", "n")
    # anchors around which spans differ, of more than one document: the first of each kind, window by window
    mixed_ = kinds.groupBy("kind.h").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("m"), (F.min("first") < F.max("first")).alias("apart")).where("c > 1 AND apart").select(F.col("h").alias("kind"), "m")
    firsts = looked_up(spans.select("doc_id", "mark", "begin", "w", F.col("h").alias("kind"), "k"), shelf.put(mixed_), "kind", "m", total).drop("m").select("doc_id", "mark", "begin", "w", F.struct(F.col("kind").alias("h"), "k").alias("kind"))
    firsts = looked_up(shelf.put(firsts), kinds, "kind", "m", total).where("doc_id = first")
    single = shelf.put(firsts.select("doc_id", "mark", "begin", "kind.h", F.posexplode("w").alias("o", "x")).select("doc_id", "mark", (F.col("begin") + F.col("o")).alias("begin"), F.struct("h", "x").alias("kind")))
    again = kinds_of(single, shelf)
    lone = looked_up(single, again.where("again"), "kind", "m", single.count()).where("doc_id > first").select("doc_id", "mark", "begin", F.lit(1).alias("n"))
    return settled.unionByName(lone).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("begin", "n")).alias("gone"))


def light(rows: DataFrame, weight: str, most: int = 4_000_000) -> DataFrame:
    """rows to be broadcast if few and their weights sum to little; both are counted first."""
    found = rows.agg(F.sum(weight)).first()[0] or 0
    return small(rows) if found <= most else rows


def cleaned(docs: DataFrame, shelf: Shelf, window: int = WINDOW) -> DataFrame:
    """doc_id, text (the kept words joined by one space; null becomes empty), n_words, n_removed and `removed`, the removed
    stretches as (start, length) in words, of every row of docs. Reads the shelf's tables."""
    gone = shelf.put(repeated(docs, shelf, window))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    rows = rows.join(light(gone.withColumn("n", F.size("gone")), "n").drop("n"), ["doc_id", "mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, words_, removed, stretches = [], [], [], []
            for t, g in zip(b.column("text").to_pylist(), b.column("gone")):
                words = split(t)
                out = []
                if g.is_valid:
                    begin, n = (g.values.field(c).to_numpy() for c in (0, 1))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + n - 1 + window, -1)
                    off = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.r_[False, off, False]))
                    out = [{"start": int(x), "length": int(y - x)} for x, y in zip(turn[::2], turn[1::2])]
                words_.append(len(words))
                for s in reversed(out):
                    del words[s["start"] : s["start"] + s["length"]]
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                removed.append(words_[-1] - len(words))
                stretches.append(out)
            cols = [b.column("doc_id"), pa.array(texts, pa.string()), pa.array(words_, pa.int64()), pa.array(removed, pa.int64()), pa.array(stretches, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_words", "n_removed", "removed"])

    return rows.select("doc_id", "text", "gone").mapInArrow(run, f"doc_id {kind}, text string, n_words bigint, n_removed bigint, removed array<struct<start: int, length: int>>")
