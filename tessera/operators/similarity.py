"""Similarity joins over vectors: exact, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fusion, vec
from tessera.functions.fusion import MODES, Fusion, rerank_arrays
from tessera.session import Shelf, carried, cut, saved

for _module in (__name__, fusion.__name__, vec.__name__):
    carried(_module)

#: Rows of a tile, and of a block at least; two blocks and the product of two tiles are what a task holds.
BLOCK = 2048
#: Blocks that rows are dealt to if these are not too small or large, and bytes of vectors in a block at most. Where nothing can be
#: skipped every row is sent to every block, so blocks are few.
BLOCKS, BYTES = 12, 16 << 20
#: Rows of pairs that leave a task at once, and links that wait in it to be looked at together.
LOT = 1 << 18
#: Rows around a pivot on average, pivots at most, and rows that each of them is chosen from.
CELL, PIVOTS, CHOICE = 64, 1024, 4
#: Angle (radians) by which bounds are widened against rounding.
SLACK = 1e-5
#: Identities, and results, of a block of the top-1 match.
IDENTITIES, RESULTS = 4096, 4096


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column whose vectors share one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + vec.EPS)


def raw(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as they are; vectors share one length and have no null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, of rows that have one."""
    x = x.astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


@dataclass(frozen=True)
class Cells:
    """Cells of the unit sphere around pivots and the blocks that their rows fall into; of bounded size.

    Cells of near pivots share a block up to its rows; a larger cell has `many` blocks from `first` on.
    """

    pivots: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    many: np.ndarray
    reach: float

    def blocks(self) -> int:
        return int((self.first + self.many).max())

    def visits(self, angle: np.ndarray) -> np.ndarray:
        """Whether rows at these angles to the pivots can have a partner in a cell: all of a cell is within its radius of the pivot,
        so a row farther from the pivot than radius and reach together has none there."""
        return angle <= self.radius + self.reach + SLACK


def far_apart(x: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows, each the one farthest from all before, so that groups apart have pivots of their own."""
    chosen, best = [0], x @ x[0]
    while len(chosen) < most and best.min() < 1 - 1e-9:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return x[chosen]


def near_order(pivots: np.ndarray) -> np.ndarray:
    """Pivots in a chain, each followed by the nearest that is left."""
    left, chain = np.ones(len(pivots), bool), [0]
    left[0] = False
    for _ in range(len(pivots) - 1):
        s = np.where(left, pivots @ pivots[chain[-1]], -2)
        chain.append(int(s.argmax()))
        left[chain[-1]] = False
    return np.array(chain)


def block_rows(n: int, wide: int) -> int:
    """Rows of a block for n vectors of `wide` bytes."""
    return max(BLOCK, min(-(-n // BLOCKS), BYTES // wide))


def packed(sizes: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbours in the order share a block up to `most` rows."""
    first, many, block, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for c in order:
        if held and held + sizes[c] > most:
            block, held = block + 1, 0
        first[c], many[c] = block, max(1, -(-sizes[c] // most))
        held += sizes[c]
        if many[c] > 1:
            block, held = block + many[c], 0
    return first, many


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and x: the vectors, as they are, of rows whose vector has a direction."""
    kind = dict(vectors.dtypes)[vector]
    x = F.col(vector) if kind in ("array<float>", "array<double>") else vec.doubles(F.col(vector))
    return vectors.where(vec.normalized(F.col(vector)).isNotNull()).select(F.col(key).alias("id"), x.alias("x"))


def celled(vectors: DataFrame, least: float, shelf: Shelf, key: str, vector: str) -> tuple[DataFrame, Cells]:
    """Rows (id, x, cell) of usable vectors, one at least, by their nearest pivot, and the cells.

    Pivots are chosen, far from one another, from the rows with the least hashes of their keys; as many that a cell has CELL rows on
    average, PIVOTS at most. A group that is in no pivot makes the cells that take it wide, which costs work and loses nothing.
    """
    rows = shelf.put(usable(vectors, key, vector))
    n = rows.count()
    most = min(PIVOTS, -(-n // CELL))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(CHOICE * most).select("x").collect()  # bounded
    pivots = far_apart(unit(np.array([r["x"] for r in some])), most)
    pivots = pivots[near_order(pivots)]
    kind, wide = dict(rows.dtypes)["id"], dict(rows.dtypes)["x"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = unit(raw(b.column("x"))) @ pivots.T
            cell = s.argmax(axis=1)
            angle = np.arccos(np.clip(s.max(axis=1, initial=-1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=["id", "x", "cell", "angle"])

    dealt = shelf.put(rows.mapInArrow(nearest, f"id {kind}, x {wide}, cell int, angle double"))
    radius, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in dealt.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot
        radius[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
    first, many = packed(sizes, np.arange(len(pivots)), block_rows(n, pivots.shape[1] * (4 if wide == "array<float>" else 8)))
    return dealt.drop("angle"), Cells(pivots, np.where(sizes > 0, radius, -np.inf), first, many, float(np.arccos(np.clip(least, -1, 1))))


def visited(dealt: DataFrame, cells: Cells) -> DataFrame:
    """(id, x, own, a, b): each row under every pair of blocks, its own and one in which it can have a partner."""
    kind, wide = dict(dealt.dtypes)["id"], dict(dealt.dtypes)["x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = cells.blocks()
        step = max(1, min(512, (1 << 22) // blocks))
        for big in batches:
            for lo in range(0, big.num_rows, step):
                b = big.slice(lo, step)
                go = cells.visits(angles(unit(raw(b.column("x"))), cells.pivots))
                edge = np.zeros((len(go), blocks + 1), np.int32)
                row, cell = np.nonzero(go)
                np.add.at(edge, (row, cells.first[cell]), 1)
                np.add.at(edge, (row, cells.first[cell] + cells.many[cell]), -1)
                row, other = np.nonzero(np.cumsum(edge[:, :-1], axis=1))
                c, part = b.column("cell").to_numpy(), b.column("part").to_numpy()
                own = (cells.first[c] + part % cells.many[c])[row]
                who = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(who), b.column("x").take(who), *(pa.array(v, pa.int32()) for v in (own, np.minimum(own, other), np.maximum(own, other)))], names=["id", "x", "own", "a", "b"]
                )

    part = F.shiftrightunsigned(F.xxhash64("id"), 1).alias("part")
    return dealt.select("id", "x", "cell", part).mapInArrow(run, f"id {kind}, x {wide}, own int, a int, b int")


def hits(t: pa.Table, least: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i and j of t, and their cosine, of all pairs of rows of its two blocks with cosine >= least[0], tile by tile; least[0] may
    rise on the way. Single precision rules out what is farther below than it can err; what is left is decided in double."""
    if not t.num_rows:
        return
    ids, own, x, a, b = t["id"].to_numpy(), t["own"].to_numpy(), raw(t["x"]), t["a"][0].as_py(), t["b"][0].as_py()
    left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
    slack = (x.shape[1] + 8) * 1.2e-7
    for lo in range(0, len(left), BLOCK):
        i = left[lo : lo + BLOCK]
        xi = unit(x[i])
        for hi in range(lo if a == b else 0, len(right), BLOCK):
            j = right[hi : hi + BLOCK]
            xj = unit(x[j])
            p, q = np.nonzero(xi.astype(np.float32) @ xj.astype(np.float32).T >= least[0] - slack)
            if a == b and lo == hi:
                p, q = p[p < q], q[p < q]
            if len(p) * 16 > len(i) * len(j):
                s = (xi @ xj.T)[p, q]
            else:
                s = np.concatenate([np.einsum("ij,ij->i", xi[p[k : k + 16384]], xj[q[k : k + 16384]]) for k in range(0, max(len(p), 1), 16384)])
            u, v = i[p], j[q]
            keep = (s >= least[0]) & (ids[u] != ids[v])
            yield u[keep], v[keep], s[keep]


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of rows i with those of rows j; in `root` every row has its root, before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not (root[root] == root).all():
            root[:] = root[root]


class Links:
    """What links(i, j) of n rows come to: few pairs that hold them together, and how many links each row has.

    With `need` of 1 at most the pairs are a spanning forest of all links. Else they are one of the links between rows that have `need`
    links, and every link of the others, of which there are fewer than `need` for a row.
    """

    def __init__(self, n: int, need: int) -> None:
        self.root, self.need, self.degree, self.wait, self.waiting = np.arange(n), need, np.zeros(n, np.int64), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.root)
        if self.need > 1:
            self.degree += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        apart = self.root[i] != self.root[j]
        self.wait.append((i[apart], j[apart]))
        self.waiting += int(apart.sum())
        if self.waiting > LOT:
            self.settle()

    def settle(self) -> None:
        """Links of rows that have enough go into the trees, others wait on."""
        if not self.wait:
            return
        i, j = (np.concatenate([w[c] for w in self.wait]) for c in (0, 1))
        sure = (self.degree[i] >= self.need) & (self.degree[j] >= self.need) if self.need > 1 else np.ones(len(i), bool)
        united(self.root, i[sure], j[sure])
        self.wait, self.waiting = [(i[~sure], j[~sure])], 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return tuple(np.concatenate([x, *(w[c] for w in self.wait)]) for c, x in ((0, at), (1, self.root[at])))


def in_lots(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    b = pa.RecordBatch.from_pydict(columns)
    for lo in range(0, b.num_rows, LOT):
        yield b.slice(lo, LOT)


def by_blocks(vectors: DataFrame, least: float, key: str, vector: str, each: Callable, schema: str) -> DataFrame:
    """What each(batches) gives for every pair of blocks of usable vectors that can hold a pair at `least`: rows (id, x, own, a, b).

    Rows fall into cells around pivots, cells into blocks; a pair of blocks is one task's work, product by product of two tiles, so
    memory is bounded whatever the rows. A row goes to those blocks alone that can hold a partner by the triangle inequality of
    angles, so where vectors cluster most pairs of blocks never meet, and nothing is lost. Vectors must share one length.
    """
    rows = usable(vectors, key, vector)
    if rows.limit(BLOCK + 1).count() <= BLOCK:  # one block
        return rows.select("id", "x", *(F.lit(0).alias(c) for c in ("own", "a", "b"))).groupBy("a", "b").applyInArrow(each, schema)
    with Shelf(vectors.sparkSession, "similar") as shelf:
        met = visited(*celled(vectors, least, shelf, key, vector))
        return saved(met.groupBy("a", "b").applyInArrow(each, schema), "similar-pairs")


def similar_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", score: bool = True) -> DataFrame:
    """(u, v, similarity; without `score` u and v alone), u < v, of all pairs with cosine >= least. Degenerate vectors have no pair.
    Pairs of blocks are worked on as in by_blocks()."""
    kind = dict(vectors.dtypes)[key]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids = t["id"].to_numpy()
        for i, j, s in hits(t, [least]):
            u, v = (pa.array(f(ids[i], ids[j]), t["id"].type) for f in (np.minimum, np.maximum))
            yield from in_lots({"u": u, "v": v, **({"similarity": pa.array(s)} if score else {})})

    return by_blocks(vectors, least, key, vector, pairs, f"u {kind}, v {kind}" + (", similarity double" if score else ""))


def top_pairs(vectors: DataFrame, least: float, most: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The first `most` rows of similar_pairs() by similarity (highest first), u and v. A task hands on its own first ones alone."""
    kind = dict(vectors.dtypes)[key]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids, floor = t["id"].to_numpy(), [least]
        u, v, s = ids[:0], ids[:0], np.zeros(0)
        for i, j, found in hits(t, floor):
            u, v, s = np.r_[u, np.minimum(ids[i], ids[j])], np.r_[v, np.maximum(ids[i], ids[j])], np.r_[s, found]
            if len(s) > most:
                floor[0] = max(floor[0], float(np.partition(s, len(s) - most)[len(s) - most]))
                u, v, s = u[s >= floor[0]], v[s >= floor[0]], s[s >= floor[0]]  # those level with the last stay
                if len(s) > 4 * most:
                    first = np.lexsort((v, u, -s))[:most]
                    u, v, s = u[first], v[first], s[first]
        yield from in_lots({"u": pa.array(u, t["id"].type), "v": pa.array(v, t["id"].type), "similarity": pa.array(s)})

    found = by_blocks(vectors, least, key, vector, best, f"u {kind}, v {kind}, similarity double")
    return found.orderBy(F.desc("similarity"), "u", "v").limit(most)


def linked(vectors: DataFrame, least: float, need: int = 0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(u, v, n): pairs (n null) that hold together what pairs of cosine >= least do, by `Links` of each pair of blocks; with `need` over
    1 also rows without v, whose n add up to how many such pairs u has.

    A task gives less than need + 2 rows for each of its vectors, however many pairs it finds.
    """
    kind = dict(vectors.dtypes)[key]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids, held = t["id"], Links(t.num_rows, need)
        for i, j, _ in hits(t, [least]):
            held.add(i, j)
        i, j = held.pairs()
        yield from in_lots({"u": ids.take(pa.array(i)).combine_chunks(), "v": ids.take(pa.array(j)).combine_chunks(), "n": pa.nulls(len(i), pa.int64())})
        at = np.flatnonzero(held.degree)
        yield from in_lots({"u": ids.take(pa.array(at)).combine_chunks(), "v": pa.nulls(len(at), ids.type), "n": pa.array(held.degree[at])})

    return by_blocks(vectors, least, key, vector, links, f"u {kind}, v {kind}, n bigint")


def unit_rows(column: pa.ChunkedArray) -> np.ndarray | None:
    """Unit rows, NaN where a row has no vector; None where none has."""
    column = column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    if not there.any():
        return None
    some = matrix(column.drop_null())
    out = np.full((len(there), some.shape[1]), np.nan)
    out[there] = some
    return out


def met_in_blocks(results: DataFrame, identities: DataFrame, threshold: float, each: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
    """(results with `_row`, what each(asked, known) gives for every block of results with every block of identities).

    asked has _row, x and y (the unit vectors), known has position, label, p, q and t. A result has `embedding` and may have
    `aux_embedding`, an identity position, label and prototype, and may have same_threshold and aux_prototype; those without
    a usable first vector, and identities without a label, are left out.
    """
    has_aux, has_thr = "aux_prototype" in identities.columns and "aux_embedding" in results.columns, "same_threshold" in identities.columns
    none = F.lit(None).cast("array<double>")
    thr = F.coalesce(F.col("same_threshold"), F.lit(threshold)) if has_thr else F.lit(threshold)
    known = identities.select(F.col("position").cast("long").alias("position"), F.col("label").cast("string").alias("label"), vec.normalized(F.col("prototype")).alias("p"), (vec.normalized(F.col("aux_prototype")) if has_aux else none).alias("q"), thr.cast("double").alias("t"))
    known = cut(known.where(F.col("p").isNotNull() & (F.trim("label") != "")))
    rows = cut(results.withColumn("_row", F.monotonically_increasing_id()))
    asked = rows.select("_row", vec.normalized(F.col("embedding")).alias("x"), (vec.normalized(F.col("aux_embedding")) if has_aux else none).alias("y")).where("x is not null")
    i_blocks, r_blocks = max(1, -(-known.count() // IDENTITIES)), max(1, -(-rows.count() // RESULTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("r", F.pmod(F.xxhash64("_row"), F.lit(r_blocks)).cast("int")).withColumn("i", every(i_blocks))
    right = known.withColumn("i", F.pmod(F.xxhash64("position"), F.lit(i_blocks)).cast("int")).withColumn("r", every(r_blocks))
    return rows, left.groupBy("r", "i").cogroup(right.groupBy("r", "i")).applyInArrow(each, schema)


def rerank_counts(results: DataFrame, identities: DataFrame, threshold: float, rule: Fusion) -> DataFrame:
    """mode, accepted and n: how many pairs of a result and an identity end in each mode of the fusion."""

    def counts(asked: pa.Table, known: pa.Table) -> pa.Table:
        n = np.zeros((len(MODES), 2), np.int64)
        if asked.num_rows and known.num_rows:
            p, t, q = matrix(known["p"].combine_chunks()), known["t"].to_numpy(), unit_rows(known["q"])
            for lo in range(0, asked.num_rows, 512):
                part = asked.slice(lo, 512)
                y = unit_rows(part["y"])
                ok, _, mode = rerank_arrays(matrix(part["x"].combine_chunks()) @ p.T, None if y is None or q is None else y @ q.T, t[None, :], rule)
                n += np.bincount((mode * 2 + ok).ravel(), minlength=2 * len(MODES)).reshape(-1, 2)
        mode, ok = np.nonzero(n)
        return pa.table({"mode": pa.array([MODES[m] for m in mode], pa.string()), "accepted": pa.array(ok == 1, pa.bool_()), "n": pa.array(n[mode, ok], pa.int64())})

    met = met_in_blocks(results, identities, threshold, counts, "mode string, accepted boolean, n bigint")[1]
    return met.groupBy("mode", "accepted").agg(F.sum("n").alias("n"))


def best_identity(results: DataFrame, identities: DataFrame, threshold: float, rule: Fusion = Fusion(enabled=False)) -> DataFrame:
    """Columns of results and `match` struct(label, score, primary, aux, mode): the accepted identity of highest fused score.

    results and identities as in met_in_blocks(). The first position wins ties; no accepted identity gives null. A pair of blocks is one
    matrix product in one task, which gives each result's best in that block of identities; the best of those is a
    maximum that combines before the shuffle. Vectors of a column share one length.
    """
    kind = "label string, score double, primary double, aux double, mode string"

    def best(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = [pa.table({"row": pa.array([], pa.int64()), "place": pa.array([], pa.int64()), "label": pa.array([], pa.string()), **{c: pa.array([], pa.float64()) for c in ("score", "primary", "aux")}, "mode": pa.array([], pa.string())})]
        if not (asked.num_rows and known.num_rows):
            return out[0]
        known = known.sort_by("position")
        p, t, q = matrix(known["p"].combine_chunks()), known["t"].to_numpy(), unit_rows(known["q"])
        label, position = known["label"].combine_chunks(), known["position"].to_numpy()
        for lo in range(0, asked.num_rows, 512):
            part = asked.slice(lo, 512)
            s, y = matrix(part["x"].combine_chunks()) @ p.T, unit_rows(part["y"])
            z = None if y is None or q is None else y @ q.T
            ok, fused, mode = rerank_arrays(s, z, t[None, :], rule)
            i = np.where(ok, fused, -np.inf).argmax(axis=1)  # the first of equals
            r = np.flatnonzero(ok.any(axis=1))
            i = i[r]
            aux = pa.array(np.zeros(len(r)) if z is None else z[r, i], pa.float64(), mask=mode[r, i] != 3)
            out.append(pa.table({"row": part["_row"].take(pa.array(r)), "place": pa.array(-position[i], pa.int64()), "label": label.take(pa.array(i)), "score": fused[r, i], "primary": s[r, i], "aux": aux, "mode": pa.array(np.array(MODES)[mode[r, i]], pa.string())}))
        return pa.concat_tables(out)

    rows, met = met_in_blocks(results, identities, threshold, best, f"row bigint, place bigint, {kind}")
    top = met.groupBy("row").agg(F.max(F.struct("score", "place", "label", "primary", "aux", "mode")).alias("m"))
    match = F.when(F.col("m.label").isNotNull(), F.struct("m.label", "m.score", "m.primary", "m.aux", "m.mode")).alias("match")
    return rows.join(top, rows["_row"] == top["row"], "left").select(*(rows[c] for c in results.columns), match)
