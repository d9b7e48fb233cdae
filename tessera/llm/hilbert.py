"""Sharding along a Hilbert curve over several metadata dimensions.

Three dimensions are quantised to 2^BITS cells each: source and lang by the rank of the value among the column's
values in their order, and the text's size by its logarithm, in cells of about equal numbers of rows. All three keep
the order of the values, so that the least and the greatest value of a file tell what it can hold. The cell's index on
the Hilbert curve orders the documents; runs of that order become shards of row counts at most one apart (the law
`rows`), so each shard covers few cells in every dimension and a filter on any of them skips files by their statistics.

The curve is walked by a table of states made by rule (Gray code, entry point and direction of each
sub-cube), one level for each bit. Ranks come from a range exchange on (index, text checksum, doc_id) and
counts per partition, so a crowded cell spreads over many tasks.

Edge cases: a null text counts as empty (size 1, checksum 0); null source and lang have cells of their own (cell
0), and null doc_ids come first among rows equal in cell and text; repeated rows are placed one after another; with fewer rows than shards some shards are
empty; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ranked

DIMS, BITS = 3, 5
#: Steps of the size histogram in each doubling; a long text's size has at most 31 doublings.
STEPS = 8


def curve_table(dims: int = DIMS) -> tuple[list[int], list[int]]:
    """Digit and next state for each state * 2^dims + cell; a state is entry point * dims + direction."""
    size = 1 << dims
    gray = lambda i: i ^ (i >> 1)

    def ungray(g: int) -> int:
        i = g
        while g := g >> 1:
            i ^= g
        return i

    def turn(x: int, by: int) -> int:  # to the right
        by %= dims
        return ((x >> by) | (x << (dims - by))) & (size - 1)

    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    way = lambda w: 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % dims
    digit, follows = [], []
    for e in range(size):
        for d in range(dims):
            for cell in range(size):
                w = ungray(turn(cell ^ e, d + 1))
                digit.append(w)
                follows.append((e ^ turn(entry(w), dims - (d + 1) % dims)) * dims + (d + way(w) + 1) % dims)
    return digit, follows


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The curve index of integer cells below 2^bits."""
    dims = len(cells)
    digit, follows = curve_table(dims)
    size = 1 << dims
    states = len(digit) // size
    at_level = lambda k: sum((F.shiftright(c, k).bitwiseAND(1) * (1 << j) for j, c in enumerate(cells)), F.lit(0))
    path = F.array(*(at_level(k).cast("long") for k in reversed(range(bits))))
    # the index so far and the state share one number
    both = F.lit([d * states + s for d, s in zip(digit, follows)])
    step = lambda acc, cell: F.floor(acc / states).cast("long") * (size * states) + F.element_at(both, (F.pmod(acc, F.lit(states)) * size + cell).cast("int") + 1)
    return F.floor(F.aggregate(path, F.lit(0).cast("long"), step) / states).cast("long")


def value_cells(docs: DataFrame, column: str, cells: int) -> list[tuple]:
    """(least value, cell) of each cell above 0 that holds a value: values ranked among the distinct ones, by a range exchange."""
    at = ranked(docs.where(F.col(column).isNotNull()).select(column).distinct(), [], [column])
    cell = F.expr(f"cast((rank * {cells - 1}) div rank_n as int) + 1")
    return sorted(tuple(r) for r in at.groupBy(cell.alias("cell")).agg(F.min(column).alias("least")).select("least", "cell").collect())


def size_cells(docs: DataFrame, step: Column, cells: int) -> list[tuple]:
    """(least step, cell) of cells of about equal numbers of rows, from the counts of all steps."""
    counts = sorted(tuple(r) for r in docs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())
    total, before, out = sum(n for _, n in counts), 0, []
    for at, n in counts:
        cell = before * cells // total
        if not out or out[-1][1] != cell:
            out.append((at, cell))
        before += n
    return out


def in_cell(value: Column, cells: list[tuple]) -> Column:
    """The cell of the last least value that is not above `value`; 0 for null."""
    if not cells:
        return F.lit(0)
    below = F.size(F.filter(F.array(*(F.lit(v) for v, _ in cells)), lambda c: c <= value))
    return F.when(value.isNull(), 0).otherwise(F.coalesce(F.get(F.array(*(F.lit(k) for _, k in cells)), below - 1), F.lit(0)))


def placed(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, rank, shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    step = F.floor(F.log2(size) * STEPS).cast("int")
    dims = [in_cell(F.col(c), value_cells(docs, c, 1 << bits)) for c in ("source", "lang")] + [in_cell(step, size_cells(docs, step, 1 << bits))]
    cells = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), *(c.alias(f"c{k}") for k, c in enumerate(dims)))
    keyed = cells.select("doc_id", "size", "text_crc32", hilbert_index([F.col(f"c{k}") for k in range(DIMS)], bits).alias("hilbert"))
    out = ranked(keyed, [], ["hilbert", "text_crc32", "doc_id", "size"])
    return out.withColumn("shard", _exact_floor("rank", shards)).withColumn("slot", F.col("rank") - _first_rank(shards)).drop("rank_n")


def _exact_floor(rank: str, shards: int) -> Column:
    return F.expr(f"cast(({rank} * {shards}) div rank_n as int)")


def _first_rank(shards: int) -> Column:
    """The least rank r with r * shards div n = shard."""
    return F.expr(f"(shard * rank_n + {shards - 1}) div {shards}")
