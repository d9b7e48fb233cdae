"""Periodic run detection: stretches of words that repeat with a period, at least four times over.

Words are the runs free of ASCII white space. A run is a stretch of consecutive words with smallest period q and a length
of max(6, 4 q) or more that no neighbouring word extends keeping period q.

Names (Karp, Miller, Rosenberg). Level 0 numbers the words; level k + 1 numbers the pairs of level-k names that stand 2^k
apart, so two stretches of 2^k words are equal if and only if their level-k names are. The longest common extension of
two places, to the right or to the left, is found by going down the levels and taking each step whose names agree.

Grid. Where period q holds over a run, word i equals word i + q for 3 q places or more in a row (5 for q = 1), so one place of
every grid with that step lies within. Grid places whose words agree are extended to both sides; an extension of enough
places is a run, whose period is the least with which the same stretch was found. The grid of all periods has n ln n / 3
places for n words.

Texts of like lengths are laid end to end, parted by symbols of their own, so numbers stay few and no extension leaves its
text. Names up to level 2 rule most texts out before the other levels are made.

Edge cases: null and empty texts, and texts below six words, have no run. Repeated rows are read one by one. An empty table
gives an empty result. Columns other than doc_id and text are neither read nor returned. A text is handled in one task,
in memory of its words times their levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import carried

carried(__name__)

#: Least length of a run in words, and in periods.
LEAST, TIMES = 6, 4
#: Words that are laid end to end, and grid places that are looked at together.
LAID, PLACES = 1 << 16, 1 << 19
#: Words that a task numbers before it starts anew.
WORDS = 1 << 20


class Numbers(dict):
    """Words numbered in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def named(symbols: np.ndarray, top: int) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, ... 2^top symbols, by where they start."""
    names = [symbols]
    for k in range(top):
        half = 1 << k
        last = names[-1]
        n = len(last) - half
        if n <= 0:
            break
        pairs = last[:n].astype(np.int64) * (int(last.max()) + 1) + last[half : half + n]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
    return names


def extended(names: list[np.ndarray], a: np.ndarray, q: np.ndarray, left: bool) -> np.ndarray:
    """How many symbols from a on (to the left: before a) equal those q further on."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        name = names[k]
        x = a - got - (1 << k) if left else a + got
        ok = (x >= 0) & (x + q < len(name))
        at = np.where(ok, x, 0)
        ok &= name[at] == name[np.where(ok, at + q, 0)]
        got += ok.astype(np.int64) << k
    return got


def grid(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) for n symbols whose longest text has `longest`, in parts."""
    most = max(longest // TIMES, 1)
    q = np.arange(1, most + 1)
    step = np.maximum((TIMES - 1) * q, LEAST - q)
    many = np.maximum(-(-(n - q) // step), 0)
    part = np.cumsum(many) // PLACES
    for p in np.unique(part):
        some = part == p
        c, s = many[some], step[some]
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        yield nth * np.repeat(s, c), np.repeat(q[some], c)


def hopeful(names: list[np.ndarray], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places whose word agrees with that a period on, and three more on a side (one more for period 1)."""
    zero = names[0]
    for a, q in grid(len(zero), longest):
        ok = zero[a] == zero[a + q]
        a, q = a[ok], q[ok]
        keep = np.zeros(len(a), bool)
        for k, mine in ((1, q == 1), (2, q > 1)):
            if len(names) > k:
                for back in (0, (1 << k) - 1):
                    x = a - back
                    ok = mine & (x >= 0) & (x + q < len(names[k]))
                    at = np.where(ok, x, 0)
                    keep |= ok & (names[k][at] == names[k][np.where(ok, at + q, 0)])
        yield a[keep], q[keep]


def found(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, ordered by start and period."""
    names = named(symbols, max(longest, 1).bit_length() - 1)
    out = []
    for a, q in hopeful(names, longest):
        right, left = extended(names, a, q, False), extended(names, a, q, True)
        ok = right + left + q >= np.maximum(LEAST, TIMES * q)
        out.append(np.stack([a - left, right + left + q, q])[:, ok])
    start, length, q = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, q = start[first], length[first], q[first]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def laid(texts: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each followed by a symbol of its own; where they start."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return np.concatenate([x for k, t in enumerate(texts) for x in (t, [vocabulary + k])]), starts


def runs_of(texts: list[np.ndarray], vocabulary: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each text (numbers below `vocabulary`)."""
    none = (np.zeros(0, np.int64),) * 3
    out = [none] * len(texts)
    groups, size = [], LAID
    for k in sorted((k for k, t in enumerate(texts) if len(t) >= LEAST), key=lambda k: len(texts[k])):
        if size + len(texts[k]) > LAID:
            groups.append([])
            size = 0
        groups[-1].append(k)
        size += len(texts[k])
    for group in groups:
        longest = len(texts[group[-1]])
        symbols, starts = laid([texts[k] for k in group], vocabulary)
        some = np.unique(np.concatenate([np.searchsorted(starts, a, "right") - 1 for a, _ in hopeful(named(symbols, 2), longest)]))
        group = [group[k] for k in some]
        if group:
            symbols, starts = laid([texts[k] for k in group], vocabulary)
            start, length, q = found(symbols, len(texts[group[-1]]))
            cuts = np.searchsorted(start, np.r_[starts, len(symbols)])
            for n, k in enumerate(group):
                s = slice(cuts[n], cuts[n + 1])
                out[k] = start[s] - starts[n], length[s], q[s]
    return out


def kept(n: int, start: np.ndarray, length: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of n words stay: a run keeps its first q words."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + q, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:-1] <= 0


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period) and text (words that no run repeats, joined by one
    space; null becomes empty) of every row of docs."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                if len(numbers) > WORDS:
                    numbers.clear()
                words = [split(t) for t in b.column("text").to_pylist()]
                runs = runs_of([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words], len(numbers))
                texts = [b" ".join([x for x, stays in zip(w, kept(len(w), *r).tolist()) if stays] if len(r[0]) else w).decode("utf-8", "surrogatepass") for w, r in zip(words, runs)]
                flat = [pa.array(np.concatenate([r[c] for r in runs]), pa.int64()) for c in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[0]) for r in runs)]), pa.int32()), pa.StructArray.from_arrays(flat, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "runs", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")
