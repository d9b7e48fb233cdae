"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another.

Tokenizer A (a `tokenizers` file, byte-level BPE) encodes a space and the text, tokenizer B (a `sentencepiece` model that puts
the space itself) the text; special tokens' strings are plain text. Byte offsets where tokens of both end cut the two
sequences into groups; all A and B tokens of a group are linked. The count of an id pair is how many documents hold it
linked.

Neither tokenizer joins a space with what stands before it (made sure on the vocabularies), so texts are cut before
each space that follows a character other than white space, and every cut is the end of a group. A task keeps each
distinct piece once, in DuckDB: the interval tables of new pieces' tokens meet in a join on their ends, window sums number
the groups, an ASOF join finds the group of an A token and a range join those of the B tokens that overlap it. A
batch's documents join the pieces' pairs there, and the partial counts of pairs, one table for each Arrow partition,
are merged in Spark.

The merged counts come back to the documents' pairs in a join: a broadcast if the distinct pairs, counted, are few enough,
else a shuffle in which heavy pairs are looked up in a broadcast (`session.looked_up`). Each document's pairs are kept
once with how often they occur.

Edge cases: texts that are null, empty, or that a tokenizer does not give back byte by byte (U+2581 becomes a space, for one)
have no tokens: zeros and an empty alignment. Repeated rows, null ids among them, count as documents of their own. An
empty table gives an empty result. Columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried
from tessera.session import Shelf, looked_up

carried(__name__)

#: Characters of a batch and pieces that a task remembers.
BATCH, PIECES = 500_000, 400_000
#: Pieces that are encoded as one text.
JOINED = 2000
#: Distinct pairs whose counts may be broadcast; counted first.
PAIRS = 2_000_000
#: Rows of partial counts at which a task sums them up.
PARTIAL = 2_000_000
#: White space in the sense of tokenizer A's pattern (a fixed class of Unicode).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space and the white space after it, then all up to the next space that follows no white space.
PIECE = re.compile(f" [{SPACE}]*(?:[^{SPACE}]+(?:[{SPACE.replace(' ', '')}][{SPACE}]*[^{SPACE}]+)*(?:[{SPACE}]+\\Z)?)?")

#: White space before a space or at the end; without it, each space begins a piece.
ODD = re.compile(f"[{SPACE}](?: |\\Z)").search
#: All white space.
WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def cut_up(text: str | None) -> list[str]:
    """The pieces of a space and a text."""
    if not text or ODD(" " + text):
        return PIECE.findall(" " + text) if text else []
    return [" " + w for w in text.split(" ")]


class Pair:
    """Both tokenizers, the bytes of their tokens, and the pieces seen so far."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces) or any(re.search(f"[^{SPACE}] ", x.decode("utf-8", "replace")) for x in self.a_bytes):
            raise ValueError("a tokenizer joins a space with what stands before it")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "allocator_flush_threshold": "8MB", "allocator_bulk_deallocation_flush_threshold": "8MB"})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.groups = np.zeros((3, 0), np.int64), []
        self.db.execute("CREATE OR REPLACE TABLE pairs (piece INTEGER, pair BIGINT, times INTEGER)")

    def _each(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B, and how many each piece has, of pieces one by one; none of those that a tokenizer does not give back."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        for k, p in enumerate(pieces):
            if not self._back(a[k], b[k], p.encode()):
                a[k], b[k] = [], []
        return [(np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)) for ids in (a, b)]

    def _back(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw

    def _joined(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """As _each(), of pieces that end in no white space, encoded as one text: each begins with a space, where both tokenizers part."""
        text = "".join(pieces)
        ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        if not self._back(*ids, text.encode()):
            return self._each(pieces)
        ends, out = np.cumsum([len(p.encode()) for p in pieces]), []
        for x, size in zip(ids, (self.a_size, self.b_size)):
            x = np.asarray(x, np.int64)
            at = np.cumsum(size[x])
            cuts = np.searchsorted(at, ends)
            if (at[np.minimum(cuts, len(at) - 1)] != ends).any():
                return self._each(pieces)
            out.append((x, np.diff(cuts, prepend=-1)))
        return out

    def _side(self, table: str, ids: np.ndarray, n: np.ndarray, size: np.ndarray, first: int) -> None:
        """Registers a side's token intervals within their pieces."""
        end = np.cumsum(size[ids])
        begin = end - size[ids]
        base = np.repeat(begin[np.minimum(np.cumsum(n) - n, max(len(ids) - 1, 0))], n) if len(ids) else begin
        self.db.register(table, pa.table({"piece": np.repeat(np.arange(first, first + len(n)), n), "k": np.arange(len(ids)), "id": ids, "s": begin - base, "e": end - base}))

    def learn(self, fresh: list[str]) -> None:
        """Aligns pieces that are not known yet."""
        plain, lone = [p for p in fresh if p[-1] not in WHITE], [p for p in fresh if p[-1] in WHITE]
        fresh, first = plain + lone, len(self.known)
        parts = [self._joined(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)] + ([self._each(lone)] if lone else [])
        (a, n_a), (b, n_b) = ((np.concatenate([p[side][0] for p in parts]), np.concatenate([p[side][1] for p in parts])) for side in (0, 1))
        self._side("a", a, n_a, self.a_size, first)
        self._side("b", b, n_b, self.b_size, first)
        run = self.db.execute
        run("CREATE OR REPLACE TEMP TABLE cuts AS SELECT piece, e AS hi, lag(e, 1, 0) OVER w AS lo, CAST(sum(1) OVER w AS INTEGER) AS g FROM (SELECT a.piece, a.e FROM a JOIN b ON a.piece = b.piece AND a.e = b.e) WINDOW w AS (PARTITION BY piece ORDER BY e)")
        run("CREATE OR REPLACE TEMP TABLE ag AS SELECT a.piece, a.k, a.id, c.g FROM a ASOF JOIN cuts c ON a.piece = c.piece AND a.e <= c.hi")
        run("CREATE OR REPLACE TEMP TABLE bg AS SELECT b.piece, b.k, b.id, c.g FROM b JOIN cuts c ON b.piece = c.piece AND b.s >= c.lo AND b.e <= c.hi")
        run(f"INSERT INTO pairs SELECT piece, ag.id * {len(self.b_bytes)} + bg.id, count(*) FROM ag JOIN bg USING (piece, g) GROUP BY ALL")
        t = run("SELECT piece, g, side, id FROM (SELECT piece, g, 0 AS side, k, id FROM ag UNION ALL SELECT piece, g, 1, k, id FROM bg) ORDER BY piece, g, side, k").fetchnumpy()
        n_groups, groups = self._texts(t["piece"] - first, t["g"], t["side"], t["id"], len(fresh))
        for table in ("cuts", "ag", "bg"):
            run(f"DROP TABLE {table}")
        self.sizes = np.concatenate([self.sizes, [n_a, n_b, n_groups]], 1)
        self.groups += groups
        for p in fresh:
            self.known[p] = len(self.known)

    def _texts(self, piece: np.ndarray, g: np.ndarray, side: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, list[str]]:
        """Groups of each of n pieces, and their ids written out, from tokens in order."""
        if not len(piece):
            return np.zeros(n, np.int64), [""] * n
        new_piece = np.r_[True, piece[1:] != piece[:-1]]
        new_group = new_piece | np.r_[True, g[1:] != g[:-1]]
        new_side = np.r_[True, side[1:] != side[:-1]]
        before = pa.array(["", ";", "|", ","]).take(pa.array(np.select([new_piece, new_group, new_side], [0, 1, 2], 3)))
        said = pc.binary_join_element_wise(before, pc.cast(pa.array(ids), pa.string()), "")
        _, offsets, data = said.buffers()
        offsets, data = np.frombuffer(offsets, np.int32)[: len(said) + 1], data.to_pybytes().decode()
        cuts = offsets[np.searchsorted(piece, np.arange(n + 1))].tolist()
        return np.bincount(piece[new_group], minlength=n), [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and how many each text has; none where a tokenizer does not give the text back."""
        if len(self.known) > PIECES:
            self.forget()
        cut = list(map(cut_up, texts))
        fresh = set(chain.from_iterable(cut)).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        text, lost = np.repeat(np.arange(len(n)), n), self.sizes[0][flat] == 0
        if lost.any():
            whole = np.bincount(text[lost], minlength=len(n)) == 0
            n, flat = n * whole, flat[whole[text]]
        return flat, n

    def linked(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times), ordered by text and pair, of pieces(); the texts' pairs are added to the partial counts."""
        at, times = np.unique(np.repeat(np.arange(len(n)), n) << 32 | flat, return_counts=True)
        self.db.register("held", pa.table({"text": (at >> 32).astype(np.int32), "piece": (at & 0xFFFFFFFF).astype(np.int32), "n": times}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE links AS SELECT text, pair, CAST(sum(n * times) AS BIGINT) AS times FROM held JOIN pairs USING (piece) GROUP BY text, pair")
        self.db.execute("INSERT INTO partial SELECT pair, count(*) FROM links GROUP BY pair")
        if self.db.execute("SELECT count(*) FROM partial").fetchone()[0] > PARTIAL:
            self.db.execute("CREATE OR REPLACE TABLE partial AS SELECT pair, CAST(sum(n) AS BIGINT) AS n FROM partial GROUP BY pair")
        t = self.db.execute("SELECT text, pair, times FROM links").fetchnumpy()
        order = np.lexsort((t["pair"], t["text"]))
        return t["text"][order], t["pair"][order], t["times"][order]

    def begin(self) -> None:
        self.db.execute("CREATE OR REPLACE TABLE partial (pair BIGINT, n BIGINT)")

    def counted(self) -> pa.Table:
        return self.db.sql("SELECT pair, CAST(sum(n) AS BIGINT) AS n FROM partial GROUP BY pair").to_arrow_table()


def both(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers for each worker process."""
    kept = sys.__dict__.setdefault("_tessera_pairs", {})  # this module travels by value, its globals anew with each task
    if (a_path, b_path) not in kept:
        kept[a_path, b_path] = Pair(a_path, b_path)
    return kept[a_path, b_path]


def batches_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lo = size = 0
    for k, n in enumerate(pc.utf8_length(b.column("text")).fill_null(0).to_pylist()):
        if size and size + n > BATCH:
            yield b.slice(lo, k - lo)
            lo, size = k, 0
        size += n
    yield b.slice(lo)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: `row` (its key), doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids of A and
    B, group by group), pairs (distinct, a * B's vocabulary + b) and times (links of each pair). Rows whose `row` is null
    hold an Arrow partition's partial counts: pairs, and in `times` how many documents have each."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, row, kinds = both(a_path, b_path), TaskContext.get().partitionId() << 40, None
        pair.begin()
        for b in batches:
            kinds = b.schema.field("doc_id").type
            for part in batches_of(b):
                flat, n = pair.pieces(part.column("text").to_pylist())
                text, pairs, times = pair.linked(flat, n)
                ends, cuts = np.searchsorted(text, np.arange(len(n) + 1)), np.concatenate([[0], np.cumsum(n)])
                total = lambda x, at: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[at]), pa.int64())
                offsets, said = pa.array(ends, pa.int32()), list(map(pair.groups.__getitem__, flat.tolist()))
                cols = [
                    pa.array(np.arange(row, row + len(n))), part.column("doc_id"), *[total(x[flat], cuts) for x in pair.sizes], total(times, ends),
                    pa.array([";".join(said[i:j]) for i, j in pairwise(cuts.tolist())], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ]
                row += len(n)
                yield pa.RecordBatch.from_arrays(cols, names=NAMES)
                del flat, n, text, pairs, times, ends, cuts, offsets, said, cols
                pa.default_memory_pool().release_unused()
        if kinds is not None:
            t = pair.counted()
            for lo in range(0, t.num_rows, 1 << 16):
                part = t.slice(lo, 1 << 16)
                one = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, part.column(c).combine_chunks()) for c in ("pair", "n")]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kinds), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *lists], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>")


NAMES = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


def counts(rows: DataFrame, b_size: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether no pair of its A id has more), from rows of aligned()."""
    merged = rows.where("row IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    a = F.floor(F.col("pair") / b_size)
    most = merged.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # as many rows as A has ids at most
    return merged.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, b_size: int, shelf: Shelf) -> DataFrame:
    """The documents of aligned() without their pairs, with n_best (links whose count is the highest of their A id) and count_sum
    (the counts of all links). Reads the shelf's tables."""
    rows = shelf.put(rows)
    found = shelf.put(counts(rows, b_size))
    held = rows.where("row IS NOT NULL").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if found.count() <= PAIRS:
        met = held.join(F.broadcast(found), "pair")
    else:
        held = shelf.put(held)
        met = looked_up(held, found, "pair", "n", held.count())
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.where("row IS NOT NULL").drop("pairs", "times").join(sums, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def vocabulary(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
