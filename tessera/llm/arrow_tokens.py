"""Token ids as Arrow IPC files of equal-length sequences.

Texts in ascending doc_id order are encoded, an end id is appended to each, and the ids run on through
sequences of `SEQUENCE` ids; a file's last sequence is filled up. Ids take 16 bits where the vocabulary allows it. A file is an Arrow IPC file (the stream
format with a footer) whose batches hold two fixed-size lists a row: `ids`, and `mask` (a bit, set for an id, clear
for filling). Both are contiguous buffers, so a reader maps the file and views any batch, sequence or document as
an array without a copy. Beside each file an index file (same format) has doc_id, first id and count of ids.

Documents are range-partitioned by doc_id and sorted, and each partition writes one file, under a name of
its attempt first and then renamed, so repeated and lost tasks leave whole files only. Files go to the folder
given (by default in the shared folder that the session names). Only one row per file comes to the driver.

Encoding splits a text at spaces and newlines, which the pre-tokenizer drops anyway, and remembers the ids
of each distinct word; unknown words, freed of case and closing punctuation, are encoded together, parted by
a mark that is a token of its own (words that hold the mark, or a special token, are encoded alone).

Edge cases: null and empty texts have the end id only; rows with a null doc_id come first; repeated rows are
encoded one by one, those of one doc_id in the order of a hash of their texts; an empty table gives no file and an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried, scratch

carried(__name__)

SEQUENCE = 2048
#: Sequences of a batch.
BATCH = 64
END = 2
#: What ends a word without a part in it (ASCII; no letter, digit or space).
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Letters below this have one lower case and no composition of their own.
LATIN = "\u0250"
#: Marks to choose from; the first that is one id parts unknown words.
MARKS = "•™©®…–★→¶"
#: Words remembered by a worker; beyond this the memory starts anew.
REMEMBERED = 1_500_000


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, by way of distinct words."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory: dict[str, bytes] = {}
        self.wide = max(self.tokenizer.get_vocab_size(), END + 1) > 1 << 16
        ids = {m: self.tokenizer.encode(f" {m} ", add_special_tokens=False).ids for m in MARKS}
        self.parting, self.mark = next(((m, i[0]) for m, i in ids.items() if len(i) == 1), ("", None))
        self.alone = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self._plain_words()
        # the shortcut holds where words part at white space; made sure on a probe
        probe = ["The", "end.", "it's", "ÀB1", "x"]
        joined = self.tokenizer.encode(" \n".join(probe), add_special_tokens=False).ids
        self.by_words = joined == [i for w in probe for i in self.tokenizer.encode(w, add_special_tokens=False).ids]

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _plain_words(self):
        """(tokenizer, mark, its id) for words of lower-case Latin letters: each is one piece, so cutting at spaces replaces
        normaliser and pattern; None where a probe differs."""
        from tokenizers import Tokenizer, pre_tokenizers

        quick = Tokenizer(self.tokenizer.model)
        quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "the naïve été größe z niño xqzjk of thtionhe éauxment".split(" ")
        same = all(quick.encode(w, add_special_tokens=False).ids == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)
        mark = quick.encode(".", add_special_tokens=False).ids
        return (quick, ".", mark[0]) if same and len(mark) == 1 else None

    def _many(self, words: list[str], tokenizer, parting: str, mark: int) -> None:
        for k in range(0, len(words), 500):
            part = words[k : k + 500]
            ids = np.asarray(tokenizer.encode_batch_fast([f" {parting} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == mark)
            if len(ends) != len(part) - 1:
                self._each(part)
                continue
            raw = ids.tobytes()
            starts = [0, *(4 * (ends + 1)).tolist()]
            for w, a, b in zip(part, starts, [*(4 * ends).tolist(), len(raw)]):
                self.memory[w] = raw[a:b]

    def _each(self, words) -> None:
        for w in words:
            self.memory[w] = self._bytes(self.tokenizer.encode(w, add_special_tokens=False).ids)

    def _learn(self, words: set[str]) -> None:
        """Remembers words. ASCII punctuation behind a letter or digit is a piece of its own, and case never counts for Latin
        letters, so what is still unknown of the two parts goes to the tokenizer."""
        memory, cut, plain, many, lone = self.memory, {}, set(), set(), set()
        for w in words:
            rest = w.rstrip(PUNCTUATION)
            low = rest.lower()  # may end in a mark that joins what follows, as that of a dotted capital I does
            if not low or not (low[-1].isalnum() and low[-1] < LATIN):
                rest, low = w, w.lower()
            latin = low.isalpha() and max(low) < LATIN
            if latin or rest.isascii():
                key = low
            else:
                key = rest
            cut[w] = key, w[len(rest) :]
            if key not in memory:
                if latin and self.plain:
                    plain.add(key)
                elif self.mark is None or self.parting in key or any(a in key for a in self.alone):
                    lone.add(key)
                else:
                    many.add(key)
            if cut[w][1] and cut[w][1] not in memory:
                lone.add(cut[w][1])
        self._each(lone)
        if plain:
            self._many(list(plain), *self.plain)
        if many:
            self._many(list(many), self.tokenizer, self.parting, self.mark)
        for w, (key, tail) in cut.items():
            memory[w] = memory[key] + memory[tail] if tail else memory[key]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [self._bytes(e.ids) for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        get, fresh, found = self.memory.get, set(), []
        for t in texts:
            t = t or ""
            # a special token that holds a space or newline can't be seen word by word
            words = None if any(a in t for a in self.alone) else t.replace("\n", " ").split(" ")
            ids = None if words is None else list(map(get, words))
            gaps = [k for k, x in enumerate(ids) if x is None] if ids and None in ids else []
            fresh.update([words[k] for k in gaps])
            found.append((t, words, ids, gaps))
        if fresh:
            self._learn(fresh)
        out = []
        for t, words, ids, gaps in found:
            if words is None:
                out.append(self._bytes(self.tokenizer.encode(t, add_special_tokens=False).ids))
                continue
            for k in gaps:
                ids[k] = self.memory[words[k]]
            out.append(b"".join(ids))
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    import sys

    kept = sys.__dict__.setdefault("_tessera_encoders", {})  # this module travels by value, its globals anew with each task
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _schema(sequence: int, wide: bool) -> pa.Schema:
    """Ids are as wide as the vocabulary needs, 16 or 32 bits; the mask is a bit each."""
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class SequenceWriter:
    """Writes a run of ids as fixed-size lists."""

    def __init__(self, sink, sequence: int = SEQUENCE, batch: int = BATCH, wide: bool = True) -> None:
        self.sequence, self.room, self.schema = sequence, sequence * batch, _schema(sequence, wide)
        self.kind = "<u4" if wide else "<u2"
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held, self.size, self.ids = [], 0, 0

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw) // 4
        self.ids += len(raw) // 4
        if self.size >= self.room:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) // self.room * self.room  # every batch but the last is full
        out, rest = ids[:whole], ids[whole:]
        fill = -len(out) % self.sequence
        mask = np.ones(len(out) + fill, bool)
        if fill:
            mask[len(out) :] = False
            out = np.concatenate([out, np.zeros(fill, "<u4")])
        for k in range(0, len(out), self.room):
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(a[k : k + self.room]), self.sequence) for a in (out.astype(self.kind), mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.held, self.size = ([rest.tobytes()] if len(rest) else []), len(rest)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


class SequenceReader:
    """Random access to the ids of a mapped file; views, not copies, where a run lies in one batch."""

    def __init__(self, source) -> None:
        self.file = pa.ipc.open_file(source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self._batches: dict[int, np.ndarray] = {}
        rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.room = rows * self.sequence

    def batch(self, k: int) -> np.ndarray:
        """All ids of batch k: a view of the file."""
        if k not in self._batches:
            self._batches.clear()
            self._batches[k] = self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self._batches[k]

    def mask(self, k: int) -> pa.BooleanArray:
        """True where batch k holds an id: a view of the file's bits."""
        return self.file.get_batch(k).column("mask").flatten()

    def ids(self, start: int, count: int) -> np.ndarray:
        out = []
        while count:
            k, at = divmod(start, self.room)
            part = self.batch(k)[at : at + count]
            if not len(part):
                raise ValueError("ids beyond the file's end")
            out.append(part)
            start, count = start + len(part), count - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _uri(folder: str) -> str:
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, sequence: int = SEQUENCE) -> tuple[str, list[tuple[str, int, int]]]:
    """Writes the files; returns their folder and (name, rows, ids) of each, in order of doc_id."""
    folder = _uri(folder or scratch(docs.sparkSession, "tokens"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out = TaskContext.get(), None
        for big in batches:
            for k in range(0, big.num_rows, 256):
                b = big.slice(k, 256)
                if out is None:
                    store, base = _open(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{task.partitionId():06d}"
                    draft = f"{base}/.{name}-{task.taskAttemptId()}"
                    sink = store.open_output_stream(f"{draft}.arrow")
                    out, ids, starts, counts = SequenceWriter(sink, sequence, wide=encoder(tokenizer).wide), [], [], []
                end = np.asarray([END], "<u4").tobytes()
                for raw in encoder(tokenizer).encode(b.column("text").to_pylist()):
                    starts.append(out.ids)
                    counts.append(len(raw) // 4 + 1)
                    out.add(raw + end)
                ids.append(b.column("doc_id"))
        if out is None:
            return
        out.close()
        sink.close()
        index = pa.table([pa.chunked_array(ids), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "start", "n_tokens"])
        with store.open_output_stream(f"{draft}.index") as f, pa.ipc.new_file(f, index.schema) as w:
            w.write_table(index, max_chunksize=65536)
        for end_ in ("index", "arrow"):
            store.move(f"{draft}.{end_}", f"{base}/{name}.{end_}")
        yield pa.RecordBatch.from_pydict({"file": [name], "n_rows": pa.array([len(starts)], pa.int64()), "n_ids": pa.array([out.ids], pa.int64())})

    tie = F.xxhash64("text").alias("_tie")  # rows of one id have an order of their own, and may be parted
    laid = docs.select("doc_id", "text", tie).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")
    found = laid.mapInArrow(run, "file string, n_rows bigint, n_ids bigint").collect()
    return folder, sorted((r["file"], r["n_rows"], r["n_ids"]) for r in found)


def read(spark, folder: str, files: list[tuple[str, int, int]], kind: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    base, at = [], 0
    for name, _, n in files:
        base.append((name, at))
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before in zip(*(c.to_pylist() for c in b.columns)):
                store, root = _open(folder)
                local = type(store).__name__ == "LocalFileSystem"
                with pa.memory_map(f"{root}/{name}.arrow") if local else store.open_input_file(f"{root}/{name}.arrow") as f, store.open_input_file(f"{root}/{name}.index") as g:
                    ids, index = SequenceReader(f), pa.ipc.open_file(g)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        starts = part.column("start").to_numpy()
                        crc = [zlib.crc32(ids.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), part.column("n_tokens").to_pylist())]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts + before), part.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(base, "file string, before bigint")
    return table.repartition(max(1, len(base))).mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
