"""Token-ID output: Arrow stream files whose batches are fixed-size lists of ids and masks.

Documents are range-partitioned by id and sorted; each partition tokenizes its documents, appends
the end id, packs all ids into sequences of equal length and streams them to files of bounded
size.  A batch has two columns, ``ids`` (fixed_size_list<uint16 or int32>[length]) and ``mask``
(fixed_size_list<bool>[length], false on padding), uncompressed, so a memory-mapped reader gets
any sequence without a copy.  Only the last sequence of a partition is padded.

A table of spans says where each document lies: file, first slot in the file, number of tokens,
and the number of ids of all documents before it.  Executors write to the shared folder under a
name of their own and rename when the file is complete, so a lost or repeated task leaves no
half-written file behind and never changes another's.

Null counts as empty (its only id is the end id); very long texts are split at blanks for the
tokenizer, which gives the same ids; rows of one doc_id (null comes first) are kept in the order of the input; an empty table
gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import batches_of, released, shared_dir, written
from graphloom.llm.words import utf8

END_ID = 2
LENGTH = 2048
#: Sequences in a batch, and batches in a file (64 MiB of two-byte ids).
BATCH, FILE_BATCHES = 256, 64
#: Bytes of text encoded at a time, and pieces that a worker remembers.
CHUNK_BYTES, CACHE = 1 << 20, 400_000
#: Of these, pieces that end with marks.
MARKED = 60_000
#: Bytes of text that a worker is sent at a time; both it and the JVM hold a batch, and the JVM while it grows twice.
BATCH_BYTES = CHUNK_BYTES
#: Words encoded in one call, and the longest piece that is remembered.
WORDS, LONGEST = 256, 64
#: The signs that stand for a blank and a line end in the tokens of a byte-level vocabulary.
SIGNS = {" ": "\u0120", "\n": "\u010a"}
#: Marks that may follow a word.
MARKS = ".,;:!?*#$%&|"
_UNSAFE = re.compile(r"\s\s")
_OTHER, _TWO = "\t\r\v\f\x1c\x1d\x1e\x1f", ("  ", "\n\n", " \n", "\n ")
_EDGE = re.compile(r"(?<=\S)(?= )")


def _unsafe(text: str) -> bool:
    """Whether white space follows white space: quickly where a blank and a line end are the only kinds of it."""
    if text.isascii() and not any(x in text for x in _OTHER):
        return any(x in text for x in _TWO)
    return _UNSAFE.search(text) is not None


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    The tokenizer's first step never joins characters across a blank that follows a non-blank, across
    a line end between non-blanks, nor a letter with a mark, so a text's ids are those of its pieces
    cut there; pieces repeat, and each is encoded once.  That holds for byte-level BPE files without normaliser or prefix blank; for
    others, and for texts that hold the string of an added token, the whole text is encoded at once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker a core; threads of its own would only take memory
        self.tokenizer = _tokenizer(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.heads: dict[str, bytes] = {}  # pieces at the head of a text, and marks
        self.marked: list[str] = []  # those in rest that end with marks
        self.rest: dict[str, bytes] = {}  # pieces after a blank, without it, and pieces that begin with a line end or several blanks, in full
        vocabulary = self.tokenizer.get_vocab()
        self.opens = {sep: np.zeros(max(vocabulary.values()) + 1, bool) for sep in SIGNS}  # tokens that begin with a blank or a line end
        for sep, sign in SIGNS.items():
            self.opens[sep][[k for x, k in vocabulary.items() if x.startswith(sign)]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, known: dict[str, bytes], pieces: list[str], before: str) -> None:
        got = self.tokenizer.encode_batch_fast([before + x for x in pieces], add_special_tokens=False)
        known.update((x, array("I", e.ids).tobytes()) for x, e in zip(pieces, got, strict=True))

    def _learn_words(self, words: list[str], sep: str) -> None:
        """Words of letters after a blank or a line end, many in one text: each begins with the one token that has the separator."""
        if not words:
            return
        got = self.tokenizer.encode_batch_fast([sep + sep.join(words[k : k + WORDS]) for k in range(0, len(words), WORDS)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in got])
        raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.opens[sep][ids])).tolist()
        keys = words if sep == " " else [sep + x for x in words]
        self.rest.update((x, raw[a:b]) for x, a, b in zip(keys, cuts, [*cuts[1:], len(raw)], strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.rest) + len(self.heads) > CACHE:
            self.rest.clear()
            self.heads.clear()
            self.marked.clear()
        firsts: list[str | None] = []
        found: list[list[bytes | None]] = []
        holes: list[tuple[list[bytes | None], list[int], list[str]]] = []
        known = self.rest.get
        for text in texts:
            if not self.by_piece or any(x in text for x in self.added):
                firsts.append(None)
                found.append([self.whole(text)])
                continue
            if _unsafe(text):
                pieces = _EDGE.split(text)
                pieces = [pieces[0], *(x if x[1:2].isspace() else x[1:] for x in pieces[1:])]
            else:  # white space stands alone: a line end is a piece's first character
                pieces = text.replace("\n", " \n").split(" ")
            firsts.append(pieces[0])
            ids = list(map(known, pieces))  # the first is put right below
            ids[0] = b""
            at = [k for k, x in enumerate(ids) if x is None]
            if at:
                holes.append((ids, at, [pieces[k] for k in at]))
            found.append(ids)
        missing = {x for _, _, some in holes for x in some}
        marked: dict[str, str] = {}
        words: dict[str, set[str]] = {sep: set() for sep in SIGNS}
        other: dict[str, list[str]] = {" ": [], "": []}
        for x in missing:
            line = x[:1] == "\n"
            stem = x.rstrip(MARKS)
            if (stem[1:] if line else stem).isalpha():
                if stem != x:
                    marked[x] = stem
                if stem not in self.rest:
                    words["\n" if line else " "].add(stem[1:] if line else stem)
            else:
                other["" if line or x[:1] == " " else " "].append(x)
        for sep, some in words.items():
            self._learn_words(list(some), sep)
        for before, some in other.items():
            self._learn(self.rest, some, before)
        ends = {x[len(t) :] for x, t in marked.items()}
        starts = {x for x in firsts if x is not None}
        self._learn(self.heads, [x for x in ends | starts if x not in self.heads], "")
        for x, t in marked.items():
            self.rest[x] = self.rest[t] + self.heads[x[len(t) :]]
        get = self.rest.__getitem__
        for ids, at, some in holes:
            for k, x in zip(at, map(get, some), strict=True):
                ids[k] = x
        for first, ids in zip(firsts, found, strict=True):
            if first is not None:
                ids[0] = self.heads[first]
        out = list(map(b"".join, found))
        self.marked += [x for x in marked if len(x) <= LONGEST]
        if len(self.marked) > MARKED:  # quickly made again; the memory is for words
            for x in self.marked:
                self.rest.pop(x, None)
            self.marked.clear()
        for pieces in (self.rest, self.heads):  # long pieces hardly come again
            for x in [x for x in (starts if pieces is self.heads else missing) if len(x) > LONGEST]:
                pieces.pop(x, None)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """A worker's encoder; its pieces serve all tasks that the worker runs."""
    return Encoder(path)


class SequenceWriter:
    """Packs ids to fixed-length sequences and streams them to files that appear when complete."""

    def __init__(self, uri: str, part: int, length: int, wide: bool):
        self.fs, self.root = pa.fs.FileSystem.from_uri(uri)
        self.part, self.length, self.n, self.own = part, length, 0, uuid.uuid4().hex
        self.kind = pa.int32() if wide else pa.uint16()
        self.dtype = np.int32 if wide else np.uint16
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.rest = np.empty(0, self.dtype)
        self.file, self.batches, self.stream = -1, 0, None
        self.fs.create_dir(self.root, recursive=True)

    def name(self, k: int) -> str:
        return f"part-{self.part:05d}-{k:04d}.arrows"

    @property
    def slots(self) -> int:
        """Ids in one full file."""
        return self.length * BATCH * FILE_BATCHES

    def _open(self) -> None:
        self.file += 1
        self.batches = 0
        self.sink = self.fs.open_output_stream(f"{self.root}/.{self.own}")
        self.stream = pa.ipc.new_stream(self.sink, self.schema)

    def _close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.sink.close()
            self.fs.move(f"{self.root}/.{self.own}", f"{self.root}/{self.name(self.file)}")
            self.stream = None

    def _write(self, ids: np.ndarray, valid: int) -> None:
        if self.stream is None:
            self._open()
        mask = np.arange(len(ids)) < valid
        self.stream.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)],
                schema=self.schema,
            )
        )
        self.batches += 1
        if self.batches == FILE_BATCHES:
            self._close()

    def add(self, ids: np.ndarray) -> None:
        self.rest = np.concatenate((self.rest, ids.astype(self.dtype)))
        size = self.length * BATCH
        while len(self.rest) >= size:
            self._write(self.rest[:size], size)
            self.rest = self.rest[size:]

    def close(self) -> None:
        if len(self.rest):
            valid = len(self.rest)
            self._write(np.concatenate((self.rest, np.zeros(-valid % self.length, self.dtype))), valid)
            self.rest = self.rest[:0]
        self._close()


def write_sequences(docs: DataFrame, tokenizer: str, uri: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Writes the files below uri; returns the spans (doc_id, file, slot, n_tokens, start)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows of one id may fill several ranges, in the order of the input.
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    rows = rows.drop("row").withColumn("part", F.spark_partition_id())
    wide = _tokenizer(tokenizer).get_vocab_size() > 65536 or end_id > 65535

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        encoder, writer, n = _encoder(tokenizer), None, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = batch["part"][0].as_py()
                writer = SequenceWriter(uri, part, length, wide)
            column, lengths, begin = batch["text"], [], 0
            sizes = pa.compute.binary_length(column).to_pylist()
            while begin < len(sizes):  # an MB at a time: the pieces of a text take many times its size
                stop, size = begin, 0
                while stop < len(sizes) and (stop == begin or size + sizes[stop] <= CHUNK_BYTES):
                    size += sizes[stop]
                    stop += 1
                ids = [x + end for x in encoder([x.decode() for x in utf8(column.slice(begin, stop - begin))])]
                writer.add(np.frombuffer(b"".join(ids), "<u4"))
                lengths += [len(x) // 4 for x in ids]
                begin = stop
            counts = np.array(lengths, np.int64)
            first = n + np.cumsum(counts) - counts
            n += int(counts.sum())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.full(len(counts), part, np.int32)), pa.array(first), pa.array(counts)], names=["doc_id", "part", "at", "n_tokens"])
        if writer is not None:
            writer.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    with batches_of(spark, BATCH_BYTES):
        spans = written(rows.mapInArrow(encode, f"doc_id {kind}, part int, at bigint, n_tokens bigint"), f"{uri}/_spans")
    # One row a partition: its window is as small as the number of tasks.
    before = spans.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slots = length * BATCH * FILE_BATCHES
    return spans.join(F.broadcast(before.select("part", "before")), "part").select(
        "doc_id", "part", F.floor(F.col("at") / slots).cast("int").alias("file"), (F.col("at") % slots).alias("slot"), "n_tokens", (F.col("before") + F.col("at")).alias("start")
    )


class SequenceReader:
    """Random access to the sequences of one file by memory map; where the store has none, by a stream of batches."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.source = fs.open_input_file(path) if not isinstance(fs, pa.fs.LocalFileSystem) else pa.memory_map(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = np.concatenate(([0], np.cumsum([b.num_rows for b in self.batches])))
        self.length = self.batches[0].schema.field("ids").type.list_size

    def ids(self, slot: int, n: int) -> Iterator[np.ndarray]:
        """Views of at most n ids from a slot on, up to the file's end."""
        while n > 0 and slot < self.rows[-1] * self.length:
            k = int(np.searchsorted(self.rows, slot // self.length, side="right")) - 1
            flat = self.batches[k]["ids"].flatten().to_numpy()
            at = slot - int(self.rows[k]) * self.length
            view = flat[at : at + n]
            yield view
            slot, n = slot + len(view), n - len(view)


def read_documents(spans: DataFrame, uri: str, length: int = LENGTH) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    root_uri = uri
    slots = length * BATCH * FILE_BATCHES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(root_uri)
        at, reader = None, None
        for batch in batches:
            crcs, counts = [], []
            for part, file, slot, n in zip(*(batch[c].to_pylist() for c in ("part", "file", "slot", "n_tokens")), strict=True):
                crc, got = 0, 0
                while got < n:
                    if at != (part, file):
                        at, reader = (part, file), SequenceReader(fs, f"{root}/part-{part:05d}-{file:04d}.arrows")
                    for view in reader.ids(slot, n - got):
                        crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        got += len(view)
                    file, slot = file + 1, 0
                crcs.append(crc)
                counts.append(got)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    assert slots
    kind = spans.schema["doc_id"].dataType.simpleString()
    # The spans of one written partition stay together and in order, so each file is opened about once.
    return spans.mapInArrow(read, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, tokenizer: str, length: int = LENGTH, uri: str | None = None) -> DataFrame:
    """Write, then read back: doc_id, start, n_tokens, ids_crc32."""
    uri = uri or shared_dir(docs.sparkSession)
    spans = write_sequences(docs, tokenizer, uri, length)
    return read_documents(spans, uri, length)
