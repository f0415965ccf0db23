"""Corpus-wide counts of hashed items, without a row per item.

Rows are packed into blocks of about ``BLOCK_BYTES`` of text where they lie, whatever their ids, and
a block travels as one compressed row.  A block counts its own distinct items and sends them,
sorted and cut by ranges of the hash, as packed arrays; the task of a range adds up the counts of
all blocks and answers each block with the totals of those of its items that other blocks hold
too.  An item that every document holds costs one entry a block, so no key is hot; ranges grow in
number with the input, so no group grows with it; nothing is pruned.

Answers come in the order of a block's keys, so a block must hold the same rows whenever it is
made: a table is read alike each time, other input should be written first.  An answer carries a
checksum of the keys it was made for, and one that does not fit fails the job.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.words import utf8

BLOCK_BYTES = 4 << 20
#: Bytes of text whose items meet in one range.
RANGE_BYTES = 2 * BLOCK_BYTES
_CODEC = pa.Codec("zstd", 1)
_LENGTH = np.dtype("<u4")


def _squeezed(raw: bytes) -> bytes:
    return np.array([len(raw)], _LENGTH).tobytes() + _CODEC.compress(raw, asbytes=True)


def _expanded(blob: bytes) -> bytes:
    return _CODEC.decompress(blob[4:], decompressed_size=int(np.frombuffer(blob[:4], _LENGTH)[0]), asbytes=True)


def planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers of width bytes as byte planes, which compress well."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel()


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences and a block's own counts, both as byte planes."""
    return _squeezed(planes(np.diff(keys, prepend=np.uint64(0)), 8) + planes(counts, 4))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _expanded(blob)
    n = len(raw) // 12
    return np.cumsum(from_planes(raw[: 8 * n], 8), dtype=np.uint64), from_planes(raw[8 * n :], 4).astype(np.int64)


def parts_of(total_bytes: int) -> int:
    """How many ranges the items of so many bytes of text are cut into."""
    return total_bytes // RANGE_BYTES + 1


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Offsets that cut sorted keys into parts equal ranges of the hash."""
    limits = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, limits), [len(keys)]))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def texts_of(column: pa.Array, most: int) -> Iterator[list[bytes]]:
    """The column's texts as bytes, in lists of at most that many bytes (or of one text), so that no batch is decoded whole; null is empty."""
    for a, b in pieces(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), most):
        yield utf8(column.slice(a, b - a))


def pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together, or one row."""
    begin, ends = 0, np.cumsum(sizes)
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, side="right")))
        yield begin, end
        begin = end


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0)).astype(np.int64)


def packed(docs: DataFrame) -> DataFrame:
    """(block, data): the rows of docs, which has a column text, in blocks of about ``BLOCK_BYTES`` or one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 24, [], 0

        def made() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

        for batch in batches:
            sizes = _sizes(batch)
            for a, b in pieces(sizes, BLOCK_BYTES):
                more = int(sizes[a:b].sum())
                if held and size + more > BLOCK_BYTES:
                    yield made()
                    block, held, size = block + 1, [], 0
                held.append(batch.slice(a, b - a))
                size += more
        if held:
            yield made()

    return docs.mapInArrow(run, "block bigint, data binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The rows of a block."""
    return pa.ipc.open_stream(table["data"][0].as_buffer()).read_all()


SENT = "part bigint, block bigint, blob binary"


def send(block: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """A block's sorted keys and counts, dealt to the ranges."""
    cut = ranges(keys, parts)
    used = np.flatnonzero(np.diff(cut))
    blobs = [pack(keys[cut[p] : cut[p + 1]], counts[cut[p] : cut[p + 1]]) for p in used]
    return pa.table({"part": pa.array(used, pa.int64()), "block": pa.array([block] * len(used), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def answered(sent: DataFrame) -> DataFrame:
    """(block, part, blob): the totals of a block's items in a range, and whether other blocks hold them, in the order of its keys.

    An answer holds numbers alone, since the block knows its keys; ranges that share nothing with other blocks have none.
    """

    def answer(table: pa.Table) -> pa.Table:
        block, part = table["block"].to_pylist(), table["part"][0].as_py()
        got = [unpack(b.as_py()) for b in table["blob"]]
        keys, counts = np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        group = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1]))) - 1
        total = np.bincount(group, weights=counts[order]).astype(np.int64)
        value = np.empty(len(keys), np.int64)
        value[order] = (2 * total + (np.bincount(group) > 1))[group]
        width = 4 if int(value.max()) < 1 << 32 else 8
        out_block, out_blob, begin = [], [], 0
        for b, (k, _) in zip(block, got, strict=True):
            own = value[begin : begin + len(k)]
            if (own & 1).any():
                out_block.append(b)
                out_blob.append(np.array([zlib.crc32(k.tobytes())], _LENGTH).tobytes() + _squeezed(planes(np.where(own & 1, own, 0), width)))
            begin += len(k)
        return pa.table({"block": pa.array(out_block, pa.int64()), "part": pa.array([part] * len(out_block), pa.int64()), "blob": pa.array(out_blob, pa.binary())})

    return sent.groupBy("part").applyInArrow(answer, "block bigint, part bigint, blob binary")


def with_answers(keys: np.ndarray, counts: np.ndarray, answers: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The totals of a block's items, and which of them other blocks hold."""
    out, shared = counts.astype(np.int64), np.zeros(len(keys), bool)
    cut = ranges(keys, parts)
    for part, blob in zip(answers["part"].to_pylist(), answers["blob"].to_pylist(), strict=True):
        a, b = int(cut[part]), int(cut[part + 1])
        if zlib.crc32(keys[a:b].tobytes()) != int(np.frombuffer(blob[:4], _LENGTH)[0]):
            raise RuntimeError("the rows of a block have changed: the input is not read alike each time")
        raw = _expanded(blob[4:])
        value = from_planes(raw, len(raw) // (b - a)).astype(np.int64)
        shared[a:b] = (value & 1).astype(bool)
        out[a:b] = np.where(shared[a:b], value >> 1, out[a:b])
    return out, shared


def totals(blocks: DataFrame, parts: int, items: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The answers to all blocks; items gives the sorted keys and counts of a block's rows."""
    return answered(blocks.groupBy("block").applyInArrow(lambda t: send(t["block"][0].as_py(), *items(unpacked(t)), parts), SENT))
