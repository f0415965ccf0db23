"""Vectorised word splitting and hashing for Arrow batches.

Texts stay UTF-8 bytes: lower-casing A-Z, splitting and hashing are numpy operations over one
joined buffer, so no Python object is made per word.  Hashes are 64 bits wide; words of up to
eight bytes never collide with words of their own length, longer ones collide with the usual
probability of a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: 1 for bytes of a word, after lower-casing.
NON_SPACE = bytes(0 if c == 32 or 9 <= c <= 13 else 1 for c in range(256))
ALNUM = bytes(1 if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256))

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S32)) * _K2
    x = (x ^ (x >> _S29)) * _K3
    return x ^ (x >> _S32)


@dataclass
class Words:
    """Words of several texts: hash of each word, and for each text the range of its words."""

    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1 offsets into hashes
    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def _load(words64: np.ndarray, at: np.ndarray) -> np.ndarray:
    shift = (at & 7).astype(np.uint64) << np.uint64(3)
    low = words64[at >> 3] >> shift
    high = words64[(at >> 3) + 1] << (np.uint64(63) - shift) << np.uint64(1)
    return low | high


def hash_ranges(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buffer[start:end] for each pair."""
    words64 = np.frombuffer(buffer + b"\0" * (24 - len(buffer) % 8), "<u8")
    left = ends - starts
    h = mix(left.astype(np.uint64) * _K1)
    at, todo = starts.copy(), None
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while len(left):
        take = np.minimum(left, 8).astype(np.uint64)
        value = _load(words64, at) & (full >> (np.uint64(64) - (take << np.uint64(3))))
        if todo is None:
            h = mix((h ^ value) * _K1)
        else:
            h[todo] = mix((h[todo] ^ value) * _K1)
        more = np.flatnonzero(left > 8)
        todo = more if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def split(texts: list[bytes], word_bytes: bytes = NON_SPACE, hashed: bool = True) -> Words:
    """Lower-case A-Z and split; runs of bytes that word_bytes marks are words."""
    buffer = b"\n".join(texts).translate(LOWER) + b"\n"
    flags = np.frombuffer(b"\0" + buffer.translate(word_bytes) + b"\0", np.int8)
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    first = np.searchsorted(starts, begins)
    return Words(hash_ranges(buffer, starts, ends) if hashed else np.empty(0, np.uint64), first, buffer, starts, ends)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = mix(out * _K1 + hashes[k : k + n])
    return out
