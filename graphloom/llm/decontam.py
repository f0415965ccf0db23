"""Benchmark decontamination with an FM-index per training shard.

Benchmark texts become phrases: every run of ``window`` words, or the whole item where it is
shorter.  The phrases are the stated query set: tasks write them to the shared folder in blocks of
bounded size, and every shard is searched for one block after the other, so no document leaves its
task, whatever the number of blocks, and a task holds two blocks at most.

A shard is a bounded number of words of one partition.  Words outside the phrases' vocabulary
cannot be part of an occurrence, so the index covers exactly the runs of vocabulary words that
are as long as the shortest phrase; that loses no occurrence.  The suffixes of these runs are
sorted by prefix doubling, the Burrows-Wheeler transform goes into a wavelet tree, a vectorised
backward search finds the suffix range of every phrase, and suffix positions sampled at every
eighth word and at the head of each run locate the occurrences.  Overlapping occurrences merge
to removal spans.

Nulls and empty texts have no words and are clean.  Repeated rows and repeated or null ids are judged
row by row.  A null item_id counts as empty.  Extra columns are ignored by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir
from graphloom.llm.counts import texts_of
from graphloom.llm.words import ALNUM, split, utf8

WINDOW = 13
#: Words of benchmark text in one block of the query set (about 100 bytes a word in all).
BLOCK_WORDS = 200_000
#: A word, before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text in one shard: its words, hashes and index take some twenty times as many.
SHARD_BYTES = 4 << 20
SAMPLE = 8


@dataclass
class Phrases:
    """Distinct phrases over a vocabulary of word hashes; symbol k + 1 is vocabulary[k], 0 is padding."""

    vocabulary: np.ndarray
    symbols: np.ndarray  # phrases x window
    lengths: np.ndarray
    items: list[list[str]] = field(default_factory=list)  # of each phrase


def phrases(rows: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
    words = split([text for _, text in rows], ALNUM)
    vocabulary = np.unique(words.hashes)
    ids = np.searchsorted(vocabulary, words.hashes) + 1
    found: dict[tuple, dict[str, None]] = {}
    for k, (item, _) in enumerate(rows):
        own = ids[words.first[k] : words.first[k + 1]].tolist()
        for i in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(tuple(own[i : i + window]), {})[item] = None
    symbols = np.zeros((len(found), window), np.int64)
    lengths = np.zeros(len(found), np.int64)
    for k, phrase in enumerate(found):
        symbols[k, : len(phrase)] = phrase
        lengths[k] = len(phrase)
    return Phrases(vocabulary, symbols, lengths, [list(x) for x in found.values()])


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, most significant bit first, with prefix counts."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.bits = list(range(max(1, int(size - 1).bit_length()) - 1, -1, -1))
        self.zeros, self.split_at = [], []
        for bit in self.bits:
            one = (sequence >> bit) & 1
            before = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(one == 0, out=before[1:])
            self.zeros.append(before)
            self.split_at.append(int(before[-1]))
            sequence = np.concatenate((sequence[one == 0], sequence[one == 1]))
        self.begin = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, before, zeros in zip(self.bits, self.zeros, self.split_at, strict=True):
            left = before[at]
            at = np.where((symbol >> bit) & 1, zeros + at - left, left)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(symbol, at) - self.begin[symbol]


class FmIndex:
    """An FM-index over runs of symbols 1..size-1; each run is ended by a 0."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))  # each end is a symbol of its own, so that no comparison passes it
        width = 1
        while True:
            order = np.argsort(rank, kind="stable")
            ranked = rank[order]
            new = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            after = np.zeros(n, np.int64)
            if width < n:
                after[:-width] = rank[width:] + 1
            rank = rank * np.int64(n + 1) + after
            width *= 2
        before = np.where(order > 0, text[order - 1], 0)
        self.transform = before
        self.tree = WaveletTree(before, size)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))[:size]
        head = np.zeros(n, bool)
        head[0] = True
        head[ends[:-1] + 1] = True
        sampled = head | (np.arange(n) % sample == 0)
        self.position = np.where(sampled[order], order, -1)

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [low, high) of each phrase, by backward search."""
        low = np.zeros(len(lengths), np.int64)
        high = np.full(len(lengths), len(self.transform), np.int64)
        for k in range(symbols.shape[1] - 1, -1, -1):
            use = np.flatnonzero((lengths > k) & (low < high))
            c = symbols[use, k]
            low[use] = self.smaller[c] + self.tree.rank(c, low[use])
            high[use] = self.smaller[c] + self.tree.rank(c, high[use])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step left until a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            at = self.position[rows]
            known = at >= 0
            out[todo[known]] = at[known] + steps
            todo, rows = todo[~known], rows[~known]
            c = self.transform[rows]
            rows = self.smaller[c] + self.tree.rank(c, rows)
            steps += 1
        return out


def _kept_runs(ids: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least ``least`` vocabulary words within a text, each ended by 0, and the word of each symbol."""
    n = len(ids)
    inside = ids > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begins = first[:-1][first[:-1] < n]
    opens[begins] = inside[begins]
    run = np.cumsum(opens) - 1
    where = np.flatnonzero(inside)
    long = np.bincount(run[where], minlength=1)[run[where]] >= least if len(where) else np.zeros(0, bool)
    where = where[long]
    if not len(where):
        return np.empty(0, np.int64), where
    own = run[where]
    number = np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
    text = np.zeros(len(where) + number[-1] + 1, np.int64)
    at = np.arange(len(where)) + number
    text[at] = ids[where]
    origin = np.full(len(text), -1, np.int64)
    origin[at] = where
    return text, origin


def search_shard(texts: list[bytes], queries: Iterable[Phrases]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text its number of words, merged hit spans (word offsets, end exclusive) and items found by any of the queries."""
    words = split(texts, ALNUM)
    n = len(words.hashes)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    edge = np.zeros(n + 1, np.int64)
    for query in queries if n else ():
        at = np.minimum(np.searchsorted(query.vocabulary, words.hashes), len(query.vocabulary) - 1)
        ids = np.where(query.vocabulary[at] == words.hashes, at + 1, 0)
        text, origin = _kept_runs(ids, words.first, int(query.lengths.min()))
        if not len(text):
            continue
        index = FmIndex(text, len(query.vocabulary) + 1)
        low, high = index.search(query.symbols, query.lengths)
        count = high - low
        hit = np.flatnonzero(count > 0)
        phrase = np.repeat(hit, count[hit])
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit]) + low[phrase]
        begin = origin[index.locate(rows)]
        owner = np.searchsorted(words.first, begin, side="right") - 1
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + query.lengths[phrase], -1)
        pairs = np.unique(owner * np.int64(len(query.lengths)) + phrase)
        for k, p in zip((pairs // len(query.lengths)).tolist(), (pairs % len(query.lengths)).tolist(), strict=True):
            items[k].update(query.items[p])
    if edge.any():
        covered = np.cumsum(edge[:-1]) > 0
        opens = covered.copy()
        opens[1:] &= ~covered[:-1]
        heads = words.first[:-1][words.first[:-1] < n]
        opens[heads] = covered[heads]
        closes = covered.copy()
        closes[:-1] &= ~covered[1:] | opens[1:]
        for a, b in zip(np.flatnonzero(opens).tolist(), (np.flatnonzero(closes) + 1).tolist(), strict=True):
            k = int(np.searchsorted(words.first, a, side="right")) - 1
            spans[k].append((a - int(words.first[k]), b - int(words.first[k])))
    for k in range(len(texts)):
        yield int(words.first[k + 1] - words.first[k]), spans[k], sorted(items[k])


def write_queries(benchmark: DataFrame, window: int = WINDOW) -> list[str]:
    """Writes the query set to the shared folder, in blocks of about ``BLOCK_WORDS`` words; returns the files.

    Items are cut to parts of at most that many words which share window - 1 words, so no window is lost and none is added.
    """
    uri = shared_dir(benchmark.sparkSession)
    text = F.col("text").cast("string")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text.alias("text"), F.regexp_count(text, F.lit(WORD)).alias("n")).where("n > 0")
    blocks = (items.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS + 1
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)), F.lit(BLOCK_WORDS)), lambda k: F.array_join(F.slice(words, k + 1, F.lit(BLOCK_WORDS + window - 1)), " "))
    parts = items.select("item", F.explode(F.when(F.col("n") <= BLOCK_WORDS, F.array("text")).otherwise(cut)).alias("text"))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))

    def build(table: pa.Table) -> pa.Table:
        fs, root = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        query = phrases(list(zip(table["item"].to_pylist(), utf8(table["text"]), strict=True)), window)
        own, name = f"{root}/.{uuid.uuid4().hex}", f"block-{table['block'][0].as_py():06d}"
        with fs.open_output_stream(own) as sink:
            sink.write(pickle.dumps(query))
        fs.move(own, f"{root}/{name}")
        return pa.table({"name": [name]})

    return [f"{uri}/{r['name']}" for r in parts.groupBy("block").applyInArrow(build, "name string").orderBy("name").collect()]


@lru_cache(maxsize=2)
def _read_query(file: str) -> Phrases:
    fs, path = pa.fs.FileSystem.from_uri(file)
    with fs.open_input_stream(path) as source:
        return pickle.loads(source.read())


def _found(batch: pa.Array, files: list[str]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """The results of all texts, shard by shard; a shard meets the blocks one after the other."""
    for texts in texts_of(batch, SHARD_BYTES):
        yield from search_shard(texts, map(_read_query, files))


FOUND = "struct<n_words:bigint,spans:array<array<bigint>>,items:array<string>>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (merged removal spans in words, end exclusive) and items (ids found, as strings) of each row."""
    files = write_queries(benchmark, window)

    @F.arrow_udf(FOUND)
    def search(text: pa.Array) -> pa.Array:
        n, spans, items = zip(*_found(text, files), strict=True) if len(text) else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], names=["n_words", "spans", "items"]
        )

    return docs.select("doc_id", search(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def judged(scanned: DataFrame, share: int = 20) -> DataFrame:
    """The contract's columns: contaminated where at least one in ``share`` words is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0])
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    files = write_queries(benchmark, window)

    @F.arrow_udf("boolean")
    def contaminated(text: pa.Array) -> pa.Array:
        hit = [(sum(b - a for a, b in spans), n) for n, spans, _ in _found(text, files)]
        return pa.array([h > 0 and share * h >= n for h, n in hit], pa.bool_())

    return docs.where(~contaminated(F.col("text").cast("string")))


def fingerprint(items: list) -> str:
    """The digest of a list of items, as judged() makes it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
