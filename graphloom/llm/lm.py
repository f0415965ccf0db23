"""LM scoring with a weighted backoff automaton.

The model is an n-gram model over all training texts, smoothed by a Dirichlet prior of ``PRIOR``
tokens on the next shorter context, so that the probability of a seen n-gram is
(c(n-gram) + PRIOR * p(suffix)) / (c(context) + PRIOR) and an unseen one costs the context's
failure weight PRIOR / (c(context) + PRIOR) and continues at the shorter context.  Single words
have (c + 1) / (N + V + 1).  All orders sum to one over the V seen tokens and one unseen.

n-grams become states with failure arcs: a state for each seen context, an arc for each seen
n-gram from its context to its longest suffix that is a context, a failure arc to the context
without its first word.  One left-to-right traversal of a text carries the state and adds up the
weights.

The model is as large as the corpus, so no task holds it.  The exchange of ``counts`` adds up the
n-gram counts of all training texts, order by order, and gives each block of texts the totals of
just the n-grams that occur in the block; an n-gram is asked for only where other blocks hold its
first and its last n - 1 words, since else no other block can hold it.  From these the block builds
the part of the automaton that its texts can reach, and traverses it.  Nothing is pruned or sampled.

Null and empty texts consist of the end token alone.  Whole texts are scored; ids may repeat
(each row counts and is scored); an empty table gives an empty result; with no training text the
model is uniform over the one unseen token; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import counts as C
from graphloom.llm.words import mix, split, utf8

ORDER = 2
PRIOR = 100.0
END = np.uint64(0xE4D0F7E07E57A11D)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by the end token, and the texts' offsets."""
    words = split(texts)
    n = np.diff(words.first)
    first = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(first[-1], END, np.uint64)
    at = np.ones(len(out), bool)
    at[first[1:] - 1] = False
    out[at] = words.hashes
    return out, first


def grams(hashes: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k-gram that ends at each position (0 where the text is too short)."""
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    out = [hashes]
    for k in range(2, order + 1):
        h = np.zeros(len(hashes), np.uint64)
        full = np.flatnonzero(place >= k - 1)
        h[full] = mix(out[-1][full - 1] * np.uint64(0xD6E8FEB86659FD93) + hashes[full] + np.uint64(k))
        out.append(np.where(h == 0, 0, h))
    return out


class Block:
    """The grams of a block's texts, order by order: their keys, training counts, and what the corpus says of them."""

    def __init__(self, rows: pa.Table, order: int):
        texts, learn = utf8(rows["text"]), ~np.asarray(rows["held_out"].combine_chunks(), bool)
        hashes, self.first = tokens(texts)
        self.kinds = grams(hashes, self.first, order)
        self.weight = np.repeat(learn, np.diff(self.first)).astype(np.float64)
        self.ids: list[np.ndarray] = []  # by order: a position's gram, -1 where the text is too short
        self.totals: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []

    def ask(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next order's sorted keys, their training counts here, and which may occur in other blocks: those whose first
        and last words do."""
        k = len(self.ids)
        at = np.flatnonzero(self.kinds[k]) if k else np.arange(len(self.kinds[0]))
        keys, where, number = np.unique(self.kinds[k][at], return_index=True, return_inverse=True)
        own = np.bincount(number, weights=self.weight[at], minlength=len(keys)).astype(np.int64)
        ids = np.full(len(self.kinds[0]), -1, np.int64)
        ids[at] = number
        self.ids.append(ids)
        if not k:
            return keys, own, np.ones(len(keys), bool)
        last = at[where]
        return keys, own, self.shared[k - 1][self.ids[k - 1][last - 1]] & self.shared[k - 1][self.ids[k - 1][last]]

    def hear(self, keys: np.ndarray, own: np.ndarray, asked: np.ndarray, answers: pa.Table, parts: int) -> None:
        total, shared = own.copy(), np.zeros(len(keys), bool)
        total[asked], shared[asked] = C.with_answers(keys[asked], own[asked], answers, parts)
        self.totals.append(total)
        self.shared.append(shared)

    def resolve(self, orders: int, answers: pa.Table, parts: int) -> Block:
        kind = np.asarray(answers["k"].combine_chunks()) if answers.num_rows else np.empty(0, int)
        for k in range(orders):
            self.hear(*self.ask(), answers.filter(pa.array(kind == k)), parts)
        return self


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    A state is a seen gram of fewer than order words (its context), the empty one included.  At a text's position the state
    of n words has the arc that is the gram of n + 1 words there, if that is seen; else its failure arc leads to the state
    of n - 1 words.  costs[n][i] is the arc's weight at position i (NaN: no arc), failures[n][i] the weight of the failure
    arc of the state of n words that ends at i.
    """

    def __init__(self, block: Block, n: int, v: int, prior: float):
        order = len(block.ids)
        size = len(block.ids[0])
        self.first, self.order = block.first, order
        count = block.totals[0][block.ids[0]]
        chance = (count + 1) / (n + v + 1)  # of the longest gram so far, by position
        self.count = count
        self.costs, self.failures = [np.log10(chance)], [np.zeros(size)]
        for k in range(1, order):
            at = np.flatnonzero(block.ids[k] >= 0)
            context = block.totals[k - 1][block.ids[k - 1][at - 1]]
            seen = block.totals[k][block.ids[k][at]]
            here = (seen + prior * chance[at]) / (context + prior)
            live = seen > 0
            chance = np.full(size, np.nan)
            chance[at] = here
            cost = np.full(size, np.nan)
            cost[at[live]] = np.log10(here[live])
            self.costs.append(cost)
            fail = np.zeros(size)
            mine = block.ids[k - 1] >= 0
            fail[mine] = np.log10(prior / (block.totals[k - 1][block.ids[k - 1][mine]] + prior))
            self.failures.append(fail)

    def traverse(self) -> np.ndarray:
        """Each text's log10 probability: one pass from left to right that carries the state."""
        out, last = np.empty(len(self.first) - 1), self.order - 1
        for d, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            costs, failures = [c[a:b].tolist() for c in self.costs], [f[a:b].tolist() for f in self.failures]
            known = (self.count[a:b] > 0).tolist()
            state, total = 0, 0.0  # the state's words
            for i in range(b - a):
                cost = costs[state][i]
                while cost != cost:
                    total += failures[state][i - 1]
                    state -= 1
                    cost = costs[state][i]
                total += cost
                if state < last and known[i]:
                    state += 1
            out[d] = total
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def _size(rows: DataFrame, parts: int) -> tuple[int, int]:
    """N and V (distinct) of the training tokens."""

    def send(batches):
        for batch in batches:
            for a, b in C.pieces(C._sizes(batch), 2 * C.BLOCK_BYTES):
                piece = batch.slice(a, b - a).filter(pa.compute.invert(batch["held_out"].slice(a, b - a)))
                hashes, _ = tokens(utf8(piece["text"]))
                keys = np.unique(hashes)
                sent = C.send(0, keys, np.zeros(len(keys), np.int64), parts).drop_columns("block")
                n = np.zeros(sent.num_rows, np.int64)
                n[:1] = len(hashes)
                yield from sent.append_column("n", pa.array(n)).to_batches()

    def distinct(table: pa.Table) -> pa.Table:
        keys = np.concatenate([C.unpack(b.as_py())[0] for b in table["blob"]])
        return pa.table({"v": pa.array([len(np.unique(keys))], pa.int64()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    sent = rows.mapInArrow(send, "part bigint, blob binary, n bigint")
    got = sent.groupBy("part").applyInArrow(distinct, "v bigint, n bigint").agg(F.sum("n"), F.sum("v")).first()
    return int(got[0] or 0), int(got[1] or 0)


def score(docs: DataFrame, training: Column | None = None, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; training: which rows to learn from."""
    test = held_out(F.col("doc_id")) if training is None else ~training
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(test, F.lit(False)).alias("held_out"))
    parts = C.parts_of(C.text_bytes(rows))
    n, v = _size(rows, parts)
    blocks = C.packed(rows)

    def first(table: pa.Table) -> pa.Table:
        keys, own, _ = Block(C.unpacked(table), order).ask()
        return C.send(table["block"][0].as_py(), keys, own, parts)

    def later(k: int):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            keys, own, asked = Block(C.unpacked(table), k + 1).resolve(k, answers, parts).ask()
            return C.send(table["block"][0].as_py(), keys[asked], own[asked], parts)

        return run

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = C.unpacked(table)
        automaton = Automaton(Block(rows, order).resolve(order, answers, parts), n, v, prior)
        count, length = automaton.count, np.diff(automaton.first)
        ends = automaton.first[:-1]
        base = np.add.reduceat(np.log10(count + 1.0), ends) - length * np.log10(n + v + 1.0)
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "held_out": rows["held_out"],
                "n_tokens": pa.array(length, pa.int64()),
                "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), ends), pa.int64()),
                "train_tokens": pa.array(np.full(len(length), n), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(automaton.traverse()),
            }
        )

    known = C.answered(blocks.groupBy("block").applyInArrow(first, C.SENT)).withColumn("k", F.lit(0))
    for k in range(1, order):
        sent = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(later(k), C.SENT)
        known = known.unionByName(C.answered(sent).withColumn("k", F.lit(k)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
