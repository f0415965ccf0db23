"""Graph rounds over blocks of edges: edges lie packed in the shared folder, a value a node is broadcast, and a task sends back only what changes.

Nodes are numbered from 0 in the order of their names.  Edges travel once, when they are numbered and packed into blocks of about
``BLOCK``; a round is one job that reads the blocks, and nothing of it is shuffled.  What the driver holds and broadcasts is some 12
bytes a node, so this is for at most ``NODES`` nodes (about 200 MB); callers go by rounds of joins beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shared import written

NODES = 16_000_000
#: Edges of a block, and of the blocks whose forests the driver merges at a time.
BLOCK, WAVE = 1_000_000, 16_000_000
PACKED = "block bigint, m bigint, a binary, b binary, w binary"
ANSWER = "v binary, x binary"


def ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32)


def floats(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64)


def named_ends(names: DataFrame, edges: DataFrame, *more: Column) -> DataFrame:
    """(a, b, *more): edges between named nodes (id, rank) by their numbers; those with another end are left out."""
    end = lambda c, n: names.select(F.col("id").alias(c), F.col("rank").cast("int").alias(n))
    return edges.join(end("source", "a"), "source").join(end("target", "b"), "target").select("a", "b", *more)


def packed(edges: DataFrame, where: str, by_node: bool = False) -> DataFrame:
    """Edges (a, b[, w]) as written blocks; by_node: all edges of a node a are in one block, which are sorted by (a, b)."""
    weighted = "w" in edges.columns
    if by_node:
        edges = written(edges, f"{where}-rows")
        edges = edges.repartition(max(1, -(-edges.count() // BLOCK)), "a")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, have, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            a, b = (np.concatenate([x[i] for x in have]).astype(np.int32) for i in (0, 1))
            w = np.concatenate([x[2] for x in have]).astype(np.float64) if weighted else np.zeros(0)
            if by_node:
                order = np.lexsort((b, a))
                a, b, w = a[order], b[order], w[order] if weighted else w
            return pa.RecordBatch.from_pydict({"block": [name], "m": [len(a)], "a": [a.tobytes()], "b": [b.tobytes()], "w": [w.tobytes()]}, pa.schema([("block", pa.int64()), ("m", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("w", pa.binary())]))

        for batch in batches:
            have.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= BLOCK and not by_node:
                yield block()
                name, have, size = name + 1, [], 0
        if size:
            yield block()

    return written(edges.mapInArrow(pack, PACKED), where)


def asked(blocks: DataFrame, f: Callable[..., tuple[np.ndarray, np.ndarray] | None], *state: np.ndarray, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """f(a, b, w, *state) of each block, together: numbers of nodes and their new values, of one kind."""
    sent = blocks.sparkSession.sparkContext.broadcast(state)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in zip(batch["a"], batch["b"], batch["w"], strict=True):
                got = f(ints(a.as_py()), ints(b.as_py()), floats(w.as_py()), *sent.value)
                if got is not None and len(got[0]):
                    yield pa.RecordBatch.from_pydict({"v": [got[0].astype(np.int32).tobytes()], "x": [got[1].astype(kind).tobytes()]}, pa.schema([("v", pa.binary()), ("x", pa.binary())]))

    rows = blocks.mapInArrow(ask, ANSWER).toArrow()
    sent.destroy()
    v = [ints(x.as_py()) for x in rows["v"]]
    x = [np.frombuffer(y.as_py(), kind) for y in rows["x"]]
    return (np.concatenate(v), np.concatenate(x)) if v else (np.zeros(0, np.int32), np.zeros(0, kind))


def looked_up(rows: DataFrame, values: np.ndarray, name: str) -> DataFrame:
    """(id, name): the value of each row (id, rank), by its number."""
    sent = rows.sparkSession.sparkContext.broadcast(values)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sent.value[batch["rank"].to_numpy(zero_copy_only=False)], pa.int32())], names=["id", name])

    return rows.select("id", "rank").mapInArrow(look, f"id {rows.schema['id'].dataType.simpleString()}, {name} int")


def joined(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest of its component under the links u - v."""
    label = np.arange(n, dtype=np.int32)
    while True:
        lu, lv = label[u], label[v]
        apart = lu != lv
        if not apart.any():
            return label
        u, v, lu, lv = u[apart], v[apart], lu[apart], lv[apart]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def components(blocks: DataFrame, n: int, within: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the smallest node of its component; within: only edges whose ends have the same value count.

    Each block links the components that are known so far and sends the forest of its links; the driver merges the forests of a wave of
    blocks, so what it gets at a time is bounded, and later waves find most ends joined.
    """
    label = np.arange(n, dtype=np.int32)
    rows = sorted(tuple(r) for r in blocks.select("block", "m").collect())

    def forest(a, b, _, label, *same):
        if same:
            inside = same[0][a] == same[0][b]
            a, b = a[inside], b[inside]
        u, v = label[a], label[b]
        apart = u != v
        ends, at = np.unique(np.concatenate((u[apart], v[apart])), return_inverse=True)
        root = ends[joined(at[: len(at) // 2], at[len(at) // 2 :], len(ends))]
        return ends[root < ends], root[root < ends]

    begin = 0
    while begin < len(rows):
        stop, size = begin, 0
        while stop < len(rows) and (stop == begin or size + rows[stop][1] <= WAVE):
            size, stop = size + rows[stop][1], stop + 1
        some = blocks.where(F.col("block").between(rows[begin][0], rows[stop - 1][0]))
        u, v = asked(some, forest, label, *([] if within is None else [within]))
        label = joined(u, v, n)[label]
        begin = stop
    return label


def _moves(resolution: float, total: float, odd: bool):
    """The nodes that gain by another community, and that one; as communities' rounds of joins have it."""

    def moves(a, b, w, com, size):
        if not len(a):
            return None
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        own, k_own, low = a[first], np.add.reduceat(w, first), int(a[0])
        k = np.zeros(int(a[-1]) - low + 1)
        k[own - low] = k_own
        other = a != b
        a, to, w = a[other], com[b[other]], w[other]
        if not len(a):
            return None
        order = np.lexsort((to, a))
        a, to, w = a[order], to[order], w[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (to[1:] != to[:-1])])
        a, to, links = a[first], to[first], np.add.reduceat(w, first)
        ka, here = k[a - low], to == com[a]
        gain = links - resolution * ka * (size[to] - np.where(here, ka, 0.0)) / total
        k_com = com[own]
        stay = np.zeros(len(k))
        stay[own - low] = -resolution * k_own * (size[k_com] - k_own) / total
        stay[a[here] - low] = gain[here]
        side = (to < com[a]) if odd else (to > com[a])
        a, to, gain = a[side], to[side], gain[side]
        if not len(a):
            return None
        order = np.lexsort((to, -np.round(gain, 9), a))
        a, to, gain = a[order], to[order], gain[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        better = np.maximum.reduceat(gain, first) > stay[a[first] - low] + 1e-9
        return a[first][better], to[first][better]

    return moves


def communities(blocks: DataFrame, n: int, where: str, resolution: float, rounds: int, levels: int) -> np.ndarray:
    """For each of n nodes the smallest member of its modularity community; blocks: both directions of each edge, by node."""

    def strength(a, b, w):
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        return a[first], np.add.reduceat(w, first)

    member, named = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
    for level in range(levels):
        k = np.zeros(n)
        v, x = asked(blocks, strength, kind=np.float64)
        k[v] = x
        total = float(k.sum())
        if not total:
            break
        com, changed = np.arange(n, dtype=np.int32), False
        for r in range(1, rounds + 1):
            size = np.bincount(com, weights=k, minlength=n)
            v, to = asked(blocks, _moves(resolution, total, r % 2 == 1), com, size)
            com[v] = to
            changed |= len(v) > 0
            if not len(v) and r > 1:
                break
        com = components(blocks, n, com)
        member = com[member]
        kept, place = np.unique(com, return_inverse=True)
        place = place.astype(np.int32)
        member, named = place[member], named[kept]
        if not changed or level == levels - 1:
            break
        blocks = packed(_merged(blocks, place), f"{where}/g{level + 1}", by_node=True)
        n = len(kept)
    return named[member]


def _merged(blocks: DataFrame, place: np.ndarray) -> DataFrame:
    """(a, b, w): the graph of the communities ``place`` of the nodes, weights added, within a block first."""
    sent = blocks.sparkSession.sparkContext.broadcast(place)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, z in zip(batch["a"], batch["b"], batch["w"], strict=True):
                a, b, w = sent.value[ints(x.as_py())], sent.value[ints(y.as_py())], floats(z.as_py())
                order = np.lexsort((b, a))
                a, b, w = a[order], b[order], w[order]
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.add.reduceat(w, first))], names=["a", "b", "w"])

    return blocks.mapInArrow(merge, "a int, b int, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
