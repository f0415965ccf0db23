"""Prefix trie of conversations by adaptive radix trees.

A turn's id is the first 16 bytes of the SHA-256 of its role and text (equal ids of different turns are
not looked for: some 10^-20 at 10^9 turns).  A conversation's key is the ids of its turns, one after
the other; keys stand in the order of their bytes, then of conv_id, and are cut into blocks of
``block`` conversations.  A task builds the adaptive radix tree of its block: nodes hold 4, 16, 48
or 256 children in layouts that grow, and bytes without a branch are compressed into one path.  Only
depths that are whole turns emit nodes of the trie; a compressed path may cross many.

A block knows the last key before it and the first after it, so it counts a node, a child or a
leaf only where the order meets it first (a leaf: last).  Every figure of a node is then a sum over the blocks
that touch it, subtrees included, and no round by depth is needed.  Nodes that reach over a block's
ends (at most two paths a block) are summed up by their id; all others are whole as they are.
Copies of a conversation, or one first turn, however common, are many blocks.  The ids that end at
such a node are hashed as a stream of the blocks' pieces.

Memory: a block of keys, 24 bytes a turn; a conversation's turns are ids only, its texts are hashed
where they are read.  A null turn number comes first; turns of one number stand by their ids; null
roles and texts are empty; repeated rows are turns each; rows of a null conv_id belong to no
conversation.  An empty table has no nodes.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written
from graphloom.llm.ordered import numbered

WIDTH = 16
BLOCK = 1024


class Node:
    """A node of an adaptive radix tree: its compressed path, the conversations that end at its end, and its children.

    Up to 4 and up to 16 children are a sorted byte string with the children beside it; up to 48 are an
    index of 256 places into the children; above, there is a place for each byte.
    """

    __slots__ = ("path", "ends", "size", "keys", "children", "row")

    def __init__(self, path: bytes, row: int):
        self.path, self.row, self.ends = path, row, []
        self.size, self.keys, self.children = 4, bytearray(), []

    def get(self, byte: int) -> Node | None:
        if self.size <= 16:
            k = self.keys.find(byte)
            return self.children[k] if k >= 0 else None
        if self.size == 48:
            k = self.keys[byte]
            return self.children[k - 1] if k else None
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        """Adds the child or puts it in place of the one that is there."""
        if self.size <= 16:
            k = self.keys.find(byte)
            if k >= 0:
                self.children[k] = child
                return
            if len(self.keys) < self.size:
                k = sum(x < byte for x in self.keys)
                self.keys.insert(k, byte)
                self.children.insert(k, child)
                return
            self._grow()
            self.put(byte, child)
        elif self.size == 48:
            if k := self.keys[byte]:
                self.children[k - 1] = child
            elif len(self.children) < 48:
                self.children.append(child)
                self.keys[byte] = len(self.children)
            else:
                self._grow()
                self.put(byte, child)
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            index = bytearray(256)
            for k, byte in enumerate(self.keys):
                index[byte] = k + 1
            self.size, self.keys = 48, index
        else:
            self.children = [self.children[k - 1] if k else None for k in self.keys]
            self.size, self.keys = 256, bytearray()

    def ordered(self) -> list[Node]:
        """The children by their bytes."""
        if self.size <= 16:
            return self.children
        return [c for byte in range(256) if (c := self.get(byte)) is not None]


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def tree(keys: list[bytes]) -> Node:
    """The adaptive radix tree of the keys; a key is any bytes, one may begin another; ends hold the keys' places."""
    root = Node(b"", 0)
    for row, key in enumerate(keys):
        node, at = root, 0
        while at < len(key):
            child = node.get(key[at])
            if child is None:
                leaf = Node(key[at:], row)
                leaf.ends.append(row)
                node.put(key[at], leaf)
                break
            same = _common(child.path, key[at : at + len(child.path)])
            if same < len(child.path):  # the path is cut in two
                upper = Node(child.path[:same], child.row)
                child.path = child.path[same:]
                upper.put(child.path[0], child)
                node.put(upper.path[0], upper)
                child = upper
            node, at = child, at + same
        else:
            node.ends.append(row)
    return root


def _turns(a: bytes, b: bytes | None) -> int:
    """Whole turns that two keys share; -1 where there is no other key."""
    return -1 if b is None else _common(a, b) // WIDTH


def emitted(keys: list[bytes], sizes: list[list[int]], convs: list[int], before: bytes | None, after: bytes | None) -> dict[str, list]:
    """The trie's nodes of a block of keys in order, as columns; before and after are the keys beside the block."""
    left, right = _turns(keys[0], before), _turns(keys[-1], after)
    out: dict[str, list] = {c: [] for c in ("node", "depth", "parent", "up", "conv_id", "n_convs", "n_children", "n_leaves", "all_tokens", "own_tokens", "shared", "ends", "piece")}
    # Enter a tree node (its turns' ids go down), then leave it (the sums go up).  The frame: sums of what hangs below, to be added to.
    top = [0, 0, 0, 0, 0, None]  # conversations, new children, leaves, all, own, smallest id
    stack: list = [(tree(keys), 0, b"\0" * WIDTH, -1, True, True, top, False)]
    while stack:
        node, start, ident, parent, first, last, sums, left_again = stack.pop()
        if not left_again:
            end = start + len(node.path)
            key, made = keys[node.row], []
            for depth in range(0 if start == 0 and not node.path else start // WIDTH + 1, end // WIDTH + 1):
                if depth:
                    ident = hashlib.sha256(ident + key[(depth - 1) * WIDTH : depth * WIDTH]).digest()[:WIDTH]
                place = len(out["node"])
                made.append(place)
                out["node"].append(ident)
                out["depth"].append(depth)
                out["up"].append(parent)
                for c in ("parent", "conv_id", "n_convs", "n_children", "n_leaves", "all_tokens", "own_tokens", "shared", "ends", "piece"):
                    out[c].append(None)
                parent = place
            below = [0, 0, 0, 0, 0, None]
            stack.append((node, made, below, parent, first, last, sums, True))
            children = node.ordered()
            for k, child in enumerate(children):
                stack.append((child, end, ident, parent, first and not node.ends and k == 0, last and k == len(children) - 1, below, False))
            continue
        made, below = start, ident
        if node.ends:
            below[0] += len(node.ends)
            low = convs[node.ends[0]]
            below[5] = low if below[5] is None else min(below[5], low)
        for place in reversed(made):
            depth = out["depth"][place]
            old, more = first and depth <= left, last and depth <= right
            size = sizes[node.row][depth - 1] if depth else 0
            here = node.ends if place == made[-1] else []
            if here and not node.children and not more:
                below[2] += 1
            below[3] += size * below[0]
            below[4] += 0 if old else size
            out["conv_id"][place], out["n_convs"][place], out["n_children"][place], out["n_leaves"][place] = below[5], below[0], below[1], below[2]
            out["all_tokens"][place], out["own_tokens"][place], out["shared"][place] = below[3], below[4], old or more
            if here:
                text = ",".join(str(convs[k]) for k in here)
                if (here[0] == 0 and before == keys[0]) or (here[-1] == len(keys) - 1 and after == keys[-1]):
                    out["piece"][place] = text
                else:
                    out["ends"][place] = hashlib.sha256(text.encode()).hexdigest()
            below[1] = 0 if old else 1
        for k in range(5):
            sums[k] += below[k]
        if below[5] is not None:
            sums[5] = below[5] if sums[5] is None else min(sums[5], below[5])
    for place, up in enumerate(out["up"]):
        out["parent"][place] = out["node"][up] if up >= 0 else None
        out["up"][place] = out["conv_id"][up] if up >= 0 and not out["shared"][up] else None
    return out


_NODES = pa.schema([
    ("block", pa.int64()), ("node", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), ("up", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("all_tokens", pa.int64()), ("own_tokens", pa.int64()), ("shared", pa.bool_()), ("ends", pa.string()), ("piece", pa.string()),
])
_SCHEMA = "block bigint, node binary, depth bigint, parent binary, up bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, all_tokens bigint, own_tokens bigint, shared boolean, ends string, piece string"


def _block(rows: pa.Table, beside: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    other = dict(zip(beside["side"].to_pylist(), beside["key"].to_pylist(), strict=True))
    out = emitted(rows["key"].to_pylist(), rows["sizes"].to_pylist(), rows["conv_id"].to_pylist(), other.get("before"), other.get("after"))
    return pa.table({"block": [rows["block"][0].as_py()] * len(out["node"]), **out}, schema=_NODES)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each node's pieces, which come one after the other; what is kept between batches is one hash."""
    node, digest = None, None
    for batch in batches:
        done: dict[str, list] = {"_node": [], "_ends": []}
        for ident, piece in zip(batch["node"].to_pylist(), batch["piece"].to_pylist(), strict=True):
            if ident == node:
                digest.update(b"," + piece.encode())
                continue
            if node is not None:
                done["_node"].append(node)
                done["_ends"].append(digest.hexdigest())
            node, digest = ident, hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_pydict(done, pa.schema([("_node", pa.binary()), ("_ends", pa.string())]))
    if node is not None:
        yield pa.RecordBatch.from_pydict({"_node": [node], "_ends": [digest.hexdigest()]}, pa.schema([("_node", pa.binary()), ("_ends", pa.string())]))


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), id and size (UTF-8 bytes of the text) of every turn, in the order of its conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    ident = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    light = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", ident.alias("id"), F.octet_length(text).cast("bigint").alias("size"))
    return light.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "id")).alias("place"), "id", "size")


def branched(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation as (conv_id, key, sizes): the first h turns of the family's first conversation, then its own after its first h; h is CRC-32 of the id modulo most."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    turns = turns.withColumn("_h", h).withColumn("_first", F.col("conv_id") - F.col("conv_id") % family)
    own = turns.groupBy("conv_id", "_h", "_first").agg(F.sort_array(F.collect_list(F.when(F.col("place") > F.col("_h"), F.struct("place", "id", "size")))).alias("_own"))
    heads = turns.where((F.col("conv_id") == F.col("_first")) & (F.col("place") < most)).groupBy(F.col("conv_id").alias("_head")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "size"))).alias("_turns"))
    both = own.join(heads, F.col("_first") == F.col("_head"), "left")
    head = F.slice(F.coalesce("_turns", F.array().cast("array<struct<place:int,id:binary,size:bigint>>")), F.lit(1), F.col("_h").cast("int"))
    return keyed(both.select("conv_id", F.concat(head, "_own").alias("_all")))


def keyed(conversations: DataFrame) -> DataFrame:
    """conv_id, key and sizes from _all, the turns in order."""
    # The bytes of a key are put together as hex, which has a join over an array.
    key = F.unhex(F.array_join(F.transform("_all", lambda t: F.hex(t["id"])), ""))
    return conversations.select("conv_id", key.alias("key"), F.transform("_all", lambda t: t["size"]).alias("sizes"))


def trie(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of (conv_id, key, sizes), root included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    where = shared_dir(keys.sparkSession)
    rows = numbered(written(keys, f"{where}/keys"), [], ["key", "conv_id"], f"{where}/order").withColumn("block", F.expr(f"pos div {block}"))
    rows = written(rows, f"{where}/rows")
    last = rows.where(f"pos % {block} = {block - 1}").select((F.col("block") + 1).alias("block"), F.lit("before").alias("side"), "key")
    first = rows.where(f"pos % {block} = 0").select((F.col("block") - 1).alias("block"), F.lit("after").alias("side"), "key")
    filled = rows.groupBy("block").count().select("block")
    beside = written(last.unionByName(first).join(filled, "block", "left_semi"), f"{where}/beside")
    nodes = rows.groupBy("block").cogroup(beside.groupBy("block")).applyInArrow(_block, _SCHEMA)
    nodes = written(nodes, f"{where}/nodes")

    shared = nodes.where("shared")
    summed = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "all_tokens", "own_tokens")]
    whole = shared.groupBy("node", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), *summed, F.max("ends").alias("ends"))
    pieces = shared.where("piece is not null").select("node", "block", "piece").repartition("node").sortWithinPartitions("node", "block")
    hashed = pieces.mapInArrow(_streamed, "_node binary, _ends string")
    whole = written(whole.join(hashed, F.col("node") == F.col("_node"), "left").withColumn("ends", F.coalesce("_ends", "ends")).drop("_node", "_ends"), f"{where}/shared")
    above = whole.select(F.col("node").alias("_node"), F.col("conv_id").alias("_up"))
    whole = whole.join(above, F.col("parent") == F.col("_node"), "left").withColumn("up", F.col("_up"))
    # A block's nodes below a shared one ask the block's own copy of it, so a common parent is no hot key.
    asked = shared.select("block", "node").join(above, F.col("node") == F.col("_node")).select(F.col("block").alias("_block"), "_node", "_up")
    alone = nodes.where("not shared").join(asked, (F.col("block") == F.col("_block")) & (F.col("parent") == F.col("_node")), "left").withColumn("up", F.coalesce("up", "_up"))
    columns = ["conv_id", "depth", "up", "n_convs", "n_children", "n_leaves", "all_tokens", "own_tokens", "ends"]
    out = alone.select(*columns).unionByName(whole.select(*columns))
    return out.select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("all_tokens") - F.col("own_tokens")).alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the branched conversations."""
    return trie(branched(turn_ids(conversations)), block)

