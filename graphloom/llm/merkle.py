"""Merkle manifest of a dataset by butterfly exchange.

A row's leaf is the SHA-256 of its fields, each ``-`` or ``length:value``.  Leaves of a language
stand in the order of doc_id; runs of ``fanout`` nodes become one node until one is left, the
language's subroot; subroots, by language, become the root in the same way.

The leaves lie in aligned blocks of ``fanout ** height``.  A block hashes its own part of the tree
alone.  Then come the rounds of the butterfly: in round r the blocks whose indices differ only in
digit r (base fanout) swap the roots of the subtrees that they have, and each of them hashes the
common ancestor for itself.  After the last round every block holds the whole way from its part to
the root, with all siblings, and there is no pass back down: the leaves of a block meet their own
block's way, nothing else.  The subroots of languages are swapped by the same rounds, between all
blocks of neighbouring languages.  Where a subtree is shorter than its neighbours (the end of a
language) its blocks serve several partners, in turn.  A round moves fanout - 1 digests a block.

Texts are hashed where they are read; only digests and ids are shuffled.  A block is bounded, so a
hot language is many blocks; languages may be as many as rows.

Null fields are ``-``; a null lang is a language of its own, the first; a null doc_id comes first.
Equal ids of a language stand by leaf; fully repeated rows are leaves each.  An empty table has no
rows and no root.  Extra columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written
from graphloom.llm.ordered import numbered

FANOUT = 8
#: A block is the part of the tree below one node of this height.
HEIGHT = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields, as lower-case hex."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts)), 256)


def fold(start: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.arrays_zip(left.alias("a"), right.alias("b")), start, lambda h, s: F.sha2(F.concat(s["a"], h, s["b"]), 256))


def _digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def levels(leaves: list[str], total: int, fanout: int, height: int) -> list[list[str]]:
    """The nodes above a block's leaves, up to its height or the one node of a language with total leaves."""
    out = [leaves]
    while len(out) <= height and total > 1:
        out.append([_digest(out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
        total = -(-total // fanout)
    return out


def _swapped(state: DataFrame, tree: Column, index: str, span: int, fanout: int, several: Column) -> DataFrame:
    """One round: blocks learn the roots of the subtrees beside their own, of span indices each, and hash the node above.

    g numbers all blocks, and a subtree is a range of g.  A block with offset o in a subtree of n blocks sends to the offsets
    o, o + n, ... of each sibling, so every block hears of every sibling once.
    """
    mine = state.withColumn("_tree", tree).withColumn("_sub", F.expr(f"{index} div {span}")).withColumn("_top", F.expr(f"{index} div {span * fanout}"))
    subtrees = mine.groupBy("_tree", "_top", "_sub").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    family = subtrees.groupBy("_tree", "_top").agg(F.collect_list(F.struct("_sub", "lo", "hi")).alias("_kin"))
    mine = mine.join(family, ["_tree", "_top"]).withColumn("_own", F.filter("_kin", lambda k: k["_sub"] == F.col("_sub"))[0])
    offset, n = F.col("g") - F.col("_own.lo"), F.col("_own.hi") - F.col("_own.lo") + 1
    to = mine.select("node", "_sub", offset.alias("_o"), n.alias("_n"), F.explode(F.filter("_kin", lambda k: k["_sub"] != F.col("_sub"))).alias("_to"))
    to = to.where("_to.lo + _o <= _to.hi").select(F.explode(F.expr("sequence(_to.lo + _o, _to.hi, _n)")).alias("_g"), F.struct(F.col("_sub").alias("sub"), "node").alias("_said"))
    heard = to.groupBy("_g").agg(F.array_sort(F.collect_list("_said")).alias("_heard"))
    both = mine.join(heard, F.col("g") == F.col("_g"), "left").withColumn("_heard", F.coalesce("_heard", F.array().cast("array<struct<sub:bigint,node:string>>")))
    before = F.array_join(F.filter("_heard", lambda s: s["sub"] < F.col("_sub"))["node"], "")
    after = F.array_join(F.filter("_heard", lambda s: s["sub"] > F.col("_sub"))["node"], "")
    both = both.withColumn("_a", before).withColumn("_b", after).withColumn("_up", several)
    return both.select(
        *(c for c in state.columns if c not in ("node", "a", "b")),
        F.when(F.col("_up"), F.sha2(F.concat("_a", "node", "_b"), 256)).otherwise(F.col("node")).alias("node"),
        F.when(F.col("_up"), F.concat("a", F.array("_a"))).otherwise(F.col("a")).alias("a"),
        F.when(F.col("_up"), F.concat("b", F.array("_b"))).otherwise(F.col("b")).alias("b"),
    )


def _roots(fanout: int, height: int) -> Callable[[pa.Table], pa.Table]:
    def root(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        top = levels(rows["leaf"].to_pylist(), rows["total"][0].as_py(), fanout, height)[-1][0]
        return pa.table({"tree": rows["tree"].slice(0, 1), "block": rows["block"].slice(0, 1), "total": rows["total"].slice(0, 1), "node": [top]})

    return root


def _ways(fanout: int, height: int, kept: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The leaves of a block with their siblings on the way to the root: inside the block, then as the block heard."""

    def ways(rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows.num_rows
        inside = levels(rows["leaf"].to_pylist(), rows["total"][0].as_py(), fanout, height)
        above = [(block["a"][0].as_py(), block["b"][0].as_py())]  # of the block's one top node, then of each node a level below
        for nodes in reversed(inside[:-1]):
            way = []
            for k in range(len(nodes)):
                run, (a, b) = k - k % fanout, above[k // fanout]
                way.append((["".join(nodes[run:k]), *a], ["".join(nodes[k + 1 : run + fanout]), *b]))
            above = way
        out = {c: rows[c] for c in kept}
        strings = pa.list_(pa.string())
        return pa.table(out | {"left": pa.array([a for a, _ in above], strings), "right": pa.array([b for _, b in above], strings), "subroot": pa.array([block["subroot"][0].as_py()] * n), "root": pa.array([block["root"][0].as_py()] * n)})

    return ways


def manifest(docs: DataFrame, carry: list[str] | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """doc_id, lang, leaf, left and right (texts of the siblings on each level up to the root), subroot, root, and the carried columns."""
    spark = docs.sparkSession
    where = shared_dir(spark)
    kept = ["doc_id", "lang", "leaf", *(carry or [])]
    light = written(docs.withColumn("leaf", leaf([F.col(c) for c in FIELDS])).select(*kept), f"{where}/leaves")
    placed = numbered(light, ["lang"], ["doc_id", "leaf"], f"{where}/placed")
    langs = written(light.groupBy("lang").agg(F.count("*").alias("total")), f"{where}/langs")
    langs = written(numbered(langs, [], ["lang"], f"{where}/numbers").select(F.col("lang").alias("_lang"), "total", F.col("pos").alias("tree")), f"{where}/trees")
    size = fanout**height
    # The languages of a block are one: its rows meet that by the block's own key, not by a hot language's.
    rows = written(placed.join(_keyed(langs, placed, size), (F.col("_lang").eqNullSafe(F.col("lang"))) & (F.col("block") == F.expr(f"pos div {size}"))).drop("_lang"), f"{where}/rows")

    state = rows.groupBy("tree", "block").applyInArrow(_roots(fanout, height), "tree bigint, block bigint, total bigint, node string")
    state = written(state, f"{where}/blocks")
    nothing = F.array().cast("array<string>")
    state = written(numbered(state, [], ["tree", "block"], f"{where}/order").withColumnRenamed("pos", "g").withColumn("a", nothing).withColumn("b", nothing), f"{where}/state")
    n_trees, most = state.select(F.countDistinct("tree"), F.max("block")).first()
    span, k = 1, 0
    while span <= (most or 0):
        nodes = F.ceil(F.ceil(F.col("total") / size) / span)
        state = written(_swapped(state, F.col("tree"), "block", span, fanout, nodes > 1), f"{where}/round{k}")
        span, k = span * fanout, k + 1
    state, span = state.withColumn("subroot", F.col("node")), 1
    while span < n_trees:
        state = written(_swapped(state, F.lit(0), "tree", span, fanout, F.lit(True)), f"{where}/round{k}")
        span, k = span * fanout, k + 1
    ways = state.select("tree", "block", "a", "b", "subroot", F.col("node").alias("root"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", left array<string>, right array<string>, subroot string, root string"
    return rows.groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(_ways(fanout, height, kept), schema)


def _keyed(langs: DataFrame, placed: DataFrame, size: int) -> DataFrame:
    """A row for each language and block: _lang, block, tree, total."""
    return langs.select("_lang", "tree", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(total - 1) div {size}"))).alias("block"))


def tampered_leaf(share: int = 3) -> Column:
    """The leaf with A-Z of the text in lower case where share divides the id's CRC-32, else null."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [lower if c == "text" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % share == 0, leaf(fields))


def audited(docs: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """The manifest's digests, and whether each row, some of them tampered with, still folds to the root."""
    proofs = manifest(docs.withColumn("_tampered", tampered_leaf()), ["_tampered"], fanout, height)
    beside = F.array_join(F.flatten(F.zip_with("left", "right", lambda a, b: F.array(a, b))), "")
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), fold(F.coalesce("_tampered", "leaf"), F.col("left"), F.col("right")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
