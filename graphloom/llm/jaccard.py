"""Jaccard join on word n-grams with a prefix tree.

A document's set is its distinct runs of ``WIDTH`` words; two documents link when the Jaccard
similarity is at least 3/4.  Sets are ordered by a global order: document frequency in the whole
corpus (exact, from ``counts.totals``), then hash.  Two linked sets share an n-gram among the
first n - ceil(3n/4) + 1 of each.  N-grams that one document alone holds come first in the order
and can be shared by nobody, so only the rest of that prefix, usually nothing, leaves a document.

1. Documents with equal sets fall into one class (128-bit hash of the set).
2. Prefix n-grams that two or more classes hold make groups of classes; each class first goes
   to one of its groups, then to another, where a prefix tree over whole sets is built and
   traversed: depth first, carrying the overlap that all sets below a node have in common, leaving
   a subtree when the overlap plus what remains of either side cannot reach the bound, or when its
   sets are already connected.  Groups are cut at ``GROUP`` classes here; it is only the first pass.
3. Components of the links contract the classes.  Only n-grams whose classes lie in more than one
   component can still yield a link; for these every pair of classes meets once in a prefix
   tree, groups with equal members once in all, large groups block by block, after a look at the
   prefixes alone has left out the classes without a partner of fitting size and overlap.
4. Components of all links give each class, and so each document, its smallest document.

Only connectivity is computed, so a group of copies costs links in proportion to its size; no
link between components is lost.  Null and empty texts have an empty set and link with nothing;
shorter texts have one n-gram, the whole; repeated and null ids are judged row by row; an empty table gives
an empty result; extra columns are ignored by ``components`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import dropped, shared_dir, written
from graphloom.llm import counts as C
from graphloom.llm.words import mix, shingles, split, utf8
from graphloom.operators.components import connected_components

WIDTH = 5
GROUP = 400


def sets_of(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, concatenated, and offsets."""
    words = split(texts)
    runs = shingles(words.hashes, width)
    out, size = [], np.zeros(len(texts) + 1, np.int64)
    for d in range(len(texts)):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= width:
            own = np.unique(runs[a : b - width + 1])
        elif b > a:
            own = shingles(words.hashes[a:b], b - a)
        else:
            own = np.empty(0, np.uint64)
        out.append(own)
        size[d + 1] = len(own)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(size)


def lead(n: int) -> int:
    """How many n-grams of a set of n, in the global order, a linked set must meet."""
    return n - (3 * n + 3) // 4 + 1 if n else 0


def linked(overlap: int, n: int, m: int) -> bool:
    return 7 * overlap >= 3 * (n + m)


class Trie:
    """A path-compressed prefix tree over sorted sets of small integers, numbered in lexicographic order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())  # as the lists compare
        self.sets = [sets[k] for k in self.order]
        self.sizes = sizes[self.order]
        self.root = self._node(0, len(sets), 0)

    def _node(self, lo: int, hi: int, depth: int):
        """(segment, range of sets, smallest size, most symbols after the segment, children)."""
        first, last = self.sets[lo], self.sets[hi - 1]
        short = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:short] != last[depth:short])
        end = depth + int(differ[0]) if len(differ) else short
        rest = max(len(self.sets[k]) for k in range(lo, hi)) - end
        children = []
        if hi - lo > 1:
            k = lo
            while k < hi:
                if len(self.sets[k]) == end:
                    children.append((self.sets[k][:0], k, k + 1, int(self.sizes[k]), 0, []))
                    k += 1
                    continue
                symbol, j = self.sets[k][end], k + 1
                while j < hi and self.sets[j][end] == symbol:
                    j += 1
                children.append(self._node(k, j, end))
                k = j
        return first[depth:end], lo, hi, int(self.sizes[lo:hi].min()), rest, children

    def links(self, probe: np.ndarray, size: int, universe: int, skip) -> list[int]:
        """The sets linked with the probe; skip(lo, hi): whether nothing is to be found among these sets."""
        has = np.zeros(universe + 1, bool)
        has[probe] = True
        after = np.zeros(universe + 2, np.int64)  # symbols of the probe from a value on
        after[: universe + 1] = np.cumsum(has[::-1])[::-1]
        out, stack = [], [(self.root, 0)]
        while stack:
            (segment, lo, hi, least, rest, children), overlap = stack.pop()
            if skip(lo, hi):
                continue
            remaining = len(probe)
            if len(segment):
                overlap += int(has[segment].sum())
                remaining = int(after[segment[-1] + 1])
            if 7 * (overlap + min(rest, remaining if len(segment) else rest)) < 3 * (least + size):
                continue
            if not children:
                if linked(overlap, int(self.sizes[lo]), size):
                    out.append(lo)
                continue
            stack += [(c, overlap) for c in children]
        return out


def join_group(sets: list[np.ndarray], sizes: np.ndarray, labels: list, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect what is not yet connected; side: only pairs of different sides count."""
    g = len(sets)
    flat = np.concatenate(sets)
    symbols, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    by_frequency = np.lexsort((symbols, -count))  # frequent symbols first: long shared paths
    rank = np.empty(len(symbols), np.int64)
    rank[by_frequency] = np.arange(len(symbols))
    ranked = rank[number]
    cuts = np.cumsum([0, *map(len, sets)])
    ordered = [np.sort(ranked[cuts[k] : cuts[k + 1]]) for k in range(g)]
    trie = Trie(ordered, sizes)
    names = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    root = np.array([names[x] for x in labels])[trie.order]
    sides = None if side is None else side[trie.order]
    out = []
    for y in range(g):

        def skip(lo: int, hi: int, y: int = y) -> bool:
            other = root[lo:hi] != root[y]
            if sides is not None:
                other &= sides[lo:hi] != sides[y]
            return not other.any()

        if skip(0, g):
            continue
        for x in trie.links(trie.sets[y], int(trie.sizes[y]), len(symbols), skip):
            if root[x] != root[y]:
                out.append((trie.order[y], trie.order[x]))
                root[root == root[x]] = root[y]
    return out


SET_SCHEMA = "h bigint, n bigint, cls binary, lead int, shared array<bigint>"


def _hash(docs: DataFrame) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def document_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, h (a hash of the text), n (set size), cls (128-bit hash of the set), lead (how much of shared is prefix) and shared: the
    n-grams that other documents hold too, in global order; empty where the prefix has none of these."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), _hash(docs).alias("h"))
    parts = C.parts_of(C.text_bytes(rows))
    blocks = C.packed(rows)

    def items(table: pa.Table):
        flat, _ = sets_of(utf8(table["text"]), width)
        return np.unique(flat, return_counts=True)

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        table = C.unpacked(packed)
        flat, first = sets_of(utf8(table["text"]), width)
        keys, number, own = np.unique(flat, return_inverse=True, return_counts=True)
        total = C.with_answers(keys, own, answers, parts)[0][number]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(1)))))
        more = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(0x5851F42D4C957F2D)))))
        ns, cls, leads, shared = [], [], [], []
        low, high = sums[first[1:]] - sums[first[:-1]], more[first[1:]] - more[first[:-1]] + np.diff(first).astype(np.uint64)
        for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            n = b - a
            ns.append(n)
            cls.append(low[d].tobytes() + high[d].tobytes())
            f = total[a:b]
            single = int((f == 1).sum())
            k = max(0, lead(n) - single)
            leads.append(k)
            shared.append(flat[a:b][np.argsort(f, kind="stable")[single:]].view(np.int64) if k else np.empty(0, np.int64))
        return pa.table(
            {
                "doc_id": table["doc_id"], "h": table["h"], "n": pa.array(ns, pa.int64()), "cls": pa.array(cls, pa.binary()), "lead": pa.array(leads, pa.int32()),
                "shared": pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, shared)]), pa.array(np.concatenate(shared) if shared else np.empty(0, np.int64))).cast(pa.list_(pa.int64())),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    answers = C.totals(blocks, parts, items)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, {SET_SCHEMA}")


def _links(rows: DataFrame, keys: list[str], sided: bool) -> DataFrame:
    """Links (a, b) between classes from prefix trees over the groups of rows (keys, cls, n, shared, label[, side])."""

    def run(table: pa.Table) -> pa.Table:
        cls = table["cls"].to_pylist()
        if len(cls) < 2:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        sets = [np.asarray(x.values) for x in table["shared"]]
        side = np.array(table["side"].to_pylist()) if sided else None
        pairs = join_group(sets, np.array(table["n"].to_pylist()), table["label"].to_pylist(), side)
        return pa.table({"a": pa.array([cls[i] for i, _ in pairs], pa.binary()), "b": pa.array([cls[j] for _, j in pairs], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(run, "a binary, b binary")


def least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many n-grams the prefixes of two linked sets of n and m have in common at least.

    Of the k common n-grams that come first in the order, the k-th is at place k + n - overlap or before in the one set and
    k + m - overlap in the other, and both prefixes reach the place where k is this bound.
    """
    return (3 * (n + m) + 6) // 7 - np.maximum((3 * n + 3) // 4, (3 * m + 3) // 4) + 1


def partners(n: np.ndarray, labels: np.ndarray, side: np.ndarray, row: np.ndarray, held: np.ndarray, times: np.ndarray, gram: int) -> np.ndarray:
    """Which members of the group of ``gram`` may link with another: of another component and side, of fitting size, with enough
    common prefix n-grams, and ``gram`` the first group in which the two meet.  row, held, times: the members' n-grams and how many
    n-grams each stands for."""
    a, b = n[:, None], n[None, :]
    fits = (4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (labels[:, None] != labels[None, :]) & (side[:, None] != side[None, :])
    if not fits.any():
        return fits.any(1)
    symbols, number, holders = np.unique(held, return_inverse=True, return_counts=True)
    shared = holders > 1
    place = np.cumsum(shared) - 1
    use = shared[number]
    has = np.zeros((len(n), int(shared.sum())), np.float32)
    has[row[use], place[number[use]]] = np.sqrt(times[use])
    fits &= np.rint(has @ has.T) >= least_common(a, b)
    if fits.any():
        before = (has[:, : int((shared & (symbols < gram)).sum())] > 0).astype(np.float32)
        fits &= (before @ before.T) == 0
    return fits.any(1)


def _with_partner(rows: DataFrame) -> DataFrame:
    """The rows (gram, i, j, cls, label, n, held, times, side) that ``partners`` leaves, without n, held and times."""

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return table.slice(0, 0).drop_columns(["n", "held", "times"])
        _, labels = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
        held = table["held"].combine_chunks()
        held = held if isinstance(held, pa.Array) else held.chunk(0)
        times = table["times"].combine_chunks()
        times = times if isinstance(times, pa.Array) else times.chunk(0)
        length = np.diff(held.offsets.to_numpy())
        keep = partners(
            table["n"].to_numpy(), labels, table["side"].to_numpy(), np.repeat(np.arange(table.num_rows), length),
            held.flatten().to_numpy(), times.flatten().to_numpy().astype(np.float64), table["gram"][0].as_py(),
        )
        return table.filter(pa.array(keep)).drop_columns(["n", "held", "times"])

    return rows.groupBy("gram", "i", "j").applyInArrow(run, "gram bigint, i bigint, j bigint, cls binary, label binary, side bigint")


def _open(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (gram, cls, label) of n-grams whose classes lie in more than one component, with members and a 128-bit fingerprint (x, y) of these."""
    marked = heads.select("gram", "cls").join(labels, "cls")
    between = marked.groupBy("gram").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"),
        F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"),
    ).where("lo <> hi")
    return marked.join(between.drop("lo", "hi"), "gram")


def class_links(sets: DataFrame, where: str) -> DataFrame:
    """From the rows of document_sets: (cls, label) for classes in a component of two or more."""
    some = sets.where("lead > 0")
    heads = some.groupBy("cls").agg(F.first(F.slice("shared", F.lit(1), F.col("lead"))).alias("lead_grams")).select("cls", F.explode("lead_grams").alias("gram"))
    several = heads.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
    heads = written(heads.join(several, "gram").select("gram", "cls"), f"{where}/heads")
    classes = some.join(heads.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))
    classes = written(classes, f"{where}/classes")
    labels = classes.select("cls", F.col("cls").alias("label"))
    # First pass: each class in the smallest and in the largest group it is in, cut to bounded size.
    groups = _open(heads, labels)
    pick = F.struct("members", F.xxhash64("gram").alias("h"), "gram")
    home = groups.groupBy("cls", "label").agg(F.min(pick).alias("x0"), F.max(pick).alias("x1")).select("cls", "label", F.explode(F.array("x0", "x1")).alias("x")).distinct()
    home = written(home.select("cls", "label", F.col("x.gram").alias("gram"), F.ceil(F.col("x.members") / GROUP).alias("parts")), f"{where}/home")
    # Three classes of a group that is cut are in all its parts, so that a group of near copies stays in one piece.
    cut = home.where("parts > 1").groupBy("gram").agg(F.max("parts").alias("parts"), *[F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "label")).alias(f"l{k}") for k in range(3)])
    heads_of = cut.select("gram", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "l0", "l1", "l2").select("gram", "part", F.explode(F.array("l0", "l1", "l2")).alias("l"))
    home = home.select("cls", "label", "gram", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"))
    home = home.unionByName(heads_of.select("l.cls", "l.label", "gram", "part")).distinct()
    links = written(_links(home.join(classes, "cls"), ["gram", "part"], False), f"{where}/links")
    names = connected_components(links).withColumnRenamed("node", "cls")
    labels = written(classes.select("cls").join(names, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label")), f"{where}/labels")
    # Second pass: what is left between components, each distinct set of members once.
    left = written(_open(heads, labels), f"{where}/open")
    once = left.groupBy("members", "x", "y").agg(F.min("gram").alias("gram"), F.count("*").alias("times"))
    rows = left.join(once.select("gram", "times"), "gram").select("gram", "times", "members", "cls", "label")
    held = rows.groupBy("cls").agg(F.collect_list(F.struct("gram", "times")).alias("h")).select("cls", F.col("h.gram").alias("held"), F.col("h.times").alias("times"))  # at most a prefix
    rows = rows.drop("times")
    # The component with the most members of a group, and how many others there are.
    main = rows.groupBy("gram", "label").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max(F.struct("c", "label")).alias("m")).select("gram", F.col("m.c").alias("c"), F.col("m.label").alias("main"))
    rows = rows.join(main, "gram").join(held, "cls").join(classes.select("cls", "n"), "cls").withColumn("own", F.xxhash64("cls"))
    # A group mostly of one component: its parts meet all others, and not each other.  Else blocks i and j of a large group meet in
    # group (gram, i, j).  Small groups are one part.
    lop = (F.col("members") - F.col("c")) <= GROUP
    parts = F.when(lop, F.ceil(F.col("c") / GROUP)).otherwise(F.ceil(F.col("members") / GROUP))
    rows = rows.withColumn("lop", lop).withColumn("parts", parts).withColumn("part", F.pmod("own", F.col("parts")))
    each = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    pair = lambda i, j: F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"))
    met = (
        F.when(F.col("lop") & (F.col("label") == F.col("main")), F.array(pair(F.col("part"), F.col("part"))))
        .when(F.col("lop"), F.transform(each, lambda k: pair(k, k)))
        .otherwise(F.transform(each, lambda k: pair(F.least(k, "part"), F.greatest(k, "part"))))
    )
    rows = rows.withColumn("p", F.explode(met)).select("gram", "p.i", "p.j", "cls", "label", "n", "held", "times", F.when(F.col("p.i") == F.col("p.j"), F.monotonically_increasing_id()).otherwise(F.col("part")).alias("side"))
    rows = _with_partner(rows)
    second = written(_links(rows.join(classes, "cls"), ["gram", "i", "j"], True), f"{where}/links2")
    return connected_components(links.unionByName(second)).withColumnRenamed("node", "cls")


def _members(docs: DataFrame, width: int, where: str) -> DataFrame:
    """doc_id, h, n, component_id and first, the component's row that stays (null: the row is alone), for every row; reads tables below where."""
    sets = written(document_sets(docs, width), f"{where}/sets")
    labels = class_links(sets, where)
    light = sets.select("doc_id", "h", "n", F.when(F.col("lead") > 0, F.col("cls")).alias("cls"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = light.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.min(row).alias("first"))
    least = least.join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "low", "first")
    lowest = least.groupBy("label").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    found = least.select("cls", "label").join(lowest, "label").select("cls", "component_id", "first")
    return light.join(found, "cls", "left").select("doc_id", "h", "n", F.coalesce("component_id", "doc_id").alias("component_id"), "first")


def components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return _members(docs, width, shared_dir(docs.sparkSession)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of each component stays, that of the smallest id (then the smallest hash of the text); all columns stay.

    Rows are told apart by id and text; of rows that repeat both, one stays.  Rows without words all stay.
    """
    spark, where = docs.sparkSession, shared_dir(docs.sparkSession)
    members = written(_members(docs, width, where), shared_dir(spark))
    dropped(spark, where)
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))
    linked_rows = members.where("first is not null").withColumn("stays", stays)
    gone = linked_rows.where("not stays").select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")).distinct()
    again = linked_rows.where("stays").groupBy(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")).count().where("count > 1").drop("count")
    same = lambda side: docs["doc_id"].eqNullSafe(side["_gone"]) & (_hash(docs) == side["_h"])
    if again.isEmpty():
        return docs.join(gone, same(gone), "left_anti")
    both = gone.unionByName(again)
    once = docs.join(both, same(both), "left_anti")
    number = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(1)))
    row = F.struct(*[docs[c] for c in docs.columns])
    repeated = docs.join(again, same(again), "left_semi").select(row.alias("r"), F.col("doc_id").alias("_id"), _hash(docs).alias("_hash")).withColumn("_k", number)
    return once.unionByName(repeated.where("_k = 1").select("r.*"))
