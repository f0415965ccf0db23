"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes (words) are summed by source; targets share ``share`` times all words by weight, stop at
   ``cap`` times a source's size, and the excess is reshared: a water level over the sources in
   the order of cap over weight.
2. A document is a block.  A source's blocks have a fixed random order (MD5 of seed and id).  The
   mix takes whole passes of the source and then blocks from the head of that order up to the
   target; the last block is cut at the word where the target is met.  The order is never sorted
   as a whole: blocks fall into ranges of the hash by source, sums of the ranges give each range's
   offset, and only within a range is there a running sum.
3. Each source's exact number of draws is its quota.  The splitting tree starts from all quotas;
   each node divides its quotas between its halves by a multivariate-hypergeometric draw (one
   conditional hypergeometric draw a source, by inverse distribution function outwards from the
   mode), until each leaf holds one output shard's exact quotas.
4. The k-th draw of a source goes to the shard whose cumulative quota covers k; each shard's draws
   are gathered and shuffled by a hash of the shard's own.

Everything is DataFrame and SQL functions; reruns agree.  Null or empty texts have size 0 and are
never drawn; a null source is a source of its own, the last; repeated rows are blocks of their
own; an empty table gives an empty result; extra columns, whatever their names, are kept by ``mix`` and ``mixed``.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Blocks of a source in one range of the hash, at about; there are 4096 ranges a source at least.
RANGE_BLOCKS = 50_000
#: Words in one output shard, at about, and the least number of levels of the splitting tree (2 ** levels shards).
SHARD_WORDS, LEVELS = 32_000_000, 4
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, keep: bool = True) -> DataFrame:
    """docs' columns (if they are kept) as _row0, _row1, ..., doc_id, size (words), a source key that is never null, and the block's place in the random order."""
    return docs.select(*[docs[c].alias(f"_row{k}") for k, c in enumerate(docs.columns) if keep], "doc_id", "source", "text").withColumns(
        {
            "size": F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint"),
            "_key": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")),
            "_h": F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        }
    ).drop("source", "text")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row a source: _key, source_size, n_blocks (of words), target, passes and rest (words after whole passes)."""
    per = rows.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_blocks"))
    order = Window.orderBy(F.col("_key") == "n", "_key")  # over one row a source
    per = per.withColumn("_n", F.row_number().over(order))
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumns({"_cap": (F.col("source_size") * cap).cast("double"), "_level": F.col("source_size") * cap / F.col("_w"), "_all": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
    rising = Window.orderBy("_level", "_n")
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("_full", before + F.col("_level") * onward <= F.col("_all"))
    whole = Window.partitionBy()
    free = F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(0.0)).over(whole)
    left = F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)
    per = per.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(left * F.col("_w") / free))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("bigint")
    rest = F.greatest(F.lit(0), F.round("target").cast("bigint") - passes * F.col("source_size"))
    return per.select("_key", "_n", "source_size", "n_blocks", "target", passes.alias("passes"), rest.alias("rest"))


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among ``good``: the value at probability u.

    Weights are relative to the mode's and follow from it by ratios; values beyond twelve standard
    deviations carry less than double precision can tell.
    """
    n, k, m = total.cast("double"), good.cast("double"), drawn.cast("double")
    mode = F.least(k, m, F.greatest(F.lit(0.0), m + k - n, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")))
    spread = F.sqrt(F.greatest(F.lit(0.0), m * (k / n) * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0))))
    steps = F.sequence(F.lit(1), F.ceil(spread * 12).cast("int") + 20)
    start = F.struct(mode.alias("up"), F.lit(1.0).alias("wu"), mode.alias("down"), F.lit(1.0).alias("wd"), F.lit(1.0).alias("sum"), F.lit(-1.0).alias("got"))

    def walk(goal: Column | None):
        def step(s: Column, _: Column) -> Column:
            wu = s["wu"] * F.greatest(F.lit(0.0), (k - s["up"]) * (m - s["up"])) / ((s["up"] + 1) * F.greatest(F.lit(1.0), n - k - m + s["up"] + 1))
            wd = F.when(s["down"] > 0, s["wd"] * s["down"] * F.greatest(F.lit(0.0), n - k - m + s["down"]) / ((k - s["down"] + 1) * (m - s["down"] + 1))).otherwise(0.0)
            got = s["got"]
            if goal is not None:
                got = F.when(got >= 0, got).when((wu > 0) & (goal < s["sum"] + wu), s["up"] + 1).when((wd > 0) & (goal < s["sum"] + wu + wd), s["down"] - 1).otherwise(got)
            return F.struct((s["up"] + 1).alias("up"), wu.alias("wu"), (s["down"] - 1).alias("down"), wd.alias("wd"), (s["sum"] + wu + wd).alias("sum"), got.alias("got"))

        return step

    goal = u * F.aggregate(steps, start, walk(None), lambda s: s["sum"])
    got = F.aggregate(steps, start, walk(goal), lambda s: s["got"])
    value = F.when(goal < 1, mode).when(got >= 0, got).otherwise(mode)
    return F.when((total <= 0) | (good <= 0) | (drawn <= 0), F.lit(0)).otherwise(value).cast("bigint")


def splitting_tree(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """From (_n, quota) by source: _n, shard and the range [low, high) of the source's draws that the shard gets."""
    shards = 1 << levels
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("_n", "quota"))).alias("q"))
    node = node.select(F.lit(0).alias("a"), F.col("q._n").alias("names"), F.coalesce(F.col("q.quota"), F.array()).cast("array<bigint>").alias("q"))
    node = node.withColumn("all", F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x))
    bound = lambda at: F.floor(F.col("all") * at / shards)  # noqa: E731  draws before a shard
    width = shards
    for _level in range(levels):
        width //= 2
        node = node.withColumns({"take": (bound(F.col("a") + width) - bound(F.col("a"))).cast("bigint"), "held": F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x)})

        def draw(s: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), F.col("a"), F.lit(width), F.size(s["out"])), F.lit(1 << 52)) / float(1 << 52)
            got = _hypergeometric(s["held"], x, s["take"], u)
            return F.transform(F.array(got), lambda g: F.struct((s["held"] - x).alias("held"), (s["take"] - g).alias("take"), F.concat(s["out"], F.array(g)).alias("out")))[0]

        start = F.struct("held", "take", F.expr("cast(array() as array<bigint>)").alias("out"))
        # The generators keep the draw, which both halves use, from being computed twice.
        node = node.select("names", "all", "a", "q", F.explode(F.array(F.aggregate("q", start, draw, lambda s: s["out"]))).alias("left"))
        halves = F.array(
            F.struct(F.col("a").alias("a"), F.col("left").alias("q")),
            F.struct((F.col("a") + width).alias("a"), F.zip_with("q", "left", lambda p, r: p - r).alias("q")),
        )
        node = node.select("names", "all", F.explode(halves).alias("h")).select("names", "all", "h.a", "h.q")
        if _level == 5 and levels > 8:  # a large tree's lower levels are drawn by several tasks
            node = node.repartition("a")
    leaf = node.select(F.col("a").alias("shard"), F.explode(F.arrays_zip(F.col("names").alias("n"), F.col("q").alias("q"))).alias("z"))
    leaf = leaf.select("shard", F.col("z.n").alias("_n"), F.col("z.q").alias("q"))
    high = F.sum("q").over(Window.partitionBy("_n").orderBy("shard"))
    return leaf.select("_n", "shard", (high - F.col("q")).alias("low"), high.alias("high")).where("high > low")


def levels_of(words: float) -> int:
    """Levels of the splitting tree for so many drawn words."""
    return max(LEVELS, math.ceil(math.log2(max(1.0, words / SHARD_WORDS))))


def mix(docs: DataFrame, levels: int | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, keep: bool = True) -> DataFrame:
    """All rows with doc_id, size, source_size, target, and draws: an array of (pass, shard, words); keep: docs' columns are there as _row0, _row1, ..."""
    light = written(sized(docs, False), shared_dir(docs.sparkSession))  # words are counted once for all that follows
    n, words = light.agg(F.count("*"), F.sum("size")).first()
    levels = levels_of(share * (words or 0)) if levels is None else levels
    digits = max(3, math.ceil(math.log(max(1.0, n / RANGE_BLOCKS), 16)))
    ranged = lambda rows: rows.withColumn("_range", F.substring("_h", 1, digits))
    light = ranged(light)
    rows = ranged(sized(docs)) if keep else light
    goal = targets(light, weights, share, cap)
    inside = Window.partitionBy("_key", "_range").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lambda rows: rows.withColumns({"_sum": F.sum("size").over(inside) - F.col("size"), "_k": F.sum((F.col("size") > 0).cast("bigint")).over(inside) - 1})
    ranked = summed(rows)
    ranges = light.groupBy("_key", "_range").agg(F.sum("size").alias("words"), F.count(F.when(F.col("size") > 0, 1)).alias("blocks"))
    upto = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = ranges.withColumns({"_words0": F.coalesce(F.sum("words").over(upto), F.lit(0)), "_k0": F.coalesce(F.sum("blocks").over(upto), F.lit(0))})
    ranges = ranges.join(goal, "_key")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_words0") - F.col("_sum")))
    # Blocks before the cut: those of the ranges before it, and those of the cut's own range that are.
    at_cut = ranges.where((F.col("_words0") < F.col("rest")) & (F.col("rest") <= F.col("_words0") + F.col("words")))
    placed = summed(light.join(at_cut.select("_key", "_range", "_n", "_words0", "_k0", "rest"), ["_key", "_range"]))
    # A source's draws: its whole passes, and the blocks before the cut.
    cut = placed.groupBy("_n").agg((F.max("_k0") + F.count(F.when((F.col("size") > 0) & (extra > 0), 1))).alias("m"))
    quotas = goal.join(cut, "_n", "left").select("_n", (F.col("passes") * F.col("n_blocks") + F.coalesce("m", F.lit(0))).alias("quota"))
    tree = splitting_tree(quotas, levels).groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("low", "high", "shard"))).alias("cuts"))
    near = lambda x, p: (x["high"] > p * F.col("n_blocks") + F.col("_k0")) & (x["low"] < p * F.col("n_blocks") + F.col("_k0") + F.col("blocks"))
    with_cuts = ranges.join(tree, "_n", "left").select(
        "_key", "_range", "blocks", "_words0", "_k0", "source_size", "n_blocks", "target", "passes", "rest",
        F.filter("cuts", lambda x: reduce(or_, [near(x, p) for p in range(cap + 1)])).alias("cuts"),
    )
    out = ranked.join(with_cuts, ["_key", "_range"])
    spot = lambda p: p * F.col("n_blocks") + F.col("_k0") + F.col("_k")
    shard = lambda p: F.filter("cuts", lambda x: (x["low"] <= spot(p)) & (spot(p) < x["high"]))["shard"]
    drawn = lambda p, words: F.transform(shard(p), lambda s: F.struct(p.alias("pass"), s.alias("shard"), words.alias("words")))
    whole = [F.when((F.col("passes") > p) & (F.col("size") > 0), drawn(F.lit(p).cast("bigint"), F.col("size"))) for p in range(cap)]
    last = F.when((F.col("size") > 0) & (extra > 0), drawn(F.col("passes"), extra))
    none = F.expr("cast(array() as array<struct<pass:bigint,shard:int,words:bigint>>)")
    draws = F.concat(*[F.coalesce(x, none) for x in (*whole, last)])
    return out.select(*[f"_row{k}" for k in range(len(docs.columns)) if keep], "doc_id", "size", "source_size", "target", draws.alias("draws"), "_h")


def taken(mixture: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (the words of all draws that a shard received)."""
    words = F.aggregate("draws", F.lit(0).cast("bigint"), lambda s, d: s + d["words"])
    return mixture.select("doc_id", "size", "source_size", "target", words.alias("taken"))


def mixed(docs: DataFrame, levels: int | None = None, shard: str | None = None) -> DataFrame:
    """One row a draw with docs' columns: each output shard is gathered and shuffled by a hash of its own.

    The text is cut where a draw is partial, and n_chars follows it.  A shard has about ``SHARD_WORDS`` words, so no task
    grows with the input.  shard: the name of a column that tells it.
    """
    out = mix(docs, levels).withColumn("_d", F.explode("draws"))
    at = {c: f"_row{k}" for k, c in enumerate(docs.columns)}
    words = F.regexp_extract_all(at["text"], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    text = F.when(F.col("_d.words") == F.col("size"), F.col(at["text"])).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_d.words").cast("int")), ""))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    placed = out.select(*[new.get(c, F.col(n)).alias(n) for c, n in at.items()], F.col("_d.shard").alias("_shard"), F.xxhash64(F.lit(SEED), "_d.shard", "_h", F.col("_d.pass")).alias("_place"))
    shards = placed.repartition("_shard").sortWithinPartitions("_shard", "_place")
    return shards.select(*[F.col(n).alias(c) for c, n in at.items()], *[F.col("_shard").alias(shard) for _ in range(shard is not None)])
