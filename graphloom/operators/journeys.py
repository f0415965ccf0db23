"""Demo paths over a graph with metrics: a learning journey (F24) and the way to the hardest node (F26), on shortest paths of many pairs at once.

nodes: id, depth, importance, pagerank, betweenness and (F26) effort; a null metric ranks last.  The journeys are
bounded lists, so their few rows are numbered by one window; everything before the choice is joins and top-k.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written


def between(pairs: DataFrame, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(pair, step, id): for each (pair, start, goal) a path of the fewest edges, from step 0 at the start; no row where there is none.

    All pairs search at once, level by level, from the start and from the goal: each time the side whose open nodes have fewer edges takes
    a step, until a pair's sides meet.  Where paths are equally short, each node's predecessor, from the goal on, is the smallest id.  Then
    all pairs trace back together, one join with each level.  State: a row for each pair and node reached from either side.
    Null ends are no nodes; loops and repeated edges change nothing; a pair from a node to itself is that node.
    """
    where = shared_dir(edges.sparkSession)
    pairs = written(pairs.select("pair", "start", "goal").where("start is not null and goal is not null"), f"{where}/pairs")
    hops = written(edges.where("source <> target").select("source", "target"), f"{where}/hops")
    fronts = {c: written(pairs.select("pair", F.col(c).alias("id")), f"{where}/{c}0") for c in ("start", "goal")}
    sides, seen = {c: [x] for c, x in fronts.items()}, dict(fronts)
    ends = {"start": ("source", "target"), "goal": ("target", "source")}
    met = written(fronts["start"].join(fronts["goal"], ["pair", "id"]).select("pair", "id", F.lit(0).alias("a"), F.lit(0).alias("b")), f"{where}/met0")
    open_ = pairs.select("pair").join(met.select("pair"), "pair", "left_anti")
    degree = {c: written(hops.groupBy(F.col(x).alias("id")).agg(F.count("*").alias("d")), f"{where}/{c}-hops") for c, (x, _) in ends.items()}
    while True:
        done = sum(len(x) - 1 for x in sides.values())
        if done > max_rounds:
            raise RuntimeError(f"between: pairs are still searching after {max_rounds} rounds")
        ahead = {c: fronts[c].join(open_, "pair", "left_semi").join(degree[c], "id").agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0] for c in sides}
        if not min(ahead.values()):
            break
        side = min(sides, key=lambda c: ahead[c])
        other = "goal" if side == "start" else "start"
        front = fronts[side].join(open_, "pair", "left_semi")
        near, far = ends[side]
        step = front.select("pair", F.col("id").alias(near)).join(hops, near).select("pair", F.col(far).alias("id")).where("id is not null").distinct()
        fronts[side] = written(step.join(seen[side], ["pair", "id"], "left_anti"), f"{where}/{side}{len(sides[side])}")
        sides[side].append(fronts[side])
        seen[side] = seen[side].unionByName(fronts[side])
        # Before, no node was on both sides of an open pair; so all that meets now is halfway along a shortest path, and on the other side's outermost level.
        a, b = len(sides["start"]) - 1, len(sides["goal"]) - 1
        new = fronts[side].join(fronts[other], ["pair", "id"]).select("pair", "id", F.lit(a).alias("a"), F.lit(b).alias("b"))
        met = met.unionByName(written(new, f"{where}/met{done + 1}"))
        # A pair one of whose sides reaches nothing new has no path.
        open_ = written(open_.join(fronts[side], "pair", "left_semi").join(met.select("pair"), "pair", "left_anti"), f"{where}/open{done + 1}")
    met = written(met, f"{where}/met")
    lengths = written(met.groupBy("pair").agg(F.max(F.col("a") + F.col("b")).alias("long"), F.max("a").alias("a")), f"{where}/lengths")
    # Of the goal's side, the nodes on shortest paths, from those that met towards the goal: (pair, id, at), at the steps to the goal.
    way = {k: [met.where(F.col("b") == k).select("pair", "id")] for k in range(len(sides["goal"]))}
    for k in range(len(sides["goal"]) - 2, -1, -1):
        from_ = reduce(DataFrame.unionByName, way[k + 1])
        led = from_.select("pair", F.col("id").alias("source")).join(hops, "source").select("pair", F.col("target").alias("id")).distinct()
        way[k].append(written(led.join(sides["goal"][k], ["pair", "id"], "left_semi"), f"{where}/way{k}"))
    # From the goal back: the smallest predecessor on a shortest path, among those halves first and then on the start's side.
    here = written(pairs.join(lengths, "pair").select("pair", F.col("long").alias("step"), F.col("goal").alias("id"), "long", "a"), f"{where}/trace0")
    out, k = here.select("pair", "step", "id"), 0
    while True:
        k += 1
        left = here.where("step > 0")
        before = left.select("pair", "step", "long", "a", F.col("id").alias("target")).join(hops.withColumnRenamed("source", "id"), "target")
        goal_side = reduce(DataFrame.unionByName, [x.select("pair", "id", F.lit(j).alias("j")) for j, parts in way.items() for x in parts])
        start_side = reduce(DataFrame.unionByName, [x.select("pair", "id", F.lit(j).alias("j")) for j, x in enumerate(sides["start"])])
        one = before.where("step > a").withColumn("j", F.col("long") - F.col("step") + 1).join(goal_side, ["pair", "id", "j"], "left_semi")
        two = before.where("step <= a").withColumn("j", F.col("step") - 1).join(start_side, ["pair", "id", "j"], "left_semi")
        here = one.unionByName(two).groupBy("pair", "step", "long", "a").agg(F.min("id").alias("id"))
        here = written(here.select("pair", (F.col("step") - 1).alias("step"), "id", "long", "a"), f"{where}/trace{k}")
        if not here.limit(1).count():
            return out
        out = out.unionByName(here.select("pair", "step", "id"))


def _learning() -> list[Column]:
    return [F.asc_nulls_last("depth"), F.desc_nulls_last("importance"), F.asc("id")]


def _filled(nodes: DataFrame, chosen: DataFrame, least: int, order: list[Column]) -> DataFrame:
    """Nodes (id, role) that bring the chosen ones up to least, the first in the order."""
    short = max(0, least - chosen.count())
    rest = nodes.join(chosen.select("id"), "id", "left_anti").orderBy(*order).limit(short)
    return rest.select("id", F.lit("fill").alias("role"))


def educational_journey(nodes: DataFrame, edges: DataFrame, most: int = 100, least: int = 15) -> DataFrame:
    """(step, id, role): the most important nodes in learning order, joined by shortest paths.

    The 1.5 * ``most`` nodes of the highest importance, and the entry (the most important node of the least depth), stand by depth,
    importance and id; each is joined to the next by a shortest path over the given edges, whose nodes come between (connector), a node
    at its first place only; ``most`` nodes stay.  Fewer than ``least`` are filled up by PageRank, then betweenness.
    """
    where = shared_dir(nodes.sparkSession)
    nodes = nodes.select("id", "depth", "importance", "pagerank", "betweenness").dropDuplicates(["id"])
    entry = nodes.orderBy(*_learning()).limit(1)
    top = nodes.orderBy(F.desc_nulls_last("importance"), "id").limit(ceil(1.5 * most)).unionByName(entry).dropDuplicates(["id"])
    line = Window.orderBy(*_learning())  # at most 1.5 * most + 1 rows
    keys = written(top.select("id", F.row_number().over(line).alias("pair"), F.lead("id").over(line).alias("goal")), f"{where}/keys")
    ways = between(keys.select("pair", F.col("id").alias("start"), "goal"), edges)
    places = keys.select("id", F.col("pair").alias("p"), F.lit(0).alias("s"), F.lit("key").alias("role")).unionByName(
        ways.where("step > 0").select("id", F.col("pair").alias("p"), F.col("step").alias("s"), F.lit("connector").alias("role"))
    )
    first = places.groupBy("id").agg(F.min(F.struct("p", "s")).alias("at"), F.max("role").alias("role")).orderBy("at").limit(most)
    first = written(first.withColumn("step", F.row_number().over(Window.orderBy("at"))).select("step", "id", "role"), f"{where}/first")
    more = _filled(nodes, first, least, [F.desc_nulls_last("pagerank"), F.desc_nulls_last("betweenness"), F.asc("id")])
    more = more.join(nodes, "id").withColumn("step", F.row_number().over(line) + first.count()).select("step", "id", "role")
    return first.unionByName(more)


def dependency_journey(nodes: DataFrame, edges: DataFrame, most: int = 100, least: int = 15) -> DataFrame:
    """(step, id, role): from the first prerequisites to the node of the largest effort (peak).

    Its ancestors are the nodes from which edges (prerequisite to dependant) lead to it; of each depth the most important ones
    represent it, as many as ``most`` / number of depths, at least one; each is joined to the next by a shortest path where there is one.
    Fewer than ``least`` are filled up by betweenness, then PageRank.  All stand by depth, importance and id; ``most`` stay.
    """
    where = shared_dir(nodes.sparkSession)
    nodes = nodes.select("id", "depth", "importance", "pagerank", "betweenness", "effort").dropDuplicates(["id"])
    peak = written(nodes.where("effort is not null").orderBy(F.desc("effort"), "id").limit(1).select("id"), f"{where}/0")
    hops = written(edges.where("source <> target").select("source", "target").distinct(), f"{where}/hops")
    found, frontier, k = peak, peak, 0
    while frontier.limit(1).count():
        k += 1
        back = hops.join(frontier.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id")).distinct()
        frontier = written(back.join(found, "id", "left_anti"), f"{where}/{k}")
        found = found.unionByName(frontier)
    ancestors = written(nodes.join(found, "id", "left_semi"), f"{where}/ancestors")
    each = max(1, most // max(1, ancestors.select("depth").distinct().count()))
    by = Window.partitionBy("depth").orderBy(F.desc_nulls_last("importance"), "id")
    best = ancestors.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= each)
    line = Window.orderBy(*_learning())  # at most a row a depth, or most
    keys = written(best.select("id", F.row_number().over(line).alias("pair"), F.lead("id").over(line).alias("goal")), f"{where}/keys")
    ways = between(keys.select("pair", F.col("id").alias("start"), "goal"), hops)
    role = F.when(F.col("id").isin([r["id"] for r in peak.collect()]), "peak").otherwise("key")
    chosen = keys.select("id", role.alias("role")).unionByName(ways.select("id", F.lit("connector").alias("role")))
    chosen = written(chosen.groupBy("id").agg(F.max("role").alias("role")), f"{where}/chosen")
    more = _filled(nodes, chosen, least, [F.desc_nulls_last("betweenness"), F.desc_nulls_last("pagerank"), F.asc("id")])
    every = nodes.join(chosen.unionByName(more), "id").orderBy(*_learning()).limit(most)
    return every.select(F.row_number().over(line).alias("step"), "id", "role")
