"""Shortest and easiest paths between two nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written


def easiest_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str, alpha: float = 1.0, beta: float = 0.0, sigma: float = 0.0, max_rounds: int = 100_000) -> DataFrame:
    """(step, id, cost) from start to goal; an edge costs alpha + beta * difficulty(target) + sigma * (1 - weight).

    With beta and sigma 0 it is the path of the fewest steps.  Costs relax round by round; of equal costs the smaller predecessor wins.
    No path: no row.  Rounds go on until no cost falls; max_rounds is a safety limit that raises.
    """
    where = shared_dir(edges.sparkSession)
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    hard = nodes.select(F.col("id").alias("target"), F.coalesce(F.col("difficulty").cast("double"), F.lit(3.0)).alias("d"))
    hops = written(edges.where("source <> target").join(hard, "target").select("source", "target", (alpha + beta * F.col("d") + sigma * (1 - weight)).alias("c")).groupBy("source", "target").agg(F.min("c").alias("c")), f"{where}/hops")
    state = written(nodes.where(F.col("id") == start).select("id", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("pred")), f"{where}/0")
    frontier = state
    for k in range(1, max_rounds + 1):
        step = frontier.join(hops, frontier["id"] == hops["source"]).select(F.col("target").alias("id"), (F.col("cost") + F.col("c")).alias("nc"), F.col("source").alias("np"))
        step = step.groupBy("id").agg(F.min(F.struct("nc", "np")).alias("n"))
        merged = state.join(step, "id", "full")
        better = F.col("n").isNotNull() & (F.col("cost").isNull() | (F.col("n.nc") < F.col("cost") - 1e-12))
        new = written(merged.select("id", F.when(better, F.col("n.nc")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("n.np")).otherwise(F.col("pred")).alias("pred"), better.alias("fresh")), f"{where}/{k}")
        state = new.drop("fresh")
        # A frontier that is no cheaper than the goal cannot improve it.
        reached = state.where(F.col("id") == goal).select(F.col("cost").alias("best"))
        frontier = new.where("fresh").join(reached, how="left").where("best is null or cost < best").select("id", "cost", "pred")
        if frontier.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"easiest_path: costs still fall after {max_rounds} rounds")
    spark = edges.sparkSession
    trace, at = [], goal
    while at is not None:  # one look-up a step of the path
        row = state.where(F.col("id") == at).first()
        if row is None:
            return spark.createDataFrame([], "step int, id string, cost double")
        trace.append((at, row["cost"]))
        at = row["pred"]
    return spark.createDataFrame([(k, i, c) for k, (i, c) in enumerate(reversed(trace))], "step int, id string, cost double")


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str) -> DataFrame:
    """The path of the fewest steps, with the summed difficulty of the nodes after the start."""
    found = easiest_path(nodes, edges, start, goal)
    out = found.join(nodes.select("id", F.coalesce(F.col("difficulty").cast("double"), F.lit(3.0)).alias("d")), "id", "left")
    total = F.sum(F.when(F.col("step") > 0, F.col("d")).otherwise(0.0)).over(Window.orderBy("step"))
    return out.select("step", "id", total.alias("difficulty"))


def ladder_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str, ladder: list[list[str]]) -> DataFrame:
    """The fewest steps over the first set of relations of the ladder that gives a path."""
    found = None
    for k in range(len(ladder)):
        allowed = [t for level in ladder[: k + 1] for t in level]
        found = easiest_path(nodes, edges.where(F.col("type").isin(*allowed)), start, goal)
        if found.limit(1).count():
            break
    return found
