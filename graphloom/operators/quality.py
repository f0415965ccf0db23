"""Quality checks on a metric graph; each check is a query, a report a union of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["betweenness", "pagerank", "bridge_score", "importance", "depth", "effort"]


def long_metrics(nodes: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(id, metric, value) of every metric column."""
    names = [m for m in (metrics or METRICS) if m in nodes.columns]
    return nodes.select("id", *[F.col(m).cast("double").alias(m) for m in names]).unpivot(["id"], names, "metric", "value")


def sums_to_one(nodes: DataFrame, metric: str = "pagerank", tolerance: float = 0.01) -> DataFrame:
    """G1: the metric, its sum, and whether it is 1 within tolerance."""
    total = F.sum(metric)
    return nodes.agg(F.lit(metric).alias("metric"), F.round(total, 6).alias("total"), (F.abs(total - 1) <= tolerance).alias("ok"))


def sequential_components(nodes: DataFrame) -> DataFrame:
    """Whether component ids run from 0 without a gap."""
    return nodes.agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.count_distinct("component_id").alias("n")).select("low", "high", "n", ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("ok"))


def negative_depths(nodes: DataFrame) -> DataFrame:
    """Nodes of negative depth."""
    return nodes.agg(F.count_if(F.col("depth") < 0).alias("n"))


def bad_values(nodes: DataFrame) -> DataFrame:
    """Per metric the values that are missing, NaN or infinite."""
    v = F.col("value")
    return long_metrics(nodes).groupBy("metric").agg(F.count_if(v.isNull()).alias("missing"), F.count_if(F.isnan(v)).alias("nan"), F.count_if(F.abs(v) == float("inf")).alias("infinite"))


def coverage(edges: DataFrame, column: str = "inverse_weight") -> DataFrame:
    """Edges and how many have the column."""
    return edges.agg(F.count("*").alias("edges"), F.count(column).alias("covered"))


def mutual_pairs(edges: DataFrame, kind: str) -> DataFrame:
    """(a, b), a < b, with edges of the kind both ways."""
    e = edges.where(F.col("type") == kind).select("source", "target").distinct()
    return e.alias("x").join(e.alias("y"), (F.col("x.source") == F.col("y.target")) & (F.col("x.target") == F.col("y.source"))).where("x.source < x.target").select(F.col("x.source").alias("a"), F.col("x.target").alias("b"))


def cluster_quality(nodes: DataFrame) -> DataFrame:
    """Clusters, nodes without one, clusters of one node, and 1 - clusters / nodes."""
    sizes = nodes.groupBy("cluster_id").agg(F.count("*").alias("n"))
    known = F.col("cluster_id").isNotNull()
    return sizes.agg(
        F.count_if(known).alias("clusters"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unclustered"), F.count_if(known & (F.col("n") == 1)).alias("singletons"),
        F.round(1 - F.count_if(known) / F.sum("n"), 6).alias("estimate"),
    )


def bridge_quality(nodes: DataFrame, top: int = 10, least: float = 0.1) -> DataFrame:
    """Bridge scores out of [0, 1], positive ones, and the mean score of the nodes of the highest betweenness against a threshold."""
    counts = nodes.agg(F.count_if((F.col("bridge_score") < 0) | (F.col("bridge_score") > 1)).alias("out_of_range"), F.count_if(F.col("bridge_score") > 0).alias("positive"))
    best = nodes.orderBy(F.desc("betweenness"), "id").limit(top).agg(F.round(F.avg("bridge_score"), 6).alias("top_mean"))
    return counts.join(best).withColumn("ok", F.col("top_mean") >= least)


def iqr_outliers(nodes: DataFrame, factor: float = 1.5) -> DataFrame:
    """(id, metric, value) outside the fences; quartiles are the sorted values at n/4 and 3n/4, for n >= 4 and a positive range.

    Ranks come from counts of distinct values, so no task sorts a whole metric.
    """
    values = long_metrics(nodes).where("value is not null")
    counts = values.groupBy("metric", "value").agg(F.count("*").alias("c"))
    total = counts.groupBy("metric").agg(F.sum("c").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("metric").orderBy("value"))
    placed = counts.withColumn("upto", upto).join(total, "metric")
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 4), F.col("value")))
    fences = placed.groupBy("metric", "n").agg(at(1).alias("q1"), at(3).alias("q3")).where("n >= 4 and q3 > q1")
    low, high = F.col("q1") - factor * (F.col("q3") - F.col("q1")), F.col("q3") + factor * (F.col("q3") - F.col("q1"))
    return values.join(F.broadcast(fences), "metric").where((F.col("value") < low) | (F.col("value") > high)).select("id", "metric", "value")  # one row a metric


def sigma_outliers(nodes: DataFrame, k: float = 3.0) -> DataFrame:
    """(id, metric, value) more than k population deviations from the mean."""
    values = long_metrics(nodes).where("value is not null")
    stats = values.groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).where("s > 0")
    return values.join(F.broadcast(stats), "metric").where(F.abs(F.col("value") - F.col("m")) > k * F.col("s")).select("id", "metric", "value")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    return nodes.select("id", "type").join(ends, "id", "left_anti")


def without_edge(nodes: DataFrame, edges: DataFrame, node_type: str, edge_type: str) -> DataFrame:
    """Nodes of a type that are no source of an edge of a type."""
    own = edges.where(F.col("type") == edge_type).select(F.col("source").alias("id"))
    return nodes.where(F.col("type") == node_type).select("id").join(own, "id", "left_anti")


def has_cycle(edges: DataFrame, max_rounds: int = 100_000) -> bool:
    """Whether the directed edges hold a cycle: nodes that nothing points at are peeled off until none is left or none can go."""
    from graphloom.functions.shared import shared_dir, written

    where = shared_dir(edges.sparkSession)
    live = written(edges.select("source", "target").distinct(), f"{where}/0")
    for k in range(1, max_rounds + 1):
        before = live.count()
        if not before:
            return False
        live = written(live.join(live.select(F.col("target").alias("source")).distinct(), "source", "left_semi"), f"{where}/{k}")
        if live.count() == before:
            return True
    raise RuntimeError(f"has_cycle: nodes are still peeled off after {max_rounds} rounds")


def statistics(nodes: DataFrame) -> DataFrame:
    """Per metric min, max, mean, count, population deviation."""
    v = F.col("value")
    return long_metrics(nodes).where(v.isNotNull()).groupBy("metric").agg(F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.count(v).alias("n"), F.round(F.stddev_pop(v), 6).alias("deviation"))


def sizes(nodes: DataFrame) -> DataFrame:
    """(kind, key, n): nodes by component, cluster and type."""
    parts = [nodes.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "key", "n") for k, c in (("component", "component_id"), ("cluster", "cluster_id"), ("type", "type"))]
    return reduce(DataFrame.unionByName, parts)


def status(issues: DataFrame, strict: bool = False) -> DataFrame:
    """Counts by severity and the status of a report; issues: (severity, ...)."""
    critical, warning = F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "warning")
    name = F.when((critical > 0) | (F.lit(strict) & (warning > 0)), "CRITICAL_ISSUES").when(warning > 0, "PASSED_WITH_WARNINGS").otherwise("PASSED")
    return issues.agg(critical.alias("critical"), warning.alias("warnings"), name.alias("status"))


def diagnostics(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, sample: int = 10) -> DataFrame:
    """(kind, entity) of dangling edges and dictionary ids that are not in the graph: the first ``sample`` of each, with the total."""
    ids = nodes.select("id")
    key = F.concat_ws("|", "source", "target", "type")
    loose = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select(key.alias("entity")).union(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select(key)).distinct()
    absent = concepts.select(F.col("concept_id").alias("id")).join(ids, "id", "left_anti").select(F.col("id").alias("entity"))
    parts = []
    for kind, df in (("dangling_edge", loose), ("unknown_concept", absent)):
        parts.append(df.orderBy("entity").limit(sample).join(df.agg(F.count("*").alias("total"))).select(F.lit(kind).alias("kind"), "entity", "total"))
    return parts[0].unionByName(parts[1])


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(severity, check, n) of all checks that fail."""
    one = lambda df, severity, name: df.select(F.lit(severity).alias("severity"), F.lit(name).alias("check"), F.col("n").cast("bigint").alias("n")).where("n > 0")
    count = lambda df: df.agg(F.count("*").alias("n"))
    parts = [
        one(count(sums_to_one(nodes).where("not ok")), "critical", "pagerank_sum"),
        one(count(sequential_components(nodes).where("not ok")), "critical", "component_ids"),
        one(negative_depths(nodes), "critical", "negative_depth"),
        one(count(bad_values(nodes).where("missing + nan + infinite > 0")), "critical", "bad_values"),
        one(count(orphans(nodes, edges)), "warning", "orphans"),
        one(count(iqr_outliers(nodes)), "warning", "iqr_outliers"),
        one(count(sigma_outliers(nodes)), "warning", "sigma_outliers"),
    ]
    return reduce(DataFrame.unionByName, parts)
