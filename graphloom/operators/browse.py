"""Merging, search and browsing of graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import ontology as O


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K1, K2: the rows of both by key; the new row wins; _state: added, updated or kept."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    out = both.withColumns({"_has_old": F.min("_new").over(w) == 0, "_rn": F.row_number().over(w.orderBy(F.desc("_new"), F.hash(*[c for c in old.columns])))}).where("_rn = 1")
    state = F.when(F.col("_new") == 0, "kept").when(F.col("_has_old"), "updated").otherwise("added")
    return out.withColumn("_state", state).drop("_new", "_has_old", "_rn")


def upsert_counts(merged: DataFrame) -> DataFrame:
    """K1, K2: added, updated, total."""
    return merged.agg(F.count_if(F.col("_state") == "added").alias("added"), F.count_if(F.col("_state") == "updated").alias("updated"), F.count("*").alias("total"))


def load_status(nodes: DataFrame, edges: DataFrame, metrics: list[str]) -> DataFrame:
    """K3: one row: nodes, edges, node types, metrics that no node has, and whether the graph can be shown."""
    known = [F.when(F.count(c) == 0, F.lit(c)) for c in metrics if c in nodes.columns]
    absent = [F.lit(c) for c in metrics if c not in nodes.columns]
    out = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("type").alias("types"), F.array_compact(F.array(*known, *absent)).alias("missing"))
    return out.join(edges.agg(F.count("*").alias("edges"))).withColumn("ready", (F.col("nodes") > 0) & (F.size("missing") == 0))


def search_nodes(nodes: DataFrame, text: str, types: list[str]) -> DataFrame:
    """K4: nodes of the types with the text in id, name or definition, case-insensitively, with shown and total."""
    low = text.lower()
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(low)) for c in ("id", "name", "definition")])
    shown = nodes.where(F.col("type").isin(*types) & hit).select("id", "type", "name")
    return shown.join(nodes.agg(F.count("*").alias("total"))).join(shown.agg(F.count("*").alias("shown")))


def browse_order(nodes: DataFrame) -> DataFrame:
    """K5: by cluster, concepts first by name, then position."""
    concept = F.col("type") == "Concept"
    return nodes.orderBy(F.coalesce("cluster_id", F.lit(-1)), (~concept).cast("int"), F.when(concept, F.col("name")), "pos", "id")


def incident(edges: DataFrame, ids: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """K6: (id, direction, other, type, rank) of the edges at the given nodes, by rank of the relation."""
    spark = edges.sparkSession
    order = ranks or {t: k for k, t in enumerate(O.ONTOLOGY)}
    rank = spark.createDataFrame(list(order.items()), "type string, rank int")
    out = edges.join(ids.select(F.col("id").alias("source")), "source").select(F.col("source").alias("id"), F.lit("out").alias("direction"), F.col("target").alias("other"), "type")
    back = edges.join(ids.select(F.col("id").alias("target")), "target").select(F.col("target").alias("id"), F.lit("in").alias("direction"), F.col("source").alias("other"), "type")
    return out.unionByName(back).join(F.broadcast(rank), "type", "left").withColumn("rank", F.coalesce("rank", F.lit(99)))


def top_nodes(nodes: DataFrame, metrics: list[str], k: int = 5) -> DataFrame:
    """K7: (metric, place, id): the k best of each metric, each a top-k that no task sorts as a whole."""
    parts = []
    for m in metrics:
        best = nodes.select("id", F.col(m).alias("v")).orderBy(F.desc("v"), "id").limit(k)
        parts.append(best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("v"), "id"))).select(F.lit(m).alias("metric"), "place", "id"))
    return reduce(DataFrame.unionByName, parts)


def dictionary(concepts: DataFrame, index: DataFrame) -> DataFrame:
    """K8: concept_id, term, mentions; alphabetical."""
    return concepts.select("concept_id", "term").join(index.select("concept_id", "n"), "concept_id", "left").select("concept_id", "term", F.coalesce("n", F.lit(0)).alias("mentions")).orderBy("term", "concept_id")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K9: (kind, key, n): nodes by type, edges by type, components, clusters."""
    count = lambda df, kind: df.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    one = lambda c, kind: nodes.agg(F.count_distinct(c).alias("n")).select(F.lit(kind).alias("kind"), F.lit("all").alias("key"), "n")
    return reduce(DataFrame.unionByName, [count(nodes, "node"), count(edges, "edge"), one("component_id", "component"), one("cluster_id", "cluster")])


# The categories of relations.
CATEGORIES = {
    "causal": ["IMPROVES", "DEGRADES", "CAUSES", "MITIGATES", "HAS_FAILURE_MODE", "REQUIRES_CONDITION"],
    "structural": ["SYNTHESIZED_BY", "CHARACTERIZED_BY", "APPLIED_IN", "REQUIRES_EQUIPMENT", "USES_FEEDSTOCK"],
    "economic": ["IMPACTS_COST", "HAS_REGULATION"],
    "analogy": ["ANALOGOUS_TO", "SUBSTITUTE_FOR"],
    "taxonomic": ["SUBCLASS_OF"],
    "verification": ["TESTED_BY", "CONFIRMS", "REFUTES"],
    "provenance": ["SUPPORTED_BY", "MENTIONS", "RELATED_TO"],
    "educational": ["PREREQUISITE", "TESTS", "ELABORATES", "EXAMPLE_OF", "PARALLEL", "REVISION_OF", "HINT_FORWARD", "REFER_BACK"],
}


def categories(edges: DataFrame) -> DataFrame:
    """(category, types, n): edges by category of relation; unknown ones are 'unknown'."""
    table = edges.sparkSession.createDataFrame([(t, c) for c, ts in CATEGORIES.items() for t in ts], "type string, category string")
    out = edges.join(F.broadcast(table), "type", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    return out.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.count("*").alias("n"))


def by_depth(nodes: DataFrame) -> DataFrame:
    """(depth, n, first): nodes by depth, missing as 0."""
    return nodes.groupBy(F.coalesce("depth", F.lit(0)).alias("depth")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def bridge_nodes(nodes: DataFrame, least: float = 0.7, colors: int = 12) -> DataFrame:
    """Nodes with a bridge score above ``least``, and their cluster's palette index."""
    return nodes.where(F.col("bridge_score") > least).select("id", "cluster_id", (F.col("cluster_id") % colors).alias("color"))


def shared_concepts(mentions: DataFrame) -> DataFrame:
    """(concept_id, graphs, n): concepts of two or more graphs; mentions: (graph, concept_id)."""
    return mentions.groupBy("concept_id").agg(F.array_join(F.array_sort(F.collect_set("graph")), ",").alias("graphs"), F.count_distinct("graph").alias("n")).where("n > 1")


def merged_edges(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with the endpoints that aliases (id, master) name redirected, self-loops dropped, each (source, target, type) once."""
    out = edges
    for end in ("source", "target"):
        out = out.join(aliases.select(F.col("id").alias(end), F.col("master").alias("_m")), end, "left").withColumn(end, F.coalesce("_m", end)).drop("_m")
    w = Window.partitionBy("source", "target", "type").orderBy("pos")
    return out.where("source <> target").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def soft_deleted(nodes: DataFrame, edges: DataFrame, cluster: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with a deleted flag (all of the cluster but concepts), and the edges without a deleted end."""
    out = nodes.withColumn("deleted", (F.col("cluster_id") == cluster) & (F.col("type") != "Concept"))
    gone = out.where("deleted").select("id")
    live = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return out, live
