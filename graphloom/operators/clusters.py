"""Cluster split and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written

LINK_TYPES = ["SYNTHESIZED_BY", "IMPROVES", "APPLIED_IN", "REQUIRES_CONDITION"]


def cluster_list(nodes: DataFrame) -> DataFrame:
    """H1: the clusters."""
    return nodes.select("cluster_id").where("cluster_id is not null").distinct().orderBy("cluster_id")


def _ends(nodes: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    own = nodes.select("id", *columns)
    out = edges
    for end in ("source", "target"):
        out = out.join(own.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return out


def cluster_subgraphs(nodes: DataFrame, edges: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """H2: nodes and edges by cluster (clusters of fewer than ``least`` nodes are left out), and per cluster: nodes, edges inside, edges with one end inside."""
    counts = nodes.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("nodes")).where(F.col("nodes") >= least)
    own = nodes.join(counts.select("cluster_id"), "cluster_id", "left_semi")
    ends = _ends(nodes, edges, "cluster_id")
    inside = ends.where("source_cluster_id = target_cluster_id").withColumn("cluster_id", F.col("source_cluster_id")).join(counts.select("cluster_id"), "cluster_id", "left_semi")
    crossing = ends.where("source_cluster_id <> target_cluster_id")
    crossing = crossing.select(F.explode(F.array("source_cluster_id", "target_cluster_id")).alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("inter"))
    intra = inside.groupBy("cluster_id").agg(F.count("*").alias("intra"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    summary = counts.join(intra, "cluster_id", "left").join(crossing, "cluster_id", "left").select("cluster_id", "nodes", zero("intra"), zero("inter"))
    return own, inside.drop("source_cluster_id", "target_cluster_id"), summary


def cluster_dictionary(node_concepts: DataFrame, concepts: DataFrame, concept_clusters: DataFrame | None = None) -> DataFrame:
    """H3: (cluster_id, concept_id, term, concept_cluster, missing) of the distinct concepts of a cluster's nodes (id, cluster_id, concepts)."""
    used = node_concepts.select("cluster_id", F.explode("concepts").alias("concept_id")).distinct()
    out = used.join(concepts.select("concept_id", "term"), "concept_id", "left").withColumn("missing", F.col("term").isNull())
    if concept_clusters is None:
        return out.withColumn("concept_cluster", F.lit(None).cast("int"))
    return out.join(concept_clusters.select(F.col("id").alias("concept_id"), F.col("cluster_id").alias("concept_cluster")), "concept_id", "left")


def node_order(nodes: DataFrame) -> DataFrame:
    """H4: concepts first, by id; the others in their place."""
    concept = F.col("type") == "Concept"
    return nodes.orderBy((~concept).cast("int"), F.when(concept, F.col("id")), "pos", "id")


def placed(ordered: DataFrame) -> DataFrame:
    """The rows of a sorted table with place, from 1: the sort's ranges are counted, and a range's rows follow those of the ranges before it."""
    at = F.monotonically_increasing_id()  # the range above bit 33, the row in it below
    rows = written(ordered.withColumns({"_range": F.shiftright(at, 33), "_row": at.bitwiseAND(F.lit((1 << 33) - 1))}), f"{shared_dir(ordered.sparkSession)}/placed")
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(counts), "_range").withColumn("place", F.col("_before") + F.col("_row") + 1).drop("_range", "_row", "_before")


def inter_cluster_links(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, top: int = 3, longest: int = 500) -> DataFrame:
    """H5: per cluster and direction the ``top`` links to other clusters by the source's importance; the edge's position breaks ties."""
    ends = _ends(nodes, edges.where(F.col("type").isin(*(types or LINK_TYPES))), "cluster_id", "importance", "name").where("source_cluster_id <> target_cluster_id")
    cut = lambda c: F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("..."))).otherwise(F.col(c))
    side = F.explode(F.array(F.struct(F.lit("outgoing").alias("direction"), F.col("source_cluster_id").alias("cluster_id")), F.struct(F.lit("incoming").alias("direction"), F.col("target_cluster_id").alias("cluster_id"))))
    rows = ends.withColumn("s", side).select("s.direction", "s.cluster_id", "source", "target", "type", cut("source_name").alias("source_text"), cut("target_name").alias("target_text"), F.coalesce("source_importance", F.lit(0.0)).alias("importance"), "pos")
    w = Window.partitionBy("cluster_id", "direction").orderBy(F.desc("importance"), "pos", "type", "source", "target")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("pos")


def cluster_metadata(summary: DataFrame, title: str) -> DataFrame:
    """H6: cluster_id, title, subtitle."""
    return summary.select("cluster_id", F.format_string("%s - cluster %d", F.lit(title), "cluster_id").alias("title"), F.format_string("Cluster %d: %d nodes, %d edges", "cluster_id", "nodes", "intra").alias("subtitle"))


def marked(df: DataFrame, column: str, mark: str = "[AI] ", skip: str | None = None) -> DataFrame:
    """H7: non-blank values that do not carry the mark (or a skip pattern) get it; _changed tells which."""
    c = F.col(column)
    change = c.isNotNull() & (F.trim(c) != "") & ~F.startswith(c, F.lit(mark))
    if skip:
        change &= ~c.rlike(skip)
    return df.withColumn("_changed", F.coalesce(change, F.lit(False))).withColumn(column, F.when(F.col("_changed"), F.concat(F.lit(mark), c)).otherwise(c))


def concept_text(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """H8: id, text, changed of concept nodes: term, with aliases in brackets."""
    names = F.when(F.size("aliases") > 0, F.concat(F.col("term"), F.lit(" ("), F.array_join("aliases", ", "), F.lit(")"))).otherwise(F.col("term"))
    out = nodes.where("type = 'Concept'").join(concepts.select(F.col("concept_id").alias("id"), names.alias("new")), "id", "left")
    return out.select("id", F.coalesce("new", "text").alias("text"), (~F.coalesce("new", "text").eqNullSafe(F.col("text"))).alias("changed"))


def dry_run(before: DataFrame, after: DataFrame, column: str, n: int = 5) -> DataFrame:
    """H9: the first n changes of a column by id, with the number of all changes."""
    both = before.select("id", F.col(column).alias("old")).join(after.select("id", F.col(column).alias("new")), "id").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.orderBy("id").limit(n).join(both.agg(F.count("*").alias("changes")))
