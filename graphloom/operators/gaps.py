"""Research gaps of a metric graph, their evidence, and votes on hypotheses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence(base: float, *modifiers: Column) -> Column:
    """The base plus modifiers, rounded to two digits, within [0.05, 0.98]."""
    value = reduce(lambda a, b: a + b, modifiers, F.lit(base))
    return F.greatest(F.lit(0.05), F.least(F.lit(0.98), F.round(value, 2)))


def _gap(df: DataFrame, category: str, conf: Column, related: Column | None = None) -> DataFrame:
    return df.select(F.concat(F.lit(f"{category}:"), "id").alias("gap_id"), F.lit(category).alias("category"), conf.cast("double").alias("confidence"), "id", (F.array("id") if related is None else related).alias("related"))


def _typed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.select("id", "type", "name")
    return edges.join(kinds.select(F.col("id").alias("source"), F.col("type").alias("st")), "source", "left").join(kinds.select(F.col("id").alias("target"), F.col("type").alias("tt"), F.col("name").alias("tn")), "target", "left")


KPI = r"(?i)\b(kpi|efficiency|yield|strength|cost|durability)\b"


def no_synthesis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Materials without an edge to a synthesis method."""
    linked = _typed(nodes, edges).where("st = 'Material' and tt = 'SynthesisMethod'").select(F.col("source").alias("id"))
    return _gap(nodes.where("type = 'Material'").join(linked, "id", "left_anti"), "synthesis_gap", confidence(0.62))


def sparse_kpis(nodes: DataFrame, edges: DataFrame, pattern: str = KPI) -> DataFrame:
    """KPI properties (all, if none is one) with at most one inbound link from a material."""
    props = nodes.where("type = 'Property'").withColumn("kpi", F.col("name").rlike(pattern))
    any_kpi = props.agg(F.bool_or("kpi").alias("any"))
    chosen = props.join(any_kpi).where("kpi or not any")  # one row beside
    links = _typed(nodes, edges).where("st = 'Material'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("links"))
    out = chosen.join(links, "id", "left").withColumn("links", F.coalesce("links", F.lit(0))).where("links <= 1")
    return _gap(out, "kpi_gap", confidence(0.58, F.col("links") * 0.04))


def unmitigated(nodes: DataFrame, edges: DataFrame, kind: str = "FailureMode", relations: tuple[str, ...] = ("MITIGATES", "PREVENTS")) -> DataFrame:
    """Failure modes (or nodes of another type) that no mitigating relation points at."""
    fixed = edges.where(F.col("type").isin(*relations)).select(F.col("target").alias("id"))
    inbound = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("inbound"))
    out = nodes.where(F.col("type") == kind).join(fixed, "id", "left_anti").join(inbound, "id", "left")
    return _gap(out, "mitigation_gap", confidence(0.66, F.coalesce("inbound", F.lit(0)) * -0.02))


def only_degrading(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Central nodes whose out-edges degrade and never improve."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("type") == "DEGRADES").alias("bad"), F.count_if(F.col("type") == "IMPROVES").alias("good")).where("bad > 0 and good = 0")
    central = nodes.where("betweenness >= 0.05 or pagerank >= 0.01").join(out, "id")
    return _gap(central, "control_point", confidence(0.55, F.col("betweenness") * 0.5, F.col("pagerank") * 2))


def broken_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of depth 3 or more without an edge to a property or concept."""
    linked = _typed(nodes, edges).where("tt in ('Property', 'Concept')").select(F.col("source").alias("id"))
    return _gap(nodes.where("depth >= 3").join(linked, "id", "left_anti"), "chain_gap", confidence(0.5, F.col("depth") * 0.03))


def no_kpi_target(nodes: DataFrame, edges: DataFrame, pattern: str = KPI) -> DataFrame:
    """Materials with two or more links to properties and none to a KPI."""
    links = _typed(nodes, edges).where("tt in ('Property', 'KPI_Target')").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("links"), F.count_if((F.col("tt") == "KPI_Target") | F.col("tn").rlike(pattern)).alias("kpis"))
    out = nodes.where("type = 'Material'").join(links, "id").where("links >= 2 and kpis = 0")
    return _gap(out, "kpi_target_gap", confidence(0.6, F.col("links") * 0.02))


def no_outcome(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, material) pairs whose material has no property."""
    typed = _typed(nodes, edges)
    pairs = typed.where("st = 'Material' and tt = 'SynthesisMethod'").select(F.col("target").alias("method"), F.col("source").alias("material")).distinct()
    known = typed.where("tt in ('Property', 'KPI_Target')").select(F.col("source").alias("material"))
    out = pairs.join(known, "material", "left_anti").select(F.concat_ws("/", "method", "material").alias("id"), "method", "material")
    return _gap(out, "outcome_gap", confidence(0.57), F.array("method", "material"))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bridge scores of 0.5 or more with two or more edges to other clusters."""
    own = nodes.select("id", "cluster_id")
    # Each edge meets the clusters of its ends once; only then is it counted at both.
    ends = edges.select("source", "target").join(own.select(F.col("id").alias("source"), F.col("cluster_id").alias("c1")), "source").join(own.select(F.col("id").alias("target"), F.col("cluster_id").alias("c2")), "target")
    crossing = ends.where("c1 <> c2").select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("crossing")).where("crossing >= 2")
    return _gap(nodes.where("bridge_score >= 0.5").join(crossing, "id"), "bridge", confidence(0.64, F.col("bridge_score") * 0.2))


def entry_points(nodes: DataFrame) -> DataFrame:
    """Importance above 0.05 at depth 0 or 1."""
    return _gap(nodes.where("importance > 0.05 and depth <= 1"), "entry_point", confidence(0.52, F.col("importance") * 2))


def all_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The union of all gap queries."""
    parts = [f(nodes, edges) for f in (no_synthesis, sparse_kpis, unmitigated, only_degrading, broken_chain, no_kpi_target, no_outcome, bridges)]
    return reduce(DataFrame.unionByName, [*parts, entry_points(nodes)])


def evidence(gaps: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """(gap_id, rank, source, target, type): the first n edges at a gap's related nodes."""
    at = gaps.select("gap_id", F.explode("related").alias("id"))
    both = edges.select(F.col("source").alias("id"), "source", "target", "type", "pos").unionByName(edges.select(F.col("target").alias("id"), "source", "target", "type", "pos"))
    found = at.join(both, "id").select("gap_id", "source", "target", "type", "pos").distinct()
    w = Window.partitionBy("gap_id").orderBy("pos", "type", "source", "target")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("pos")


def gap_edges(gaps: DataFrame, edges: DataFrame) -> DataFrame:
    """(gap_id, source, target, type): the edges among a gap's related nodes.

    A gap asks for each pair of its few nodes by both ends at once, so no node meets each gap that names it with each of its edges.
    """
    own = gaps.select("gap_id", F.array_distinct("related").alias("r"))
    pairs = own.select("gap_id", F.explode("r").alias("x"), "r").select("gap_id", "x", F.explode("r").alias("y")).where("x <= y")
    known = edges.select("source", "target", "type", F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).where("source is not null and target is not null")
    return pairs.join(known, ["x", "y"]).select("gap_id", "source", "target", "type").distinct()


def ranked_gaps(gaps: DataFrame, least: float = 0.5, n: int = 50) -> DataFrame:
    """The n gaps of the highest confidence."""
    return gaps.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "gap_id").limit(n).select("gap_id", "category", "confidence")


def suggestions(replies: DataFrame, needed: int = 1) -> DataFrame:
    """(run, number, suggestion) of replies (run, reply): the entries Suggestion_n of a JSON object or of the object in it, in natural order, renumbered; runs with fewer than needed are left out."""
    parsed = replies.select("run", F.coalesce(F.from_json(F.get_json_object("reply", "$.suggestions"), "map<string,string>"), F.from_json("reply", "map<string,string>")).alias("m"))
    rows = parsed.select("run", F.explode("m").alias("key", "suggestion")).withColumn("at", F.regexp_extract("key", r"^Suggestion_(\d+)$", 1)).where("at <> ''")
    w = Window.partitionBy("run").orderBy(F.col("at").cast("int"), "key")
    out = rows.withColumn("number", F.row_number().over(w)).withColumn("of", F.count("*").over(Window.partitionBy("run")))
    return out.where(F.col("of") >= needed).select("run", "number", "suggestion")


def verdicts(votes: DataFrame) -> DataFrame:
    """Per run NO if any vote is NO, the number of NO, and of votes; votes: (run, verdict)."""
    no = F.count_if(F.upper("verdict") == "NO")
    return votes.groupBy("run").agg(F.when(no > 0, "NO").otherwise("YES").alias("final"), no.alias("noes"), F.count("*").alias("votes"))


def unanimous(votes: DataFrame, critics: int = 4) -> DataFrame:
    """Per (run, suggestion) YES only if all critics voted and all say YES; votes: (run, suggestion, critic, verdict)."""
    yes = F.bool_and(F.upper("verdict") == "YES") & (F.count_distinct("critic") >= critics)
    return votes.groupBy("run", "suggestion").agg(F.when(yes, "YES").otherwise("NO").alias("final"))
