"""Subject-relation-object triples of a graph, and look-ups for goals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import automaton
from graphloom.functions import ontology as O


def _label(prefix: str = ""):
    """A node's label: name, then text, then id."""
    have = [F.nullif(F.col(f"{prefix}name"), F.lit(""))]
    return F.coalesce(*have, F.col(f"{prefix}id"))


def _coded(nodes: DataFrame) -> DataFrame:
    codes = F.broadcast(O.code_table(nodes.sparkSession))  # fourteen rows
    return nodes.select("id", "type", _label().alias("label")).join(codes, "type").drop("type")


def _count():
    return F.greatest(F.coalesce(F.col("co_occurrence_count").try_cast("bigint"), F.lit(1)), F.lit(1)).cast("bigint")


def direct_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Subject, Rel (CODE-CODE), Object, Count of each edge between coded nodes."""
    ends = _coded(nodes)
    out = edges.select("source", "target", _count().alias("Count"))
    for end in ("source", "target"):
        out = out.join(ends.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"), F.col("code").alias(f"{end}_code")), end)
    return out.select(F.col("source_label").alias("Subject"), F.concat_ws("-", "source_code", "target_code").alias("Rel"), F.col("target_label").alias("Object"), "Count")


def derived_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Application-property triples through a shared material; Count is the smaller of the two sums."""
    ends = _coded(nodes)
    material = ends.where("code = 'CHM'").select(F.col("id").alias("source"))
    base = edges.withColumn("n", _count()).join(material, "source", "left_semi")

    def side(kinds: list[str], code: str, name: str) -> DataFrame:
        own = ends.where(F.col("code") == code).select(F.col("id").alias("target"), F.col("label").alias(name))
        return base.where(F.col("type").isin(*kinds)).join(own, "target").groupBy("source", "target", name).agg(F.sum("n").alias(f"n_{name}")).drop("target")

    both = side(["APPLIED_IN"], "APL", "app").join(side(["IMPROVES", "DEGRADES"], "PRO", "prop"), "source")
    return both.select(F.col("app").alias("Subject"), F.lit("APL-PRO").alias("Rel"), F.col("prop").alias("Object"), F.least("n_app", "n_prop").alias("Count"))


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct and derived triples, summed by (Subject, Rel, Object)."""
    return direct_triples(nodes, edges).unionByName(derived_triples(nodes, edges)).groupBy("Subject", "Rel", "Object").agg(F.sum("Count").alias("Count"))


def relation_frequency(found: DataFrame) -> DataFrame:
    """I4: triples by relation."""
    return found.groupBy("Rel").agg(F.count("*").alias("n"))


def entities(found: DataFrame) -> DataFrame:
    """Distinct subjects and objects, from one pass over the triples.

    The direct triples are enough: a derived one takes its subject and its object from edges that are direct triples themselves.
    """
    return found.select(F.explode(F.array("Subject", "Object")).alias("entity")).distinct()


def labels_of(nodes: DataFrame, kind: str) -> DataFrame:
    """Distinct labels of nodes of a type."""
    return nodes.where(F.col("type") == kind).select(_label().alias("label")).where("label <> ''").distinct()


def known_in_goals(goals: DataFrame, labels: DataFrame) -> DataFrame:
    """(goal_id, label) where the label occurs in the goal, case-insensitively.

    Labels within the automaton's measured bound are found in one pass over each goal; beyond it, a label is met by equality with the
    goal's substrings of the lengths that occur among the labels.  Neither side is paired with all of the other.  Blank labels are left out.
    """
    sized = labels.select("label", F.lower("label").alias("low")).where(F.trim("low") != "")
    patterns = automaton.collected(sized, "low")
    if patterns is not None:
        found = automaton.occurring(goals, patterns, "goal_id", "goal").select(F.col("id").alias("goal_id"), F.col("pattern").alias("low"))
        return found.join(sized, "low").select("goal_id", "label").distinct()
    lengths = sized.agg(F.collect_set(F.length("low")).alias("lengths"))  # one row, as long as the longest label at most
    parts = goals.select("goal_id", F.lower("goal").alias("g")).crossJoin(F.broadcast(lengths)).select("goal_id", "g", F.explode("lengths").alias("n")).where(F.length("g") >= F.col("n"))
    parts = parts.select("goal_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("g") - F.col("n") + 1), lambda i: F.substring("g", i, F.col("n"))))).alias("low"))
    return parts.join(sized, "low").select("goal_id", "label").distinct()


def application_context(found: DataFrame) -> DataFrame:
    """I8: for each application (an APL entity) its sorted distinct materials and properties, over both orientations."""
    split = F.split("Rel", "-")
    turned = found.select(split[0].alias("a"), split[1].alias("b"), "Subject", "Object")
    app = turned.where("a = 'APL'").select(F.col("Subject").alias("application"), F.col("b").alias("code"), F.col("Object").alias("other")).unionByName(
        turned.where("b = 'APL'").select(F.col("Object").alias("application"), F.col("a").alias("code"), F.col("Subject").alias("other"))
    )
    take = lambda code: F.array_sort(F.collect_set(F.when(F.col("code") == code, F.col("other"))))
    return app.where("code in ('CHM', 'PRO')").groupBy("application").agg(take("CHM").alias("materials"), take("PRO").alias("properties"))


def material_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All first-degree relations of materials by (material, type): how many, and the sorted distinct neighbours; the first id wins per label."""
    own = nodes.where("type = 'Material'").select("id", _label().alias("material"), "pos")
    w = Window.partitionBy("material").orderBy("pos", "id")
    own = own.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "material")
    near = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "type").unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "type"))
    named = near.join(own, "id").join(nodes.select(F.col("id").alias("other"), _label().alias("entity")), "other")
    return named.groupBy("material", "type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("entity")).alias("entities"))


def goal_context(goals: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(goal_id, route, n): applications named in the goal, else materials, else none."""
    apps = known_in_goals(goals, labels_of(nodes, "Application")).groupBy("goal_id").agg(F.count("*").alias("apps"))
    mats = known_in_goals(goals, labels_of(nodes, "Material")).groupBy("goal_id").agg(F.count("*").alias("mats"))
    out = goals.select("goal_id").join(apps, "goal_id", "left").join(mats, "goal_id", "left")
    route = F.when(F.col("apps") > 0, "application").when(F.col("mats") > 0, "material").otherwise("none")
    return out.select("goal_id", route.alias("route"), F.coalesce("apps", "mats", F.lit(0)).alias("n"))


def search(found: DataFrame, query: str, relation: str, k: int = 20) -> DataFrame:
    """The k objects with the largest summed counts among triples whose subject contains the query."""
    hits = found.where(F.contains(F.lower("Subject"), F.lit(query.lower())) & (F.col("Rel") == relation))
    return hits.groupBy("Object").agg(F.sum("Count").alias("Count")).orderBy(F.desc("Count"), "Object").limit(k)


def entity_lookup(found: DataFrame, prefix: str = "", pattern: str | None = None) -> DataFrame:
    """Entities with a prefix, or matching a pattern."""
    every = entities(found)
    return every.where(F.col("entity").rlike(pattern) if pattern else F.startswith("entity", F.lit(prefix)))
