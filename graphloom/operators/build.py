"""Graph construction and validation: ids, patches, admission, edge rules, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import automaton
from graphloom.functions import ontology as O

CONCEPT_TYPES = list(O.NODE_CODES)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def final_ids(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Temporary ids within a slice become slug:c:(start + offset) or slug:q:(start + offset):index.

    nodes: slice_id, slug, start, id, type, node_offset, index; edges: slice_id, source, target, ....
    """
    at = (F.col("start") + F.col("node_offset")).cast("string")
    new = (
        F.when(F.col("node_offset").isNull(), F.col("id"))
        .when(F.col("type") == "Chunk", F.concat_ws(":", "slug", F.lit("c"), at))
        .when(F.col("type") == "Assessment", F.concat_ws(":", "slug", F.lit("q"), at, F.col("index").cast("string")))
        .otherwise(F.col("id"))
    )
    named = nodes.withColumn("final_id", new)
    ids = named.select("slice_id", F.col("id").alias("old"), "final_id")
    out = edges
    for end in ("source", "target"):
        own = ids.select("slice_id", F.col("old").alias(end), F.col("final_id").alias("_new"))
        out = out.join(own, ["slice_id", end], "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return named.drop("id").withColumnRenamed("final_id", "id"), out


def dedup_patches(nodes: DataFrame, keep_longest_chunk: bool = False) -> DataFrame:
    """Of nodes with one id the first by (slice_order, pos) stays; optionally a chunk's longest text."""
    text = F.when(F.col("type") == "Chunk", -F.length("text")) if keep_longest_chunk else F.lit(0)
    w = Window.partitionBy("id").orderBy(text, "slice_order", "pos")
    return nodes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def patch_duplicates(nodes: DataFrame) -> DataFrame:
    """Ids that occur again, with how often and whether they are anomalous (chunks or assessments)."""
    return nodes.groupBy("id").agg(F.count("*").alias("n"), F.bool_or(F.col("type").isin("Chunk", "Assessment")).alias("anomalous")).where("n > 1").select("id", (F.col("n") - 1).alias("repeats"), "anomalous")


def admit_nodes(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Chunks (difficulty 3 by default) and assessments pass; other nodes need a concept of their id, whose term is the default name."""
    known = concepts.select(F.col("concept_id").alias("id"), F.col("term").alias("_term"))
    joined = nodes.join(known, "id", "left")
    free = F.col("type").isin("Chunk", "Assessment")
    kept = joined.where(free | (F.col("type").isin(*CONCEPT_TYPES) & F.col("_term").isNotNull()))
    name = F.when(free, F.col("name")).otherwise(F.coalesce(F.nullif("name", F.lit("")), "_term"))
    difficulty = F.when(F.col("type") == "Chunk", F.coalesce("difficulty", F.lit(3))).otherwise(F.col("difficulty"))
    return kept.withColumns({"name": name, "difficulty": difficulty}).drop("_term")


def valid_edges(nodes: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """No self-loops, confidence of at least ``least`` (missing: weight, then 0.5), known endpoints,
    types the ontology allows, the first edge of each (source, target, type), and a default role."""
    spark = edges.sparkSession
    weight = F.col("weight") if "weight" in edges.columns else F.lit(None)
    scored = edges.where("source <> target").withColumn("confidence", F.coalesce(F.col("confidence").try_cast("double"), weight.try_cast("double"), F.lit(0.5))).where(F.col("confidence") >= least)
    kinds = nodes.select("id", "type").distinct()
    typed = scored.join(kinds.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(kinds.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target")
    allowed = typed.join(F.broadcast(O.rule_table(spark)), ["type", "source_type", "target_type"])  # a table of fixed size
    role = F.when(F.col("type").isin(*O.CAUSAL), "causal").otherwise("structural")
    given = F.col("relation_role") if "relation_role" in edges.columns else F.lit(None).cast("string")
    return first_by(allowed.withColumn("relation_role", F.coalesce(given, role)), ["source", "target", "type"], ["pos", "confidence"])


def mentions(chunks: DataFrame, concepts: DataFrame, existing: DataFrame | None = None, weight: float = 0.35, max_words: int | None = None) -> DataFrame:
    """Chunk-to-concept edges where a term or alias (of any length, or up to ``max_words`` words) occurs, case-insensitively, between word boundaries.

    Terms within the automaton's measured bound are found in one pass over each text; beyond it, runs of the text's pieces (words and what
    is between them), of the lengths that occur among the terms, meet the terms in an equi-join.  No chunk is compared with every concept.
    """
    words = r"[\p{L}\p{N}_]+"
    terms = concepts.select("concept_id", F.explode(F.array_distinct(F.concat(F.array("term"), F.coalesce("aliases", F.array()) if "aliases" in concepts.columns else F.array().cast("array<string>")))).alias("term"))
    terms = terms.where(F.col("term").rlike(r"\S")).select("concept_id", F.lower("term").alias("gram")).distinct()
    if max_words is not None:
        terms = terms.where(F.size(F.regexp_extract_all("gram", F.lit(words), 0)) <= max_words)
    patterns = automaton.collected(terms, "gram")
    if patterns is None:
        found = _runs(chunks, terms, words)
    else:
        found = automaton.occurring(chunks, patterns, "id", "text", automaton.whole_words).withColumnRenamed("pattern", "gram")
    out = found.join(terms, "gram").select(F.col("id").alias("source"), F.col("concept_id").alias("target"), F.lit("MENTIONS").alias("type"), F.lit(weight).alias("weight")).distinct()
    return out if existing is None else out.join(existing.select("source", "target"), ["source", "target"], "left_anti")


def _runs(chunks: DataFrame, terms: DataFrame, words: str) -> DataFrame:
    """(id, gram): the runs of whole pieces that are as long as some term; none begins or ends with a mark at the text's own ends."""
    pieces = lambda c: F.regexp_extract_all(F.lower(c), F.lit(rf"{words}|[^\p{{L}}\p{{N}}_]+"), 0)
    lengths = sorted(r[0] for r in terms.select(F.size(pieces("gram")).alias("n")).distinct().collect())  # a row a length
    split = chunks.select("id", pieces("text").alias("w")).select("id", "w", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n")).where("size(w) >= n")
    word = lambda i: F.get("w", i).rlike(words)
    last = F.size("w") - F.col("n")
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) | word(F.lit(0))) & ((i < last) | word(F.size("w") - 1)))
    return split.select("id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.col("n")), "")))).alias("gram"))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids of more than one node."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def merge_concepts(rows: DataFrame) -> DataFrame:
    """Concepts of several slices by id: the first row's fields; aliases united without regard to case and without the term, sorted
    if more than one row gave some, else in their order.  rows: concept_id, term, aliases, definition, slice_order."""
    head = first_by(rows, ["concept_id"], ["slice_order", "term"])
    names = rows.select("concept_id", "slice_order", F.posexplode("aliases").alias("at", "alias"))
    names = names.join(head.select("concept_id", "term"), "concept_id").where(F.lower("alias") != F.lower("term"))
    names = first_by(names.withColumn("low", F.lower("alias")), ["concept_id", "low"], ["slice_order", "at"])
    first_slice = rows.groupBy("concept_id").agg(F.min("slice_order").alias("s0"))
    lists = names.join(first_slice, "concept_id").groupBy("concept_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slice_order", "at", "alias"))), lambda x: x["alias"]).alias("kept"),
        F.array_sort(F.collect_list("alias")).alias("sorted"), F.bool_or(F.col("slice_order") > F.col("s0")).alias("more"),
    )
    out = head.drop("aliases").join(lists, "concept_id", "left")
    return out.withColumn("aliases", F.coalesce(F.when(F.col("more"), F.col("sorted")).otherwise(F.col("kept")), F.array().cast("array<string>"))).drop("kept", "sorted", "more")


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n) of nodes by type and edges by type."""
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def concept_statistics(concepts: DataFrame) -> DataFrame:
    """Concepts, those with aliases, aliases in all, and their average."""
    n = F.size(F.coalesce("aliases", F.array().cast("array<string>")))
    return concepts.agg(F.count("*").alias("concepts"), F.count_if(n > 0).alias("with_aliases"), F.sum(n).cast("bigint").alias("aliases"), F.round(F.avg(n), 2).alias("average"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, entity, n) of every broken invariant; a strict caller raises if any row is there."""
    spark = nodes.sparkSession
    types = [*O.NODE_CODES, *O.TEXT_TYPES]
    row = lambda df, rule, entity: df.select(F.lit(rule).alias("rule"), entity.alias("entity"))
    key = F.concat_ws("|", "source", "target", "type")
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    kinds = nodes.select("id", "type").distinct()
    typed = edges.join(kinds.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(kinds.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target")
    known = typed.where(F.col("type").isin(*O.ONTOLOGY))
    parts = [
        row(nodes.where("id is null or type is null or id = ''"), "node_required", F.coalesce("id", F.lit(""))),
        row(nodes.where(~F.col("type").isin(*types)), "node_type", F.col("id")),
        row(nodes.where(~F.col("id").rlike("^[A-Za-z0-9:_-]+$")), "node_id_form", F.col("id")),
        row(duplicate_ids(nodes), "node_unique", F.col("id")),
        row(edges.where(~F.col("type").isin(*O.ONTOLOGY, "MENTIONS")), "edge_type", key),
        row(edges.where("source = target"), "self_loop", key),
        row(edges.join(ids, edges["source"] == ids["_id"], "left_anti"), "source_known", key),
        row(edges.join(ids, edges["target"] == ids["_id"], "left_anti"), "target_known", key),
        row(edges.where("confidence < 0 or confidence > 1"), "confidence_range", key),
        row(edges.groupBy("source", "target", "type").count().where("count > 1"), "edge_unique", key),
        row(known.join(F.broadcast(O.rule_table(spark)), ["type", "source_type", "target_type"], "left_anti"), "domain_range", key),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rule", "entity").agg(F.count("*").alias("n"))


#: The schema's closed lists.
SOURCE_TYPES = ["literature", "patent", "internal_report", "lab_notebook", "database"]
RISKS = ["low", "medium", "high", "critical"]
ROLES = ["causal", "structural", "taxonomic", "economic", "operational"]
DIRECTIONS = ["positive", "negative", "neutral"]


def schema_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, entity, n) of every broken rule of the graph schema: required fields, closed lists, patterns and ranges.

    nodes: id, type, name and optionally source_type, supply_chain_risk; edges: source, target, type and optionally the
    attributes' columns.  A required attribute whose column is absent is missing in every edge.  One pass over each table.
    """

    def broken(df: DataFrame, entity: Column, rules: dict[str, Column]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
        return df.select(F.explode(found).alias("rule"), entity.alias("entity"))

    def listed(df: DataFrame, prefix: str, lists: dict[str, list[str]]) -> dict[str, Column]:
        return {f"{prefix}_{c}": ~F.col(c).isin(*values) for c, values in lists.items() if c in df.columns}

    node_rules = {f"node_{c}_required": F.col(c).isNull() for c in ("id", "type", "name")}
    node_rules |= {"node_id_pattern": ~F.col("id").rlike("^[A-Za-z0-9:_-]+$")}
    node_rules |= listed(nodes, "node", {"type": list(O.NODE_CODES), "source_type": SOURCE_TYPES, "supply_chain_risk": RISKS})
    needed = ("source", "target", "type", "confidence_score", "evidence_quote", "source_doi", "relation_role")
    edge_rules = {f"edge_{c}_required": F.col(c).isNull() if c in edges.columns else F.lit(True) for c in needed}
    edge_rules |= listed(edges, "edge", {"type": O.ONTOLOGY_TYPES, "relation_role": ROLES, "direction": DIRECTIONS})
    if "confidence_score" in edges.columns:
        edge_rules["edge_confidence_score_range"] = ~F.col("confidence_score").between(0, 1)
    if "co_occurrence_count" in edges.columns:
        edge_rules["edge_co_occurrence_count_range"] = F.col("co_occurrence_count") < 0
    every = broken(nodes, F.coalesce("id", F.lit("")), node_rules).unionByName(broken(edges, F.concat_ws("|", "source", "target", "type"), edge_rules))
    return every.groupBy("rule", "entity").agg(F.count("*").alias("n"))


def concept_violations(concepts: DataFrame) -> DataFrame:
    """(rule, concept_id): repeated ids, a term among its aliases, repeated aliases, all without regard to case."""
    low = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a))
    parts = [
        concepts.groupBy("concept_id").count().where("count > 1").select(F.lit("concept_unique").alias("rule"), "concept_id"),
        concepts.where(F.array_contains(low, F.lower("term"))).select(F.lit("term_in_aliases").alias("rule"), "concept_id"),
        concepts.where(F.size(low) > F.size(F.array_distinct(low))).select(F.lit("alias_unique").alias("rule"), "concept_id"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fill_defaults(nodes: DataFrame) -> DataFrame:
    """C14: name from text, then id; definition ''; position from the id; difficulty 3; type Concept."""
    at = F.regexp_extract("id", r"^[^:]+:[cq]:(\d+)", 1)
    return nodes.withColumns(
        {
            "name": F.coalesce(F.nullif("name", F.lit("")), F.nullif("text", F.lit("")), "id"),
            "definition": F.coalesce("definition", F.lit("")),
            "node_offset": F.coalesce("node_offset", F.nullif(at, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint")),
            "difficulty": F.coalesce("difficulty", F.lit(3)),
        }
    )


def normal_types(nodes: DataFrame) -> DataFrame:
    """A given ontology_class overrides the type; both empty: Concept."""
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return nodes.withColumn("type", F.coalesce(given("ontology_class"), given("type"), F.lit("Concept")))


def unseen(slices: DataFrame, processed: DataFrame, key: str = "id") -> DataFrame:
    """C17: slices whose id has not been processed."""
    return slices.join(processed.select(key).distinct(), key, "left_anti")


def confidence_of(column: Column) -> Column:
    """A confidence between 0 and 1; unreadable: 0.5."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(column.try_cast("double"), F.lit(0.5))))
