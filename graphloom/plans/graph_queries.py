"""Registered queries over the derived graph, with SQL for each that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import ontology as O
from graphloom.operators import browse, build, clusters, gaps, metrics, quality, triples
from graphloom.plans.tables import table, with_tables

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_tables(sql)
        return f

    return keep


def graph(spark, sf_dir):
    return table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")


def metric_graph(spark, sf_dir):
    return table(spark, sf_dir, "metric_nodes"), table(spark, sf_dir, "edges")


RULES = O.values(O.rules())
CODES = O.values(list(O.NODE_CODES.items()))
IN = lambda xs: ", ".join(f"'{x}'" for x in xs)

VALID = f"""
valid as (select * from (
  select e.source, e.target, e.type, coalesce(e.confidence, 0.5e0) as confidence,
         case when e.type in ({IN(O.CAUSAL)}) then 'causal' else 'structural' end as relation_role,
         row_number() over (partition by e.source, e.target, e.type order by e.pos, e.confidence) as rn
  from edges e join nodes s on e.source = s.id join nodes t on e.target = t.id
       join {RULES} r(type, st, tt) on r.type = e.type and r.st = s.type and r.tt = t.type
  where e.source <> e.target and coalesce(e.confidence, 0.5e0) >= 0.5e0) where rn = 1)"""
TRIPLES = f"""
coded as (select n.id, coalesce(nullif(n.name, ''), n.id) as label, c.code from nodes n join {CODES} c(type, code) on n.type = c.type),
direct as (select s.label as Subject, s.code || '-' || t.code as Rel, t.label as Object, greatest(coalesce(e.co_occurrence_count, 1), 1) as n
           from edges e join coded s on e.source = s.id join coded t on e.target = t.id),
apps as (select e.source, t.label, e.target, sum(greatest(e.co_occurrence_count, 1)) as n from edges e join coded s on e.source = s.id and s.code = 'CHM' join coded t on e.target = t.id and t.code = 'APL' where e.type = 'APPLIED_IN' group by all),
props as (select e.source, t.label, e.target, sum(greatest(e.co_occurrence_count, 1)) as n from edges e join coded s on e.source = s.id and s.code = 'CHM' join coded t on e.target = t.id and t.code = 'PRO' where e.type in ('IMPROVES', 'DEGRADES') group by all),
derived as (select a.label as Subject, 'APL-PRO' as Rel, p.label as Object, least(a.n, p.n) as n from apps a join props p using (source)),
triples as (select Subject, Rel, Object, cast(sum(n) as bigint) as Count from (select * from direct union all select * from derived) group by 1, 2, 3)"""


@query("c5_valid_edges", f"with {VALID} select source, target, type, confidence, relation_role from valid")
def _(s, d):
    return build.valid_edges(*graph(s, d)).select("source", "target", "type", "confidence", "relation_role")


@query("c7_duplicate_ids", "select id, count(*) as n from (select * from nodes union all select * from nodes where pos % 10 = 0) group by id having count(*) > 1")
def _(s, d):
    n = table(s, d, "nodes")
    return build.duplicate_ids(n.unionByName(n.where("pos % 10 = 0")))


@query("c1_final_ids", """with n as (select source as slice_id, doc_id, case when doc_id % 3 = 0 then 'Assessment' else 'Chunk' end as type from documents)
  select slice_id, case when type = 'Chunk' then slice_id || ':c:' || (doc_id * 10 + n_chars) else slice_id || ':q:' || (doc_id * 10 + n_chars) || ':1' end as id from n join documents using (doc_id)""")
def _(s, d):
    docs = table(s, d, "documents")
    nodes = docs.select(F.col("source").alias("slice_id"), F.col("source").alias("slug"), (F.col("doc_id") * 10).alias("start"), F.concat(F.lit("t"), "doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "Assessment").otherwise("Chunk").alias("type"), F.col("n_chars").alias("node_offset"), F.lit(1).alias("index"))
    edges = docs.select(F.col("source").alias("slice_id"), F.concat(F.lit("t"), "doc_id").alias("source"), F.concat(F.lit("t"), "doc_id").alias("target"))
    return build.final_ids(nodes, edges)[0].select("slice_id", "id")


@query("c1_final_edges", """select source as slice_id, case when doc_id % 3 = 0 then source || ':q:' || (doc_id * 10 + n_chars) || ':1' else source || ':c:' || (doc_id * 10 + n_chars) end as source, 'other' as target from documents""")
def _(s, d):
    docs = table(s, d, "documents")
    nodes = docs.select(F.col("source").alias("slice_id"), F.col("source").alias("slug"), (F.col("doc_id") * 10).alias("start"), F.concat(F.lit("t"), "doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "Assessment").otherwise("Chunk").alias("type"), F.col("n_chars").alias("node_offset"), F.lit(1).alias("index"))
    edges = docs.select(F.col("source").alias("slice_id"), F.concat(F.lit("t"), "doc_id").alias("source"), F.lit("other").alias("target"))
    return build.final_ids(nodes, edges)[1].select("slice_id", "source", "target")


@query("c2_dedup_patches", "select id, slice_order, text from (select *, row_number() over (partition by id order by slice_order, pos) as rn from (select md5(text) as id, cast(doc_id % 20 as bigint) as slice_order, doc_id as pos, text from documents)) where rn = 1")
def _(s, d):
    n = table(s, d, "documents").select(F.md5("text").alias("id"), (F.col("doc_id") % 20).alias("slice_order"), F.col("doc_id").alias("pos"), "text", F.lit("Chunk").alias("type"))
    return build.dedup_patches(n).select("id", "slice_order", "text")


@query("c2_patch_duplicates", "select md5(text) as id, count(*) - 1 as repeats, true as anomalous from documents group by 1 having count(*) > 1")
def _(s, d):
    return build.patch_duplicates(table(s, d, "documents").select(F.md5("text").alias("id"), F.lit("Chunk").alias("type")))


@query("c4_longest_chunk", "select id, length(text) as n from (select *, row_number() over (partition by id order by length(text) desc, slice_order, pos) as rn from (select source as id, doc_id as slice_order, doc_id as pos, text from documents)) where rn = 1")
def _(s, d):
    n = table(s, d, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("slice_order"), F.col("doc_id").alias("pos"), "text", F.lit("Chunk").alias("type"))
    return build.dedup_patches(n, keep_longest_chunk=True).select("id", F.length("text").cast("bigint").alias("n"))


@query("c3_admit_nodes", "select id, type, coalesce(nullif(name, ''), 'term ' || id) as name from nodes where type in ('Material', 'Property') and pos % 3 <> 0")
def _(s, d):
    n = table(s, d, "nodes").where("type in ('Material', 'Property')")
    known = n.where("pos % 3 <> 0").select(F.col("id").alias("concept_id"), F.concat(F.lit("term "), "id").alias("term"))
    return build.admit_nodes(n, known).select("id", "type", "name")


@query("c6_mentions", r"""with w as (select id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) as g from chunks)
  select distinct w.id as source, c.concept_id as target from w join concepts c on c.term = w.g where c.term <> ''""")
def _(s, d):
    return build.mentions(table(s, d, "chunks"), table(s, d, "concepts")).select("source", "target")


@query("c8_merge_concepts", """with r as (select source as concept_id, lang as alias, doc_id from documents),
  a as (select concept_id, lower(alias) as low, min(alias) as alias from r where lower(alias) <> 'en' group by 1, 2)
  select concept_id, 'EN' as term, string_agg(alias, ',' order by alias) as aliases from a group by concept_id""")
def _(s, d):
    rows = table(s, d, "documents").select(F.col("source").alias("concept_id"), F.lit("EN").alias("term"), F.array("lang").alias("aliases"), F.lit("").alias("definition"), F.col("doc_id").alias("slice_order"))
    return build.merge_concepts(rows).where("size(aliases) > 0").select("concept_id", "term", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query("c9_graph_statistics", "select 'node' as kind, type, count(*) as n from nodes group by type union all select 'edge', type, count(*) from edges group by type")
def _(s, d):
    return build.graph_statistics(*graph(s, d))


@query("c10_concept_statistics", "select count(*) as concepts, count(*) filter (pos % 3 > 0) as with_aliases, cast(sum(pos % 3) as bigint) as aliases, round(avg(pos % 3), 2) as average from concepts")
def _(s, d):
    c = table(s, d, "concepts").withColumn("aliases", F.array_repeat(F.lit("x"), (F.col("pos") % 3).cast("int")))
    return build.concept_statistics(c)


@query("c11_violations", f"""with e as (select *, source || '|' || target || '|' || type as k from edges)
  select rule, entity, count(*) as n from (
   select 'self_loop' as rule, k as entity from e where source = target
   union all select 'source_known', k from e where source not in (select id from nodes)
   union all select 'target_known', k from e where target not in (select id from nodes)
   union all select 'edge_unique', k from e group by k having count(*) > 1
   union all select 'domain_range', k from e join nodes s on s.id = e.source join nodes t on t.id = e.target where not exists (select 1 from {RULES} r(type, st, tt) where r.type = e.type and r.st = s.type and r.tt = t.type)
  ) group by 1, 2""")
def _(s, d):
    return build.violations(*graph(s, d))


EDGE_SCHEMA = f"""
select source, target, type, confidence as confidence_score, case when pos % 10 <> 0 then 'quote ' || pos end as evidence_quote, case when pos % 14 <> 0 then 'doi:' || pos end as source_doi,
       case when type in ({IN(O.CAUSAL)}) then 'causal' when pos % 6 = 0 then 'odd' else 'structural' end as relation_role, case when pos % 12 = 0 then 'up' when pos % 2 = 0 then 'positive' end as direction, co_occurrence_count - 1 as co_occurrence_count"""
NODE_SCHEMA = "select case when pos % 45 = 0 then id || ' !' else id end as id, case when pos % 60 = 0 then 'Metal' else type end as type, case when pos % 75 <> 0 then name end as name, case when pos % 8 = 0 then 'patent' when pos % 90 = 0 then 'blog' end as source_type"


@query("c16_schema_violations", f"""with n as ({NODE_SCHEMA} from nodes), e as (select *, source || '|' || target || '|' || type as k from ({EDGE_SCHEMA} from edges))
  select rule, entity, count(*) as n from (
   select 'node_name_required' as rule, id as entity from n where name is null
   union all select 'node_id_pattern', id from n where not regexp_matches(id, '^[A-Za-z0-9:_-]+$')
   union all select 'node_type', id from n where type not in ({IN(O.NODE_CODES)})
   union all select 'node_source_type', id from n where source_type not in ('literature', 'patent', 'internal_report', 'lab_notebook', 'database')
   union all select 'edge_confidence_score_required', k from e where confidence_score is null
   union all select 'edge_evidence_quote_required', k from e where evidence_quote is null
   union all select 'edge_source_doi_required', k from e where source_doi is null
   union all select 'edge_type', k from e where type not in ({IN(O.ONTOLOGY_TYPES)})
   union all select 'edge_relation_role', k from e where relation_role not in ('causal', 'structural', 'taxonomic', 'economic', 'operational')
   union all select 'edge_direction', k from e where direction not in ('positive', 'negative', 'neutral')
   union all select 'edge_confidence_score_range', k from e where confidence_score < 0 or confidence_score > 1
   union all select 'edge_co_occurrence_count_range', k from e where co_occurrence_count < 0
  ) group by 1, 2""")
def _(s, d):
    n, e = graph(s, d)
    return build.schema_violations(s.sql(NODE_SCHEMA + " from {n}", n=n), s.sql(EDGE_SCHEMA + " from {e}", e=e))


GOALS = """select c_custkey as goal_id, case c_custkey % 3 when 0 then 'Improve ' || upper(c_name) || ' at lower cost' when 1 then 'A cheaper ' || p_name || ', please' else 'Nothing that is known' end as goal"""


@query("i10_goal_context", f"""with g as (select goal_id, lower(goal) as goal from ({GOALS} from customer left join part on p_partkey = c_custkey)),
  l as (select distinct lower(coalesce(nullif(name, ''), id)) as low, coalesce(nullif(name, ''), id) as label, type from nodes where type in ('Application', 'Material')),
  h as (select goal_id, count(distinct label) filter (type = 'Application') as apps, count(distinct label) filter (type = 'Material') as mats from g join l on contains(goal, low) group by 1)
  select goal_id, case when apps > 0 then 'application' when mats > 0 then 'material' else 'none' end as route, case when apps > 0 then apps when mats > 0 then mats else 0 end as n from g left join h using (goal_id)""")
def _(s, d):
    goals = s.sql(GOALS + " from {c} left join {p} on p_partkey = c_custkey", c=table(s, d, "customer"), p=table(s, d, "part"))
    n, e = graph(s, d)
    return triples.goal_context(goals, n, triples.triples(n, e))


@query("c12_soft_validation", f"with {VALID} select type, count(*) as n from valid group by type")
def _(s, d):
    return build.valid_edges(*graph(s, d)).groupBy("type").agg(F.count("*").alias("n"))


@query("c13_concept_violations", "select 'term_in_aliases' as rule, concept_id from concepts where pos % 4 = 0 union all select 'alias_unique', concept_id from concepts where pos % 6 = 0")
def _(s, d):
    c = table(s, d, "concepts").withColumn("aliases", F.concat(F.when(F.col("pos") % 4 == 0, F.array(F.upper("term"))).otherwise(F.array(F.lit("a b c"))), F.when(F.col("pos") % 6 == 0, F.array(F.lit("Z z 1"), F.lit("z Z 1"))).otherwise(F.array().cast("array<string>"))))
    return build.concept_violations(c)


@query("c14_fill_defaults", "select id, text as name, '' as definition, pos as node_offset, 3 as difficulty from chunks where text <> ''")
def _(s, d):
    c = table(s, d, "chunks").where("text <> ''").select("id", F.lit(None).cast("string").alias("name"), "text", F.lit(None).cast("string").alias("definition"), F.lit(None).cast("bigint").alias("node_offset"), F.lit(None).cast("int").alias("difficulty"))
    return build.fill_defaults(c).drop("text")


@query("c15_normal_types", "select id, case when pos % 5 = 0 then 'Concept' when pos % 5 = 1 then 'Override' else type end as type from nodes")
def _(s, d):
    n = table(s, d, "nodes").withColumns({"ontology_class": F.when(F.col("pos") % 5 == 1, F.lit("Override")).when(F.col("pos") % 5 == 0, F.lit(" ")), "type": F.when(F.col("pos") % 5 == 0, F.lit("")).otherwise(F.col("type"))})
    return build.normal_types(n).select("id", "type")


@query("c17_unseen_slices", "select id from chunks where pos % 3 <> 0")
def _(s, d):
    c = table(s, d, "chunks")
    return build.unseen(c, c.where("pos % 3 = 0")).select("id")


@query("i1_direct_triples", f"with {TRIPLES} select Subject, Rel, Object, n as Count from direct")
def _(s, d):
    return triples.direct_triples(*graph(s, d))


@query("i2_derived_triples", f"with {TRIPLES} select Subject, Rel, Object, cast(n as bigint) as Count from derived")
def _(s, d):
    return triples.derived_triples(*graph(s, d))


@query("i3_triples", f"with {VALID.strip().replace('valid as', 'validx as')}, {TRIPLES.strip()} select * from triples")
def _(s, d):
    return triples.triples(*graph(s, d))


@query("i4_relation_frequency", f"with {TRIPLES} select Rel, count(*) as n from triples group by Rel")
def _(s, d):
    return triples.relation_frequency(triples.triples(*graph(s, d)))


@query("i5_entities", f"with {TRIPLES} select Subject as entity from triples union select Object from triples")
def _(s, d):
    return triples.entities(triples.direct_triples(*graph(s, d)))


@query("i6_labels", "select distinct coalesce(nullif(name, ''), id) as label from nodes where type = 'Application'")
def _(s, d):
    return triples.labels_of(table(s, d, "nodes"), "Application")


@query("i7_known_in_goals", "select distinct 'g' || g.id as goal_id, n.label from nodes g join (select distinct name as label from nodes where type = 'Property') n on contains('improve ' || lower(g.name) || ' now', lower(n.label)) where g.type in ('Property', 'Condition')")
def _(s, d):
    n = table(s, d, "nodes")
    goals = n.where("type in ('Property', 'Condition')").select(F.concat(F.lit("g"), "id").alias("goal_id"), F.concat(F.lit("improve "), F.lower("name"), F.lit(" now")).alias("goal"))
    return triples.known_in_goals(goals, triples.labels_of(n, "Property"))


@query("i8_application_context", f"""with {TRIPLES}, a as (select Subject as application, split_part(Rel, '-', 2) as code, Object as other from triples where split_part(Rel, '-', 1) = 'APL'
   union all select Object, split_part(Rel, '-', 1), Subject from triples where split_part(Rel, '-', 2) = 'APL')
  select application, coalesce(string_agg(distinct case when code = 'CHM' then other end, ';' order by case when code = 'CHM' then other end), '') as materials,
         coalesce(string_agg(distinct case when code = 'PRO' then other end, ';' order by case when code = 'PRO' then other end), '') as properties from a where code in ('CHM', 'PRO') group by 1""")
def _(s, d):
    out = triples.application_context(triples.triples(*graph(s, d)))
    return out.select("application", F.array_join("materials", ";").alias("materials"), F.array_join("properties", ";").alias("properties"))


@query("i9_material_relations", """with own as (select id, material from (select id, coalesce(nullif(name, ''), id) as material, row_number() over (partition by coalesce(nullif(name, ''), id) order by pos, id) as rn from nodes where type = 'Material') where rn = 1),
  near as (select source as id, target as other, type from edges union all select target, source, type from edges)
  select material, near.type, count(*) as n, string_agg(distinct coalesce(nullif(o.name, ''), o.id), ';' order by coalesce(nullif(o.name, ''), o.id)) as entities from near join own using (id) join nodes o on o.id = near.other group by 1, 2""")
def _(s, d):
    return triples.material_relations(*graph(s, d)).withColumn("entities", F.array_join("entities", ";"))


@query("i11_triple_search", f"with {TRIPLES} select Object, cast(sum(Count) as bigint) as Count from triples where contains(lower(Subject), 'ring') and Rel = 'CHM-SYN' group by Object order by 2 desc, 1 limit 20")
def _(s, d):
    return triples.search(triples.triples(*graph(s, d)), "ring", "CHM-SYN")


@query("i12_entity_lookup", f"with {TRIPLES} select distinct entity from (select Subject as entity from triples union select Object from triples) where starts_with(entity, 'Supplier')")
def _(s, d):
    return triples.entity_lookup(triples.direct_triples(*graph(s, d)), "Supplier")


@query("f1_clean_weights", "select source, target, type, case when w > 0 then w else 1e-9 end as weight, least(1 / case when w > 0 then w else 1e-9 end, 1e9) as inverse_weight from (select *, confidence - 0.1e0 as w from edges where source <> target)")
def _(s, d):
    e = table(s, d, "edges").withColumn("weight", F.col("confidence") - 0.1)
    return metrics.clean_weights(e).select("source", "target", "type", "weight", "inverse_weight")


COLLAPSED = "e as (select * from (select *, row_number() over (partition by source, target order by pos desc, type desc) as rn from edges) where rn = 1)"


@query("f2_degrees", f"""with {COLLAPSED}, i as (select target as id, count(*) as n from e group by 1), o as (select source as id, count(*) as n from e group by 1)
  select nodes.id, coalesce(i.n, 0) as degree_in, coalesce(o.n, 0) as degree_out, (coalesce(i.n, 0) + coalesce(o.n, 0)) / ((select count(*) from nodes) - 1) as degree_centrality from nodes left join i using (id) left join o using (id)""")
def _(s, d):
    n, e = graph(s, d)
    return metrics.degrees(n, metrics.collapsed(e))


def pagerank_sql(rounds: int) -> str:
    """Ranks of papers after so many rounds."""
    return f"""with recursive n as (select count(*) as n from documents), e as (select source, target from citations), o as (select source, count(*) as k from e group by 1),
  r(i, id, pr) as (select 0, doc_id, 1.0e0 / n from documents, n
    union all (with g as (select e.target as id, sum(r.pr / o.k) as got from r join e on e.source = r.id join o on o.source = r.id group by 1), lost as (select coalesce(sum(pr), 0) as lost from r where id not in (select source from o)), step as (select max(i) as i from r)
    select step.i + 1, d.doc_id, 0.15e0 / n.n + 0.85e0 * (coalesce(g.got, 0) + lost.lost / n.n) from documents d left join g on g.id = d.doc_id, n, lost, step where step.i < {rounds}))
  select id, round(pr, 8) as pagerank from r where i = {rounds}"""


def settled_sql(types: list[str] | None, weight: str, name: str) -> str:
    """Weighted PageRank of the nodes over the edges of the types: up to 100 rounds, and none after a fifth one that moves less than n * 1e-6."""
    only = f"where type in ({IN(types)})" if types else ""
    return f"""with recursive n as (select count(*) as n from nodes), c as (select *, row_number() over (partition by source, target order by pos desc, type desc) as rn from edges {only}),
  e as (select source, target, {weight} as w from c where rn = 1 and {weight} > 0 and source in (select id from nodes) and target in (select id from nodes)),
  o as (select source, sum(w) as k from e group by 1), p as (select e.source, target, w / k as p from e join o using (source)),
  r(i, id, pr, moved) as (select 0, id, 1.0e0 / n, cast(null as double) from nodes, n
    union all (with g as (select p.target as id, sum(r.pr * p.p) as got from r join p on p.source = r.id group by 1), lost as (select coalesce(sum(pr), 0) as lost from r where id not in (select source from o)), step as (select max(i) as i, sum(moved) as m from r)
    select step.i + 1, r.id, 0.15e0 / n.n + 0.85e0 * (coalesce(g.got, 0) + lost.lost / n.n), abs(0.15e0 / n.n + 0.85e0 * (coalesce(g.got, 0) + lost.lost / n.n) - r.pr)
    from r left join g on g.id = r.id, n, lost, step where step.i < 100 and not (step.i % 5 = 0 and step.i > 0 and step.m < n.n * 1e-6)))
  select id, round(pr, 9) as {name} from r where i = (select max(i) from r)"""


@query("f6_citation_pagerank", pagerank_sql(20))
def _(s, d):
    nodes = table(s, d, "documents").select(F.col("doc_id").alias("id"))
    return metrics.pagerank(nodes, table(s, d, "citations"), rounds=20, tolerance=0, weighted=False).select("id", F.round("pagerank", 8).alias("pagerank"))


@query("f6_citation_pagerank_60", pagerank_sql(60))
def _(s, d):
    nodes = table(s, d, "documents").select(F.col("doc_id").alias("id"))
    return metrics.pagerank(nodes, table(s, d, "citations"), rounds=60, tolerance=0, weighted=False).select("id", F.round("pagerank", 8).alias("pagerank"))


@query("f4_pagerank", settled_sql(None, "coalesce(confidence, 1.0e0)", "pagerank"))
def _(s, d):
    n, e = graph(s, d)
    return metrics.pagerank(n, metrics.collapsed(e).withColumn("weight", F.coalesce("confidence", F.lit(1.0)))).select("id", F.round("pagerank", 9).alias("pagerank"))


@query("f5_relation_pagerank", settled_sql(O.ONTOLOGICAL_EDGES, "1.0e0", "pagerank"))
def _(s, d):
    n, e = graph(s, d)
    return metrics.pagerank(n, metrics.collapsed(e.where(F.col("type").isin(*O.ONTOLOGICAL_EDGES)))).select("id", F.round("pagerank", 9).alias("pagerank"))


@query("f9_components", """with recursive e as (select source as u, target as v from edges where type = 'REQUIRES_CONDITION' union all select target, source from edges where type = 'REQUIRES_CONDITION'),
  r(id, lab) as (select id, id from nodes union select e.v, r.lab from r join e on e.u = r.id)
  select nodes.id, min(lab) as label from nodes join r using (id) group by 1""")
def _(s, d):
    from graphloom.operators.components import connected_components

    n, e = graph(s, d)
    found = connected_components(e.where("type = 'REQUIRES_CONDITION'"), "source", "target")
    return n.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


@query("f13_material_counters", """select n.id, coalesce(t.k, 0) as synthesis_diversity, coalesce(s.a, 0) as property_coverage, coalesce(s.b, 0) as application_breadth, cast(0 as bigint) as characterization_richness, coalesce(s.c, 0) as failure_modes
  from nodes n left join (select target as id, count(*) as k from edges where type = 'SYNTHESIZED_BY' group by 1) t using (id)
  left join (select source as id, count(*) filter (type in ('IMPROVES', 'DEGRADES', 'CHARACTERIZED_BY')) as a, count(*) filter (type = 'APPLIED_IN') as b, count(*) filter (type = 'HAS_FAILURE_MODE') as c from edges group by 1) s using (id)""")
def _(s, d):
    return metrics.material_counters(*graph(s, d))


@query("f14_proximity", """with recursive e as (select distinct source, target from edges), r(goal, id, d) as (select id, id, 0 from nodes where type = 'Condition' union select r.goal, e.source, r.d + 1 from r join e on e.target = r.id where r.d < 5)
  select n.id, coalesce(max(1.0e0 / (m.d + 1)), 0) as proximity from nodes n left join (select goal, id, min(d) as d from r group by 1, 2) m on m.id = n.id and m.goal <> m.id group by 1""")
def _(s, d):
    n, e = graph(s, d)
    return metrics.proximity(n, e, "Condition")


@query("f16_bridge_scores", """with b as (select source as id, target as other from edges union select target, source from edges), s as (select b.id, avg(case when x.cluster_id <> y.cluster_id then 1.0e0 else 0.0e0 end) as share from b join nodes x on x.id = b.id join nodes y on y.id = b.other where b.id <> b.other group by 1)
  select n.id, round(0.7e0 * n.betweenness + 0.3e0 * coalesce(s.share, 0), 9) as bridge_score from metric_nodes n left join s using (id)""")
def _(s, d):
    return metrics.bridge_scores(*metric_graph(s, d)).select("id", F.round("bridge_score", 9).alias("bridge_score"))


@query("f17_inter_cluster", "select e.source, e.target, e.type, e.pos, s.cluster_id as source_cluster, t.cluster_id as target_cluster, s.cluster_id <> t.cluster_id as is_inter_cluster from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target")
def _(s, d):
    return metrics.inter_cluster(*graph(s, d)).select("source", "target", "type", "pos", "source_cluster", "target_cluster", "is_inter_cluster")


@query("f18_f19_assembled", "select id, type, case when pos % 7 = 0 then 0.0 else effort end as effort, coalesce(case when pos % 7 = 0 then null else effort end, 0.0) as safe from metric_nodes where pos % 71 <> 0")
def _(s, d):
    n = table(s, d, "metric_nodes").where("pos % 71 <> 0")
    raw = n.select("id", F.when(F.col("pos") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("effort")).alias("effort"), F.when(F.col("pos") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("effort")).alias("safe"))
    return metrics.assembled(n.select("id", "type"), raw)


@query("f20_mention_index", """with b as (select source as id, target as other from edges union select target, source from edges) select id as concept_id, string_agg(other, ',' order by other) as nodes, count(*) as n from b where id <> other and id in (select id from nodes where type = 'Property') group by 1""")
def _(s, d):
    n, e = graph(s, d)
    n = n.withColumn("type", F.when(F.col("type") == "Property", "Concept").otherwise(F.col("type")))
    return metrics.mention_index(n, e).withColumn("nodes", F.array_join("nodes", ","))


@query("f21_node_concepts", """with b as (select source as id, target as other from edges union select target, source from edges), c as (select id, string_agg(other, ',' order by other) as concepts from b where id <> other and other in (select id from nodes where type in ('Property', 'Condition')) group by 1)
  select nodes.id, coalesce(concepts, '') as concepts from nodes left join c using (id)""")
def _(s, d):
    return metrics.node_concepts(*graph(s, d), ["Property", "Condition"]).withColumn("concepts", F.array_join("concepts", ","))


@query("f22_largest", "with t as (select id from metric_nodes order by pagerank desc, id limit 500) select source, target, type, pos from edges where source in (select id from t) and target in (select id from t)")
def _(s, d):
    return metrics.largest(*metric_graph(s, d), n=500)[1].select("source", "target", "type", "pos")


@query("f23_course_sequence", "select id, pos as position from chunks")
def _(s, d):
    return metrics.course_sequence(table(s, d, "chunks"))


@query("f25_cluster_tour", """with t as (select *, row_number() over (partition by cluster_id order by pagerank desc, id) as rn from metric_nodes), a as (select cluster_id, avg(cast(depth as double)) as p from metric_nodes group by 1)
  select row_number() over (order by p, cluster_id) as step, cluster_id, id from t join a using (cluster_id) where rn = 1""")
def _(s, d):
    return metrics.cluster_tour(table(s, d, "metric_nodes"))


@query("f27_compared", "select id, 'pagerank' as metric, case when pos % 9 = 0 then 'MISS' when pos % 5 = 0 and pagerank <> 0 then 'FAIL' else 'PASS' end as status from metric_nodes")
def _(s, d):
    n = table(s, d, "metric_nodes")
    want = n.select("id", F.lit("pagerank").alias("metric"), F.col("pagerank").alias("value"))
    have = n.where("pos % 9 <> 0").select("id", F.lit("pagerank").alias("metric"), (F.col("pagerank") * F.when(F.col("pos") % 5 == 0, 1.02).otherwise(1.002)).alias("value"))
    return metrics.compared(want, have)


@query("g1_sums_to_one", "select 'pagerank' as metric, round(sum(pagerank), 6) as total, abs(sum(pagerank) - 1) <= 0.01 as ok from metric_nodes")
def _(s, d):
    return quality.sums_to_one(table(s, d, "metric_nodes"))


@query("g2_components", "select min(component_id) as low, max(component_id) as high, count(distinct component_id) as n, min(component_id) = 0 and max(component_id) = count(distinct component_id) - 1 as ok from metric_nodes")
def _(s, d):
    return quality.sequential_components(table(s, d, "metric_nodes"))


@query("g3_negative_depths", "select count(*) as n from metric_nodes where depth < 0")
def _(s, d):
    return quality.negative_depths(table(s, d, "metric_nodes"))


LONG = "l as (unpivot (select id, betweenness::double as betweenness, pagerank::double as pagerank, bridge_score::double as bridge_score, importance::double as importance, depth::double as depth, effort::double as effort from metric_nodes) on betweenness, pagerank, bridge_score, importance, depth, effort into name metric value value)"


@query("g4_g5_bad_values", """select metric, count(*) filter (v is null) as missing, cast(0 as bigint) as nan, cast(0 as bigint) as infinite from (
   select 'betweenness' as metric, betweenness as v from metric_nodes union all select 'pagerank', pagerank from metric_nodes union all select 'bridge_score', bridge_score from metric_nodes
   union all select 'importance', importance from metric_nodes union all select 'depth', depth from metric_nodes union all select 'effort', effort from metric_nodes) group by 1""")
def _(s, d):
    return quality.bad_values(table(s, d, "metric_nodes"))


@query("g6_coverage", "select count(*) as edges, count(confidence) as covered from edges")
def _(s, d):
    return quality.coverage(table(s, d, "edges"), "confidence")


@query("g7_mutual_pairs", "select distinct x.source as a, x.target as b from edges x join edges y on x.source = y.target and x.target = y.source and x.type = y.type where x.source < x.target and x.type = 'SYNTHESIZED_BY'")
def _(s, d):
    return quality.mutual_pairs(table(s, d, "edges"), "SYNTHESIZED_BY")


@query("g8_cluster_quality", "with c as (select cluster_id, count(*) as n from metric_nodes group by 1) select count(*) as clusters, cast(0 as bigint) as unclustered, count(*) filter (n = 1) as singletons, round(1 - count(*) / sum(n), 6) as estimate from c")
def _(s, d):
    return quality.cluster_quality(table(s, d, "metric_nodes"))


@query("g9_bridge_quality", """with t as (select bridge_score from metric_nodes order by betweenness desc, id limit 10), m as (select round(avg(bridge_score), 6) as top_mean from t)
  select count(*) filter (bridge_score < 0 or bridge_score > 1) as out_of_range, count(*) filter (bridge_score > 0) as positive, any_value(top_mean) as top_mean, any_value(top_mean) >= 0.1 as ok from metric_nodes, m""")
def _(s, d):
    return quality.bridge_quality(table(s, d, "metric_nodes"))


@query("g10_iqr_outliers", f"""with {LONG}, r as (select *, row_number() over (partition by metric order by value) - 1 as i, count(*) over (partition by metric) as n from l where value is not null),
  q as (select metric, min(case when i = n // 4 then value end) as q1, min(case when i = 3 * n // 4 then value end) as q3 from r where n >= 4 group by 1)
  select id, metric, value from r join q using (metric) where q3 > q1 and (value < q1 - 1.5e0 * (q3 - q1) or value > q3 + 1.5e0 * (q3 - q1))""")
def _(s, d):
    return quality.iqr_outliers(table(s, d, "metric_nodes"))


@query("g11_sigma_outliers", f"with {LONG}, m as (select metric, avg(value) as m, stddev_pop(value) as s from l group by 1) select id, metric, value from l join m using (metric) where s > 0 and abs(value - m) > 1.5e0 * s")
def _(s, d):
    return quality.sigma_outliers(table(s, d, "metric_nodes"), 1.5)


@query("g12_orphans", "select id, type from nodes where id not in (select source from edges) and id not in (select target from edges)")
def _(s, d):
    return quality.orphans(*graph(s, d))


@query("g13_without_edge", "select id from nodes where type = 'Material' and id not in (select source from edges where type = 'APPLIED_IN')")
def _(s, d):
    return quality.without_edge(*graph(s, d), "Material", "APPLIED_IN")


@query("g14_cycle", "select distinct type, type in ('SYNTHESIZED_BY') as cyclic from (select 'SYNTHESIZED_BY' as type union all select 'REQUIRES_CONDITION')")
def _(s, d):
    e = table(s, d, "edges")
    rows = [(t, quality.has_cycle(e.where(F.col("type") == t))) for t in ("SYNTHESIZED_BY", "REQUIRES_CONDITION")]
    return s.createDataFrame(rows, "type string, cyclic boolean")


@query("g15_statistics", f"with {LONG} select metric, round(min(value), 6) as low, round(max(value), 6) as high, round(avg(value), 6) as mean, count(*) as n, round(stddev_pop(value), 6) as deviation from l group by 1")
def _(s, d):
    return quality.statistics(table(s, d, "metric_nodes"))


@query("g16_sizes", "select 'component' as kind, component_id::varchar as key, count(*) as n from metric_nodes group by 2 union all select 'cluster', cluster_id::varchar, count(*) from metric_nodes group by 2 union all select 'type', type, count(*) from metric_nodes group by 2")
def _(s, d):
    return quality.sizes(table(s, d, "metric_nodes"))


@query("g17_status")
def _(s, d):
    return quality.status(quality.issues(*metric_graph(s, d)))


@query("g18_diagnostics", """with b as (select distinct source || '|' || target || '|' || type as entity from edges where source not in (select id from nodes) or target not in (select id from nodes)), c as (select concept_id as entity from concepts)
  (select 'dangling_edge' as kind, entity, (select count(*) from b) as total from b order by entity limit 10) union all (select 'unknown_concept', entity, (select count(*) from c) from c order by entity limit 10)""")
def _(s, d):
    return quality.diagnostics(*graph(s, d), table(s, d, "concepts"))


@query("h1_clusters", "select distinct cluster_id from nodes")
def _(s, d):
    return clusters.cluster_list(table(s, d, "nodes"))


ENDS = "ends as (select e.*, s.cluster_id as c1, t.cluster_id as c2 from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target)"


@query("h2_cluster_summary", f"with {ENDS} select n.cluster_id, count(*) as nodes, (select count(*) from ends where c1 = c2 and c1 = n.cluster_id) as intra, (select count(*) from ends where c1 <> c2 and (c1 = n.cluster_id or c2 = n.cluster_id)) as inter from nodes n group by 1")
def _(s, d):
    return clusters.cluster_subgraphs(*graph(s, d))[2]


@query("h2_cluster_edges", f"with {ENDS} select source, target, type, pos, c1 as cluster_id from ends where c1 = c2")
def _(s, d):
    return clusters.cluster_subgraphs(*graph(s, d))[1].select("source", "target", "type", "pos", "cluster_id")


@query("h3_cluster_dictionary", """with b as (select source as id, target as other from edges union select target, source from edges) select distinct n.cluster_id, b.other as concept_id, case when c.pos % 2 = 0 then c.name end as term, c.pos % 2 <> 0 as missing, c.cluster_id as concept_cluster from nodes n join b using (id) join nodes c on c.id = b.other where c.type in ('Property', 'Condition') and b.id <> b.other""")
def _(s, d):
    n, e = graph(s, d)
    own = metrics.node_concepts(n, e, ["Property", "Condition"]).join(n.select("id", "cluster_id"), "id")
    known = n.where("type in ('Property', 'Condition') and pos % 2 = 0").select(F.col("id").alias("concept_id"), F.col("name").alias("term"))
    return clusters.cluster_dictionary(own, known, n).select("cluster_id", "concept_id", "term", "missing", "concept_cluster")


@query("h4_node_order", "select id, row_number() over (order by type <> 'Property', case when type = 'Property' then id end, pos, id) as place from nodes")
def _(s, d):
    kind = F.when(F.col("type") == "Property", "Concept").otherwise(F.col("type"))
    return clusters.placed(clusters.node_order(table(s, d, "nodes").withColumn("type", kind))).select("id", "place")


@query("h5_cluster_links", f"""with x as (select e.source, e.target, e.type, e.pos, s.cluster_id as c1, t.cluster_id as c2, s.name as sn, t.name as tn, s.importance as imp from edges e join metric_nodes s on s.id = e.source join metric_nodes t on t.id = e.target where s.cluster_id <> t.cluster_id and e.type in ({IN(clusters.LINK_TYPES)})),
  y as (select 'outgoing' as direction, c1 as cluster_id, * from x union all select 'incoming', c2, * from x), r as (select *, row_number() over (partition by cluster_id, direction order by imp desc, pos, type, source, target) as rank from y)
  select direction, cluster_id, source, target, type, sn as source_text, tn as target_text, imp as importance, rank from r where rank <= 3""")
def _(s, d):
    return clusters.inter_cluster_links(*metric_graph(s, d))


@query("h6_cluster_metadata", f"with {ENDS} select n.cluster_id, 'Graph - cluster ' || n.cluster_id as title, 'Cluster ' || n.cluster_id || ': ' || count(*) || ' nodes, ' || (select count(*) from ends where c1 = c2 and c1 = n.cluster_id) || ' edges' as subtitle from nodes n group by 1")
def _(s, d):
    return clusters.cluster_metadata(clusters.cluster_subgraphs(*graph(s, d))[2], "Graph")


@query("h7_marked", "select id, case when definition is not null and trim(definition) <> '' and not regexp_matches(definition, 'TIN$') then '[AI] ' || definition else definition end as definition from nodes")
def _(s, d):
    return clusters.marked(table(s, d, "nodes"), "definition", skip="TIN$").select("id", "definition")


@query("h8_concept_text", "select id, name || case when pos % 2 = 0 then ' (a, b)' else '' end as text, pos % 2 = 0 as changed from nodes where type = 'Property'")
def _(s, d):
    n = table(s, d, "nodes").where("type = 'Property'")
    known = n.select(F.col("id").alias("concept_id"), F.col("name").alias("term"), F.when(F.col("pos") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("aliases"))
    return clusters.concept_text(n.select("id", F.lit("Concept").alias("type"), F.col("name").alias("text")), known)


@query("h9_dry_run", "with x as (select id, definition as old, '[AI] ' || definition as new from nodes where definition is not null) select *, (select count(*) from x) as changes from x order by id limit 5")
def _(s, d):
    n = table(s, d, "nodes")
    return clusters.dry_run(n, clusters.marked(n, "definition"), "definition")


GAP = "case when v < 0.05 then 0.05 when v > 0.98 then 0.98 else v end"
TYPED = "typed as (select e.*, s.type as st, t.type as tt, t.name as tn from edges e left join nodes s on s.id = e.source left join nodes t on t.id = e.target)"


def gap(name: str, body: str, op) -> None:
    sql = f"with {TYPED}, g as ({body}) select '{name}:' || id as gap_id, '{name}' as category, round({GAP.replace('v', 'round(v, 2)')}, 2) as confidence from g"

    def run(s, d):
        return op(*metric_graph(s, d)).select("gap_id", "category", F.round("confidence", 2).alias("confidence"))

    query({"synthesis_gap": "j1", "kpi_gap": "j2", "mitigation_gap": "j3", "control_point": "j4", "chain_gap": "j5", "kpi_target_gap": "j6", "outcome_gap": "j7", "bridge": "j8", "entry_point": "j9"}[name] + "_" + name, sql)(run)


gap("synthesis_gap", "select id, 0.62e0 as v from metric_nodes where type = 'Material' and id not in (select source from typed where tt = 'SynthesisMethod')", gaps.no_synthesis)
gap("kpi_gap", "select n.id, 0.58e0 + 0.04e0 * count(t.source) as v from metric_nodes n left join typed t on t.target = n.id and t.st = 'Material' where n.type = 'Property' group by 1 having count(t.source) <= 1", gaps.sparse_kpis)
gap("mitigation_gap", "select n.id, 0.66e0 - 0.02e0 * count(t.source) as v from metric_nodes n left join typed t on t.target = n.id where n.type = 'Condition' group by 1", lambda n, e: gaps.unmitigated(n, e, "Condition"))
gap("control_point", "select n.id, 0.55e0 + n.betweenness * 0.5e0 + n.pagerank * 2 as v from metric_nodes n join (select source as id from typed group by 1 having count(*) filter (type = 'DEGRADES') > 0 and count(*) filter (type = 'IMPROVES') = 0) x using (id) where n.betweenness >= 0.05 or n.pagerank >= 0.01", gaps.only_degrading)
gap("chain_gap", "select id, 0.5e0 + depth * 0.03e0 as v from metric_nodes where depth >= 3 and id not in (select source from typed where tt in ('Property', 'Concept'))", gaps.broken_chain)
gap("kpi_target_gap", "select n.id, 0.6e0 + 0.02e0 * k as v from metric_nodes n join (select source as id, count(*) as k from typed where tt = 'Property' group by 1) x using (id) where type = 'Material' and k >= 2", gaps.no_kpi_target)
gap("outcome_gap", "select distinct target || '/' || source as id, 0.57e0 as v from typed where st = 'Material' and tt = 'SynthesisMethod' and source not in (select source from typed where tt = 'Property')", gaps.no_outcome)
gap("bridge", "select n.id, 0.64e0 + n.bridge_score * 0.2e0 as v from metric_nodes n where n.bridge_score >= 0.5 and n.id in (select id from (select source as id, target as o from edges union all select target, source from edges) b join nodes x using (id) join nodes y on y.id = b.o where x.cluster_id <> y.cluster_id group by 1 having count(*) >= 2)", gaps.bridges)
gap("entry_point", "select id, 0.52e0 + importance * 2 as v from metric_nodes where importance > 0.05 and depth <= 1", lambda n, e: gaps.entry_points(n))


@query("j10_evidence", """with g as (select 'entry_point:' || id as gap_id, id from metric_nodes where importance > 0.05 and depth <= 1), b as (select source as id, source, target, type, pos from edges union all select target, source, target, type, pos from edges),
  f as (select distinct gap_id, source, target, type, pos from g join b using (id)), r as (select *, row_number() over (partition by gap_id order by pos, type, source, target) as rank from f) select gap_id, source, target, type, rank from r where rank <= 3""")
def _(s, d):
    n, e = metric_graph(s, d)
    return gaps.evidence(gaps.entry_points(n), e)


@query("j11_gap_edges", f"with {TYPED}, p as (select distinct target as m, source as x from typed where st = 'Material' and tt = 'SynthesisMethod' and source not in (select source from typed where tt = 'Property')) select distinct 'outcome_gap:' || m || '/' || x as gap_id, e.source, e.target, e.type from p join edges e on e.source in (m, x) and e.target in (m, x)")
def _(s, d):
    n, e = metric_graph(s, d)
    return gaps.gap_edges(gaps.no_outcome(n, e), e)


@query("j12_ranked_gaps")
def _(s, d):
    return gaps.ranked_gaps(gaps.all_gaps(*metric_graph(s, d)))


@query("j13_suggestions", "with r as (select conv_id as run, turn, row_number() over (partition by conv_id order by turn) as number from conversations) select run, number, 'turn ' || turn as suggestion from r")
def _(s, d):
    c = table(s, d, "conversations").groupBy(F.col("conv_id").alias("run")).agg(F.to_json(F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("Suggestion_"), (F.col("turn") + 7).cast("string")), F.concat(F.lit("turn "), "turn"))))).alias("reply"))
    return gaps.suggestions(c)


@query("j14_verdicts", "select conv_id as run, case when count(*) filter (length(text) % 3 = 0) > 0 then 'NO' else 'YES' end as final, count(*) filter (length(text) % 3 = 0) as noes, count(*) as votes from conversations group by 1")
def _(s, d):
    return gaps.verdicts(table(s, d, "conversations").select(F.col("conv_id").alias("run"), F.when(F.length("text") % 3 == 0, "no").otherwise("YES").alias("verdict")))


@query("j15_unanimous", "select conv_id as run, turn // 4 as suggestion, case when count(distinct turn) >= 4 and bool_and(length(text) % 7 <> 0) then 'YES' else 'NO' end as final from conversations group by 1, 2")
def _(s, d):
    votes = table(s, d, "conversations").select(F.col("conv_id").alias("run"), F.floor(F.col("turn") / 4).alias("suggestion"), F.col("turn").alias("critic"), F.when(F.length("text") % 7 == 0, "NO").otherwise("YES").alias("verdict"))
    return gaps.unanimous(votes)


@query("k1_upsert", "select n.id, case when pos % 3 = 0 then 'new' else name end as name, case when pos % 3 = 0 then 'updated' else 'kept' end as state from nodes n union all select 'x' || id, 'new', 'added' from nodes where pos % 3 = 0")
def _(s, d):
    n = table(s, d, "nodes").select("id", "name")
    fresh = table(s, d, "nodes").where("pos % 3 = 0").select(F.explode(F.array("id", F.concat(F.lit("x"), "id"))).alias("id"), F.lit("new").alias("name"))
    return browse.upsert(n, fresh, ["id"]).select("id", "name", F.col("_state").alias("state"))


@query("k2_upsert_counts", "select count(*) filter (pos % 4 = 0) as added, count(*) filter (pos % 4 = 0) as updated, count(*) + count(*) filter (pos % 4 = 0) as total from concepts")
def _(s, d):
    c = table(s, d, "concepts").select("concept_id", "term")
    fresh = table(s, d, "concepts").where("pos % 4 = 0").select(F.explode(F.array("concept_id", F.concat(F.lit("x"), "concept_id"))).alias("concept_id"), F.lit("new").alias("term"))
    return browse.upsert_counts(browse.upsert(c, fresh, ["concept_id"]))


@query("k3_load_status", "select (select count(*) from metric_nodes) as nodes, (select count(distinct type) from metric_nodes) as types, 'closeness' as missing, (select count(*) from edges) as edges, false as ready")
def _(s, d):
    return browse.load_status(*metric_graph(s, d), ["pagerank", "betweenness", "closeness"]).withColumn("missing", F.array_join("missing", ","))


@query("k4_search", "with x as (select id, type, name from nodes where type in ('Material', 'Condition') and (contains(lower(id), '7') or contains(lower(name), '7') or contains(lower(coalesce(definition, '')), '7'))) select *, (select count(*) from nodes) as total, (select count(*) from x) as shown from x")
def _(s, d):
    return browse.search_nodes(table(s, d, "nodes"), "7", ["Material", "Condition"])


@query("k5_browse_order", "select id, cluster_id from nodes")
def _(s, d):
    return browse.browse_order(table(s, d, "nodes")).select("id", "cluster_id")


@query("k6_incident", f"with r as (select * from {O.values([(t, k) for k, t in enumerate(O.ONTOLOGY)])} r(type, rank)), x as (select source as id, 'out' as direction, target as other, type from edges where source in (select id from nodes where type = 'SynthesisMethod') union all select target, 'in', source, type from edges where target in (select id from nodes where type = 'SynthesisMethod')) select x.*, r.rank from x join r using (type)")
def _(s, d):
    n, e = graph(s, d)
    return browse.incident(e, n.where("type = 'SynthesisMethod'").select("id"))


@query("k7_top_nodes", "select * from (select 'pagerank' as metric, row_number() over (order by pagerank desc, id) as place, id from metric_nodes union all select 'betweenness', row_number() over (order by betweenness desc, id), id from metric_nodes) where place <= 5")
def _(s, d):
    return browse.top_nodes(table(s, d, "metric_nodes"), ["pagerank", "betweenness"])


@query("k8_dictionary", "select concept_id, term, (select count(*) from chunks c where c.pos % 40 = concepts.pos) as mentions from concepts")
def _(s, d):
    c = table(s, d, "chunks").groupBy(F.concat(F.lit("con_"), (F.col("pos") % 40).cast("string")).alias("concept_id")).agg(F.count("*").alias("n"))
    return browse.dictionary(table(s, d, "concepts"), c)


@query("k9_summary", "select 'node' as kind, type as key, count(*) as n from metric_nodes group by 2 union all select 'edge', type, count(*) from edges group by 2 union all select 'component', 'all', count(distinct component_id) from metric_nodes union all select 'cluster', 'all', count(distinct cluster_id) from metric_nodes")
def _(s, d):
    return browse.summary(*metric_graph(s, d))


@query("k10_categories", f"with c as (select * from {O.values([(t, c) for c, ts in browse.CATEGORIES.items() for t in ts])} c(type, category)) select coalesce(category, 'unknown') as category, string_agg(distinct edges.type, ',' order by edges.type) as types, count(*) as n from edges left join c using (type) group by 1")
def _(s, d):
    return browse.categories(table(s, d, "edges"))


@query("k11_by_depth", "select coalesce(depth, 0) as depth, count(*) as n, min(id) as first from metric_nodes group by 1")
def _(s, d):
    return browse.by_depth(table(s, d, "metric_nodes"))


@query("k12_bridge_nodes", "select id, cluster_id, cluster_id % 12 as color from metric_nodes where bridge_score > 0.7")
def _(s, d):
    return browse.bridge_nodes(table(s, d, "metric_nodes"))


@query("k13_shared_concepts", "select lang as concept_id, string_agg(distinct source, ',' order by source) as graphs, count(distinct source) as n from documents group by 1 having count(distinct source) > 1")
def _(s, d):
    return browse.shared_concepts(table(s, d, "documents").select(F.col("source").alias("graph"), F.col("lang").alias("concept_id")))


@query("k14_merged_edges", """with m as (select id, 'prp_0' as master from nodes where type = 'Property' and pos % 2 = 1), x as (select coalesce(a.master, e.source) as source, coalesce(b.master, e.target) as target, e.type, e.pos from edges e left join m a on a.id = e.source left join m b on b.id = e.target)
  select source, target, type, min(pos) as pos from x where source <> target group by 1, 2, 3""")
def _(s, d):
    n, e = graph(s, d)
    return browse.merged_edges(e, n.where("type = 'Property' and pos % 2 = 1").select("id", F.lit("prp_0").alias("master"))).select("source", "target", "type", "pos")


@query("k15_soft_deleted", "with x as (select id from nodes where cluster_id = 3) select source, target, type, pos from edges where source not in (select id from x) and target not in (select id from x)")
def _(s, d):
    return browse.soft_deleted(*graph(s, d), 3)[1].select("source", "target", "type", "pos")
