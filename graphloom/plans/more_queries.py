"""Registered queries of the iterative graph operators, paths, and sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import ontology as O
from graphloom.functions.shared import shared_dir
from graphloom.operators import metrics, paths
from graphloom.plans.graph_queries import graph, settled_sql
from graphloom.plans.tables import table, with_tables
from graphloom.sources import files

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_tables(sql)
        return f

    return keep


def plants(s, d):
    """Suppliers, nations and regions with the edges between them: small at every scale factor."""
    n, e = graph(s, d)
    up = table(s, d, "supplier").select(F.concat(F.lit("syn_"), "s_suppkey").alias("source"), F.concat(F.lit("prp_"), "s_nationkey").alias("target"), F.lit("IMPROVES").alias("type"), F.lit(0.5).alias("weight"), F.col("s_suppkey").cast("bigint").alias("pos"))
    on = table(s, d, "nation").select(F.concat(F.lit("prp_"), "n_nationkey").alias("source"), F.concat(F.lit("cnd_"), "n_regionkey").alias("target"), F.lit("CAUSES").alias("type"), F.lit(1.0).alias("weight"), F.col("n_nationkey").cast("bigint").alias("pos"))
    return n.where("type in ('SynthesisMethod', 'Property', 'Condition')"), up.unionByName(on)


def whole(s, d):
    """All nodes, and all edges between them: of parallel ones the last, weighted by their confidence."""
    n, e = graph(s, d)
    ids = n.select("id")
    inside = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return n, metrics.clean_weights(metrics.collapsed(inside.withColumn("weight", F.col("confidence"))))


CHAIN = "s as (select s_suppkey, s_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey), n as (select (select count(*) from supplier) + (select count(*) from nation) + (select count(*) from region) as n)"


@query("f7_betweenness", f"with {CHAIN}, b as (select 'prp_' || s_nationkey as id, count(*) as k from s group by 1) select id, round(coalesce(k, 0) / cast((n - 1) * (n - 2) as double), 9) as betweenness from (select id from nodes where type in ('SynthesisMethod', 'Property', 'Condition')) x left join b using (id), n")
def _(s, d):
    n, e = plants(s, d)
    return metrics.betweenness(n, metrics.clean_weights(e)).select("id", F.round("betweenness", 9).alias("betweenness"))


@query("f7_betweenness_pivots")
def _(s, d):
    n, e = whole(s, d)
    return metrics.betweenness(n, e, n.where("pos % 20 = 0")).select("id", F.round("betweenness", 9).alias("betweenness"))


@query("f8_closeness", f"with {CHAIN} select id, round(case when type = 'SynthesisMethod' then (2 / (n - 1.0e0)) * (2 / 5.0e0) when type = 'Property' then (1 / (n - 1.0e0)) * 1 else 0.0e0 end, 9) as out_closeness from nodes, n where type in ('SynthesisMethod', 'Property', 'Condition')")
def _(s, d):
    n, e = plants(s, d)
    return metrics.closeness(n, metrics.clean_weights(e)).select("id", F.round("out_closeness", 9).alias("out_closeness"))


@query("f10_f11_prerequisites", """with s as (select s_suppkey, s_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey),
  v as (select id, type, pos, difficulty * 1.0e0 as d from nodes where type in ('SynthesisMethod', 'Property', 'Condition')),
  p as (select v.id, v.pos, v.d + coalesce(max(x.d), 0) as e, case when max(x.d) is null then 0 else 1 end as k from v left join s on s.s_nationkey = v.pos left join v x on x.id = 'syn_' || s.s_suppkey where v.type = 'Property' group by 1, 2, v.d)
  select id, 0 as prerequisite_depth, d as learning_effort from v where type = 'SynthesisMethod' union all select id, k, e from p
  union all select v.id, coalesce(max(p.k) + 1, 0), v.d + coalesce(max(p.e), 0) from v left join nation on n_regionkey = v.pos left join p on p.pos = n_nationkey where v.type = 'Condition' group by v.id, v.d""")
def _(s, d):
    return metrics.prerequisites(*plants(s, d))


@query("f12_importance", settled_sql(O.IMPORTANT_EDGES, "1.0e0", "importance"))
def _(s, d):
    n, e = graph(s, d)
    return metrics.pagerank(n, metrics.collapsed(e.where(F.col("type").isin(*O.IMPORTANT_EDGES)))).select("id", F.round("pagerank", 9).alias("importance"))


@query("f15_communities")
def _(s, d):
    return metrics.communities(*whole(s, d))


@query("f7_betweenness_whole")
def _(s, d):
    return metrics.betweenness(*whole(s, d)).select("id", F.round("betweenness", 9).alias("betweenness"))


@query("f8_closeness_whole")
def _(s, d):
    return metrics.closeness(*whole(s, d)).select("id", F.round("out_closeness", 9).alias("out_closeness"))


@query("f9_components_whole")
def _(s, d):
    """Weights and parallel edges join nothing, so the edges are taken as they are; those with an end that is no node are left out."""
    return metrics.component_ids(*graph(s, d), order="id", within=True)


@query("f10_f11_prerequisites_whole")
def _(s, d):
    return metrics.prerequisites(*whole(s, d))


@query("n1_shortest_path")
def _(s, d):
    n, e = graph(s, d)
    return paths.shortest_path(n, e, "mat_3", "cnd_1")


@query("n2_easiest_path")
def _(s, d):
    n, e = graph(s, d)
    return paths.easiest_path(n, e.withColumn("weight", F.col("confidence")), "mat_3", "cnd_1", 1.0, 0.5, 0.25)


@query("n3_ladder_path")
def _(s, d):
    n, e = graph(s, d)
    return paths.ladder_path(n, e, "mat_3", "cnd_1", [["SUBSTITUTE_FOR"], ["SYNTHESIZED_BY", "REQUIRES_CONDITION"]])


@query("a3_graph_round_trip", "select id, type, pos from (select id, type, row_number() over (partition by cluster_id, pos // 500 order by id) - 1 as pos from nodes where type <> 'Application')")
def _(s, d):
    where = shared_dir(s)
    n = table(s, d, "nodes").where("type <> 'Application'")
    docs = n.groupBy("cluster_id", F.floor(F.col("pos") / 500)).agg(  # a bounded number of nodes a document
        F.array_sort(F.collect_list(F.struct("id", "type", "name"))).alias("nodes"), F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit("X").alias("type"))).alias("edges")
    ).select("nodes", "edges")
    docs.write.option("maxRecordsPerFile", 1).json(where)
    return files.read_graph(s, where)[0].select("id", "type", F.col("pos").cast("bigint").alias("pos"))


@query("a4_concepts_round_trip", "select concept_id, term from concepts")
def _(s, d):
    where = shared_dir(s)
    c = table(s, d, "concepts").select("concept_id", F.struct(F.col("term").alias("primary"), F.array(F.lit("x")).alias("aliases")).alias("term"), "definition", F.floor(F.col("pos") / 500).alias("k"))
    c.groupBy("k").agg(F.collect_list(F.struct("concept_id", "term", "definition")).alias("concepts")).drop("k").write.option("maxRecordsPerFile", 1).json(where)
    return files.read_concepts(s, where).select("concept_id", "term")


@query("a5_works_round_trip", "select 'W' || doc_id as id, text as title from documents")
def _(s, d):
    where = shared_dir(s)
    w = table(s, d, "documents").select(F.struct(F.concat(F.lit("W"), "doc_id").alias("id"), F.col("text").alias("display_name")).alias("w"), F.floor(F.col("doc_id") / 200).alias("k"))
    w.groupBy("k").agg(F.collect_list("w").alias("results")).drop("k").write.option("maxRecordsPerFile", 1).json(where)
    return files.read_works(s, where).select("id", F.col("display_name").alias("title"))


@query("a8_merged_meta", "select 'rows' as key, count(*)::varchar as value from nodes union all select 'old', 'kept' union all select 'name', 'new'")
def _(s, d):
    old = s.range(1).select(F.create_map(F.lit("old"), F.lit("kept"), F.lit("name"), F.lit("old")).alias("meta"))
    new = table(s, d, "nodes").agg(F.create_map(F.lit("rows"), F.count("*").cast("string"), F.lit("name"), F.lit("new")).alias("meta"))
    return files.merged_meta(old, new).select(F.explode("meta").alias("key", "value"))


@query("a11_ranked_outputs", "select doc_id as paper_id, length(text) as full_text_chars from documents")
def _(s, d):
    where = shared_dir(s)
    p = table(s, d, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("full_text"))
    files.write_ranked(p, p.select("paper_id"), where)
    return s.read.schema("paper_id bigint, full_text_chars bigint").json(f"{where}/papers")


@query("a15_file_list", "select source as folder, cast(sum(coalesce(strlen(text), 0) + 1) as bigint) as bytes from documents group by 1")
def _(s, d):
    where = shared_dir(s)
    table(s, d, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(where)
    return files.list_files(s, where).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("folder"), "bytes").groupBy("folder").agg(F.sum("bytes").alias("bytes"))


@query("a1_documents", "select source as folder, cast(sum(coalesce(length(text), 0) + 1) as bigint) as chars from documents group by 1")
def _(s, d):
    where = shared_dir(s)
    table(s, d, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(where)
    return files.read_documents(s, where)[0].select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("folder"), F.length("text").alias("n")).groupBy("folder").agg(F.sum("n").alias("chars"))


@query("a6_preferences", """select 'W' || doc_id as preferred, 'V' || doc_id as over, nullif(trim(lang), '') as reason, case when doc_id % 3 = 0 then 'expert' else 'list ' || (doc_id // 500) end as source
  from documents where doc_id % 5 <> 0""")
def _(s, d):
    where = shared_dir(s)
    key = F.col("doc_id").cast("string")
    pair = F.struct(
        F.concat(F.lit(" W"), key).alias("preferred"), F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("V"), key, F.lit(" "))).alias("over"),
        F.concat(F.lit(" "), "lang").alias("reason"), F.when(F.col("doc_id") % 3 == 0, F.lit(" expert ")).alias("source"),
    )
    rows = table(s, d, "documents").select(F.floor(F.col("doc_id") / 500).alias("k"), pair.alias("p"))
    lists = rows.groupBy("k").agg(F.collect_list("p").alias("preferences"))
    lists.select(F.concat(F.lit("list "), "k").alias("source"), "preferences").write.option("maxRecordsPerFile", 1).json(where)
    return files.read_preferences(s, where)


@query("a7_notes", """select 'W' || doc_id as paper_id, case when doc_id % 3 = 0 then 'failed' else 'reproduced' end as status, nullif(left(trim(text), 500), '') as claim, 2 as commands
  from documents where doc_id % 4 <> 0""")
def _(s, d):
    where = shared_dir(s)
    note = F.struct(
        F.concat(F.lit("W"), "doc_id", F.lit(" ")).alias("paperId"), F.when(F.col("doc_id") % 4 == 0, "unknown").when(F.col("doc_id") % 3 == 0, " FAILED").otherwise("Reproduced").alias("status"),
        F.col("text").alias("centralClaim"), F.array(F.lit("make"), F.lit("run")).alias("commands"),
    )
    rows = table(s, d, "documents").select(F.floor(F.col("doc_id") / 200).alias("k"), note.alias("n"))
    rows.groupBy("k").agg(F.collect_list("n").alias("notes")).select("notes").write.option("maxRecordsPerFile", 1).json(where)
    return files.read_notes(s, where).select("paper_id", "status", "claim", F.size("commands").alias("commands"))


@query("a14_results", "select 'goal ' || (doc_id // 200) as goal, count(*) as hypotheses, (doc_id // 200) % 2 = 0 as approved from documents group by doc_id // 200")
def _(s, d):
    where = shared_dir(s)
    rows = table(s, d, "documents").select(F.floor(F.col("doc_id") / 200).alias("k"), F.struct(F.col("doc_id").cast("string"), "lang").alias("h"))
    found = rows.groupBy("k").agg(F.map_from_entries(F.collect_list("h")).alias("hypotheses"))
    found.select(F.concat(F.lit("goal "), "k").alias("goal"), "hypotheses", F.when(F.col("k") % 2 == 0, True).alias("approved")).write.option("maxRecordsPerFile", 1).json(where)
    return files.list_results(s, where).select("goal", F.col("hypotheses").cast("bigint").alias("hypotheses"), "approved")
