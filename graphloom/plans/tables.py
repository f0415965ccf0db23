"""The graph, concept and literature tables that queries derive from the given tables.

Each is one SELECT that Spark and DuckDB read alike, so a query and its SQL start from the same
rows: parts are materials, suppliers synthesis methods, customers applications, nations
properties, regions conditions, documents chunks and papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = """
select 'mat_' || p_partkey as id, 'Material' as type, p_name as name, cast(p_partkey as bigint) as pos,
       cast(p_partkey % 8 as int) as cluster_id, cast(p_size % 5 + 1 as int) as difficulty, p_type as definition from part
union all select 'syn_' || s_suppkey, 'SynthesisMethod', s_name, cast(s_suppkey as bigint), cast(s_suppkey % 8 as int), cast(s_suppkey % 5 + 1 as int), null from supplier
union all select 'app_' || c_custkey, 'Application', c_name, cast(c_custkey as bigint), cast(c_custkey % 8 as int), cast(c_custkey % 5 + 1 as int), c_mktsegment from customer
union all select 'prp_' || n_nationkey, 'Property', n_name, cast(n_nationkey as bigint), cast(n_nationkey % 8 as int), cast(n_nationkey % 5 + 1 as int), null from nation
union all select 'cnd_' || r_regionkey, 'Condition', r_name, cast(r_regionkey as bigint), cast(r_regionkey % 8 as int), cast(r_regionkey % 5 + 1 as int), null from region
"""

EDGES = """
select 'mat_' || l_partkey as source, 'syn_' || l_suppkey as target, 'SYNTHESIZED_BY' as type, count(*) as co_occurrence_count,
       ((l_partkey * 7 + l_suppkey * 13) % 100) / 100.0e0 as confidence, cast(l_partkey * 100003 + l_suppkey as bigint) as pos from lineitem group by l_partkey, l_suppkey
union all select 'mat_' || l_partkey, 'app_' || o_custkey, 'APPLIED_IN', count(*), ((l_partkey * 3 + o_custkey * 11) % 100) / 100.0e0, cast(l_partkey * 100003 + o_custkey as bigint) + 1
       from lineitem join orders on l_orderkey = o_orderkey where l_partkey % 4 = 0 group by l_partkey, o_custkey
union all select 'mat_' || l_partkey, 'prp_' || s_nationkey, case when l_partkey % 5 = 0 then 'DEGRADES' else 'IMPROVES' end, count(*), ((l_partkey * 17 + s_nationkey * 5) % 100) / 100.0e0, cast(l_partkey * 100003 + s_nationkey as bigint) + 2
       from lineitem join supplier on l_suppkey = s_suppkey where l_partkey % 3 = 0 group by l_partkey, s_nationkey
union all select 'syn_' || s_suppkey, 'cnd_' || n_regionkey, 'REQUIRES_CONDITION', cast(1 as bigint), case when s_suppkey % 9 = 0 then null else 0.75e0 end, cast(s_suppkey as bigint)
       from supplier join nation on s_nationkey = n_nationkey
union all select 'syn_' || s_suppkey, 'mat_' || s_suppkey, 'SYNTHESIZED_BY', cast(1 as bigint), 0.9e0, cast(s_suppkey as bigint) from supplier
union all select 'mat_' || p_partkey, 'mat_' || p_partkey, 'SUBSTITUTE_FOR', cast(1 as bigint), 0.9e0, cast(p_partkey as bigint) from part where p_partkey % 50 = 0
union all select 'mat_' || p_partkey, 'gone_' || p_partkey, 'APPLIED_IN', cast(1 as bigint), 0.9e0, cast(p_partkey as bigint) from part where p_partkey % 40 = 0
union all select 'mat_' || p_partkey, 'mat_' || (p_partkey + 1), 'SUBSTITUTE_FOR', cast(1 as bigint), 0.8e0, cast(p_partkey as bigint) from part where p_partkey % 25 = 0
"""

CHUNKS = """
select source || ':c:' || doc_id as id, 'Chunk' as type, text, cast(doc_id as bigint) as pos, source as slug from documents
"""

CONCEPTS = """
select 'con_' || item_id as concept_id, lower(regexp_extract(text, '[A-Za-z]{3,}', 0)) as term, cast(item_id as bigint) as pos,
       text as definition from benchmark
"""

PAPERS = r"""
select doc_id as paper_id, regexp_extract(text, '^[^.!?\n]*', 0) as title, text as abstract, cast(2000 + doc_id % 25 as int) as year,
       cast((doc_id * 37) % 500 as bigint) as citations, case when doc_id % 3 = 0 then (doc_id % 100) / 100.0e0 end as percentile,
       cast(doc_id + 1 as bigint) as source_rank, doc_id % 2 = 0 as open_access, doc_id % 97 = 0 as retracted, source as field, lang as topic from documents
"""

CITATIONS = """
select doc_id as source, cast((doc_id * 7 + 3) % n as bigint) as target from documents cross join (select count(*) as n from documents) where doc_id % 5 <> 0
union all select doc_id, cast((doc_id * doc_id) % n as bigint) from documents cross join (select count(*) as n from documents) where doc_id % 5 <> 0
"""

METRIC_NODES = """
select id, type, name, cluster_id, pos, difficulty,
       ((pos * 13) % 101) / 1000.0e0 as betweenness, ((pos * 29) % 97) / 5000.0e0 as pagerank, ((pos * 31) % 89) / 100.0e0 as bridge_score,
       ((pos * 7) % 61) / 600.0e0 as importance, cast(pos % 6 - case when pos % 211 = 0 then 6 else 0 end as int) as depth, cast(pos % 3 as int) as component_id,
       case when pos % 71 = 0 then null else cast(pos % 17 as double) end as effort
from (""" + NODES + """) t
"""

NAMES = {"nodes": NODES, "edges": EDGES, "metric_nodes": METRIC_NODES, "chunks": CHUNKS, "concepts": CONCEPTS, "papers": PAPERS, "citations": CITATIONS}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table; derived ones read only what they name."""
    if name not in NAMES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = NAMES[name]
    used = [b for b in BASE if f" {b} " in f"{text} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
    for b in used:
        text = text.replace(f"from {b}", "from {" + b + "}").replace(f"join {b}", "join {" + b + "}")
    text = text.replace("{3,}", "{{3,}}")
    return spark.sql(text, **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in used})


def with_tables(sql: str) -> str:
    """SQL for DuckDB over given and derived tables."""
    used = [n for n in NAMES if f" {n}" in sql.replace("\n", " ").replace("(", " ")]
    head = ", ".join(f"{n} as ({NAMES[n]})" for n in used)
    body = sql.strip()
    if not head:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"
