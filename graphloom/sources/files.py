"""Sources and sinks: documents, slices, graphs, dictionaries, works, notes, ranked outputs, logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EXTENSIONS = ("md", "txt", "html")
SLICE = "id string, `order` bigint, source_file string, slug string, text string, slice_token_start bigint, slice_token_end bigint"
NODE = "struct<id:string,type:string,name:string,text:string,definition:string,difficulty:bigint,node_offset:bigint,cluster_id:int>"
EDGE = "struct<source:string,target:string,type:string,weight:double,conditions:string,attributes:struct<confidence_score:double,evidence_quote:string,source_doi:string,relation_role:string,co_occurrence_count:bigint>>"
GRAPH = f"_meta map<string,string>, nodes array<{NODE}>, edges array<{EDGE}>, _corrupt_record string"
CONCEPTS = "concepts array<struct<concept_id:string,term:struct<primary:string,aliases:array<string>>,definition:string,ontology_class:string,is_kpi:boolean>>"
WORK = (
    "struct<id:string,doi:string,display_name:string,publication_year:bigint,cited_by_count:bigint,citation_normalized_percentile:struct<value:double>,"
    "referenced_works:array<string>,concepts:array<struct<display_name:string,score:double>>,topics:array<struct<display_name:string,score:double>>,"
    "abstract_inverted_index:map<string,array<int>>,open_access:struct<is_oa:boolean,oa_url:string>,is_retracted:boolean>"
)


@F.pandas_udf(StringType())
def _decoded(contents: pd.Series) -> pd.Series:
    def decode(raw):
        if raw is None:
            return None
        for code in ("utf-8", "cp1251", "latin1"):
            try:
                return bytes(raw).decode(code)
            except UnicodeDecodeError:
                continue
        return None

    return contents.map(decode)


def read_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """A1: (path, text) of files with the extensions, decoded as UTF-8, else CP1251, else Latin-1; and the rejects (path, reason)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)
    rows = files.where(wanted).select("path", _decoded("content").alias("text"))
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    rejects = files.where(~wanted).select("path", F.lit("extension").alias("reason")).unionByName(rows.where(F.col("text").isNull() | blank).select("path", F.lit("empty").alias("reason")))
    return rows.where(F.col("text").isNotNull() & ~blank), rejects


def write_slices(slices: DataFrame, path: str) -> None:
    """A2: slices by source file."""
    slices.write.mode("overwrite").partitionBy("source_file").parquet(path)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """A2: slices as written."""
    return spark.read.schema(SLICE).parquet(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A3: nodes and edges (with ``pos``, their place in the list) and rejects of graph documents; a document needs both lists."""
    docs = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(GRAPH).json(path).withColumn("_file", F.col("_metadata.file_path"))
    good = docs.where("nodes is not null and edges is not null")
    nodes = good.select("_file", F.posexplode("nodes").alias("pos", "n")).select("_file", "pos", "n.*")
    edges = good.select("_file", F.posexplode("edges").alias("pos", "e")).select("_file", "pos", "e.*")
    return nodes, edges, docs.where("nodes is null or edges is null").select("_file", "_corrupt_record")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """A4: concept_id, term, aliases, definition, ontology_class, is_kpi, pos."""
    docs = spark.read.option("multiLine", True).schema(CONCEPTS).json(path)
    return docs.select(F.posexplode("concepts").alias("pos", "c")).select("pos", "c.concept_id", F.col("c.term.primary").alias("term"), F.coalesce("c.term.aliases", F.array().cast("array<string>")).alias("aliases"), "c.definition", "c.ontology_class", "c.is_kpi")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """A5: works of response objects ({results: [...]}) and of bare arrays alike, with their place."""
    objects = spark.read.option("multiLine", True).schema(f"results array<{WORK}>").json(path).where("results is not null").select(F.posexplode("results").alias("pos", "w"))
    bare = spark.read.option("wholetext", True).text(path).where(F.substring(F.trim("value"), 1, 1) == "[").select(F.from_json("value", f"array<{WORK}>").alias("a")).select(F.posexplode("a").alias("pos", "w"))
    return objects.unionByName(bare).select("pos", "w.*")


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """(preferred, over, reason, source), trimmed; pairs with a blank side are left out."""
    kind = "source string, preferences array<struct<preferred:string,over:string,reason:string,source:string>>"
    rows = spark.read.option("multiLine", True).schema(kind).json(path).select("source", F.explode("preferences").alias("p"))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(clean("p.preferred").alias("preferred"), clean("p.over").alias("over"), clean("p.reason").alias("reason"), F.coalesce(clean("p.source"), clean("source")).alias("source")).where("preferred is not null and over is not null")


STATUSES = ("reproduced", "partially_reproduced", "failed", "not_runnable")


def read_notes(spark: SparkSession, path: str, longest: int = 500, commands: int = 12) -> DataFrame:
    """Reproduction notes with a known status; texts cut, at most ``commands`` commands."""
    kind = "source string, notes array<struct<paperId:string,status:string,centralClaim:string,resultSummary:string,source:string,checkedAt:string,commands:array<string>,notes:string>>"
    rows = spark.read.option("multiLine", True).schema(kind).json(path).select("source", F.posexplode("notes").alias("pos", "n"))
    cut = lambda c, n=longest: F.nullif(F.substring(F.trim(c), 1, n), F.lit(""))
    return rows.select(F.trim("n.paperId").alias("paper_id"), "pos", F.lower(F.trim("n.status")).alias("status"), cut("n.centralClaim").alias("claim"), cut("n.resultSummary").alias("summary"), cut("n.checkedAt", 80).alias("checked_at"), F.slice(F.coalesce("n.commands", F.array().cast("array<string>")), 1, commands).alias("commands")).where(F.col("status").isin(*STATUSES) & (F.col("paper_id") != ""))


def merged_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: the metadata map of old, overridden by new."""
    both = F.map_concat(F.map_filter(F.coalesce(F.col("o"), F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.coalesce(F.col("n"), F.create_map().cast("map<string,string>")), k)), F.coalesce(F.col("n"), F.create_map().cast("map<string,string>")))
    return new.select(F.col("meta").alias("n")).join(old.select(F.col("meta").alias("o")), how="left").select(both.alias("meta"))


def write_triples(triples: DataFrame, path: str) -> None:
    """Subject, Rel, Object, Count with a header."""
    triples.select("Subject", "Rel", "Object", "Count").write.mode("overwrite").option("header", True).csv(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("Subject string, Rel string, Object string, Count bigint").csv(path)


def write_ranked(papers: DataFrame, scores: DataFrame, path: str) -> None:
    """Papers without bodies (their length stays) and scores as JSON lines."""
    body = papers.withColumn("full_text_chars", F.length("full_text")).drop("full_text") if "full_text" in papers.columns else papers
    body.write.mode("overwrite").json(f"{path}/papers")
    scores.write.mode("overwrite").json(f"{path}/scores")


def padded(cluster: Column, most: Column) -> Column:
    """A cluster id padded with zeros to the width of the largest."""
    return F.lpad(cluster.cast("string"), F.length(most.cast("string")), F.lit("0"))


def write_clusters(nodes: DataFrame, path: str) -> None:
    """One folder a cluster, named by the padded id."""
    most = nodes.agg(F.max("cluster_id").alias("_m"))
    nodes.join(F.broadcast(most)).withColumn("cluster", padded(F.col("cluster_id"), F.col("_m"))).drop("_m").write.mode("overwrite").partitionBy("cluster").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append to the event log."""
    events.write.mode("append").json(path)


def tail_events(spark: SparkSession, path: str, schema: str, n: int = 100) -> DataFrame:
    """The last n events by time."""
    return spark.read.schema(schema).json(path).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def list_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, goal, hypotheses, approved, modified), newest first."""
    rows = spark.read.option("multiLine", True).schema("goal string, hypotheses map<string,string>, approved boolean").json(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), "goal", F.greatest(F.size("hypotheses"), F.lit(0)).alias("hypotheses"), F.coalesce("approved", F.lit(False)).alias("approved"), F.col("_metadata.file_modification_time").alias("modified")).orderBy(F.desc("modified"), "file")


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, bytes, modified) of files with the extensions; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy("path")
