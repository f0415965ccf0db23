"""Exact deduplication by 128-bit content hash with a byte comparison inside groups.

``groupBy(hash, second hash, text)`` groups by the 128-bit MD5 and at the same time compares the
bytes: Spark's grouping on the text is an equality of bytes, and its map-side combine turns the
copies that a task holds into one row, so a text that a third of all rows share is never gathered.
A light table of (doc_id, hashes) then meets the groups that have copies.  A group with at least one
in ``HOT`` of all rows is hot; there are at most ``HOT`` of these by their size, so they are
broadcast, and their rows, which would all have one key, are not shuffled.  Two different texts
under one pair of hashes stop the job instead of being merged.

Null counts as empty; empty texts equal each other; repeated ids count as rows; a null id is less than
any other, so it stays only where all ids of a text are null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written

#: A group of a HOT-th of all rows meets its rows by broadcast; no more than HOT groups can be so large.
HOT = 1000


def exact_groups(docs: DataFrame, text: Column | None = None, keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row; keep: the largest (max) or smallest (min) id stays."""
    text = F.coalesce(F.col("text").cast("string") if text is None else text, F.lit(""))
    hashed = docs.select("doc_id", text.alias("_text")).select("doc_id", "_text", F.unhex(F.md5("_text")).alias("_h"), F.unhex(F.sha2("_text", 256)).alias("_s"))
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    compared = hashed.groupBy("_h", "_s", "_text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    again = F.max("keep_id") if keep == "max" else F.min("keep_id")
    groups = compared.select("_h", "_s", "keep_id", "group_size").groupBy("_h", "_s").agg(again.alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("_texts"))
    several = groups.where("group_size > 1").withColumn("group_size", F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share an MD5 and a SHA-256")).cast("bigint")))
    where = shared_dir(docs.sparkSession)
    light = written(hashed.select("doc_id", "_h", "_s"), f"{where}/light")
    several = written(several.drop("_texts"), f"{where}/several")
    hot = F.col("group_size") * HOT >= light.count()
    few = F.broadcast(several.where(hot))
    by_key = light.join(few, ["_h", "_s"], "left_anti").join(several.where(~hot), ["_h", "_s"], "left")
    out = by_key.unionByName(light.join(few, ["_h", "_s"]))
    keep_id = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("_s")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows that stay, with all their columns, judged by id and text; of rows with one id and one text, all stay."""
    dropped = exact_groups(docs, keep=keep).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    own = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_gone"]) & (own == dropped["_sha"]), "left_anti")
