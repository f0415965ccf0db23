"""Connected components of an undirected graph by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written


def numbered(ids: DataFrame, where: str) -> DataFrame:
    """(id, n) of the distinct ids of a table of one column: n rises with the ids, with gaps between tasks; rounds carry it in place of text."""
    name = ids.columns[0]
    rows = ids.distinct().repartitionByRange(name).sortWithinPartitions(name)
    return written(rows.select(F.col(name).alias("id"), F.monotonically_increasing_id().alias("n")), where)


def ranked(ids: DataFrame, where: str) -> DataFrame:
    """(id, rank) of the distinct ids of a table of one column: ranks from 0 without gaps, by counts of tasks and not in one task."""
    rows = numbered(ids, where).select("id", F.shiftright("n", 33).alias("part"), F.col("n").bitwiseAND((1 << 33) - 1).alias("at"))
    # One row a task of the sort.
    before = rows.groupBy("part").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before.select("part", "before")), "part").select("id", (F.col("before") + F.col("at")).alias("rank"))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 1000) -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, gives it to the node's old
    label too (so a root follows the least label that its members see), and then takes the label of
    that label.  The number of rounds is about the logarithm of the longest path, whatever the order
    of the ids.  Rounds go on until nothing moves; max_rounds is a safety limit that raises.  Each
    round is a table in the shared folder: a lost executor costs no earlier round.  A null endpoint
    is no node; self-loops give components of one; repeated edges count once.
    """
    spark = edges.sparkSession
    where = shared_dir(spark)
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{where}/edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), f"{where}/0")
    for k in range(1, max_rounds + 1):
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        seen = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        hooks = seen.where("low < old").groupBy(F.col("old").alias("root")).agg(F.min("low").alias("hook"))
        low = seen.join(hooks, F.col("node") == F.col("root"), "left").select("node", "old", F.least("low", F.coalesce("hook", "low")).alias("low"))
        up = labels.select(F.col("node").alias("p"), F.col("label").alias("up"))
        new = written(low.join(up, F.col("low") == F.col("p")).select("node", "old", F.least("low", "up").alias("label")), f"{where}/{k}")
        if new.where("old <> label").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError(f"connected_components: labels still move after {max_rounds} rounds")
