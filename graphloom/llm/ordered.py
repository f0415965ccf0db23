"""Places of rows in a total order, without a window over a whole table or a hot group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import written

#: monotonically_increasing_id holds the partition above, the row below this bit.
ROW_BITS = 33


def numbered(rows: DataFrame, group: list[str], order: list[str], where: str) -> DataFrame:
    """rows with pos, the place from 0 in the group by order (nulls first).

    rows must be a written table.  They are dealt by ranges of (group, order, place in the input), so
    that neither a hot group nor many equal rows meet in one task, sorted, and written below where;
    the only window is over one row for each group and range that it touches.  Equal rows keep the
    order of the input.
    """
    keys = [*group, *order, "_n"]
    dealt = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    dealt = written(dealt.drop("_n").withColumn("_part", F.shiftright(at, ROW_BITS)).withColumn("_row", at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))), f"{where}/sorted")
    runs = dealt.groupBy("_part", *group).agg(F.count("*").alias("_count"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    runs = runs.select(F.col("_part").alias("_p"), "_first", "_before", *(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    pos = F.col("_before") + F.col("_row") - F.col("_first")
    return dealt.join(runs, same).select(*rows.columns, pos.cast("bigint").alias("pos"))
