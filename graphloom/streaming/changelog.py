"""O2 as a keyed change log: a micro-batch writes its changes, a read merges them, and compaction rewrites only buckets that many changes touched.

Layout below a folder: ``delta/_epoch=E/_bucket=B`` (a batch's last row of each key), ``base/_version=U/_bucket=B``
(a bucket as of epoch U) and ``manifest/_c=U`` (which buckets have a base of version U).  A key's bucket is a hash of it, so
buckets are even.  What a batch writes is in proportion to its changes; what compaction writes, to the touched buckets.

A batch that runs again overwrites its own epoch, and a compaction its own version before the manifest names it, so
replays and lost executors change nothing.  Of rows of one key in one batch the last by ``order`` counts (then the one of the
larger hash); a later batch wins over an earlier one.  A null key is a key.  No folder yet is an empty table.  Superseded files stay
until they are removed from outside.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def _read(spark: SparkSession, where: str, schema: StructType, *parts: str) -> DataFrame:
    full = StructType(list(schema.fields))
    for p in parts:
        full = full.add(p, "long")
    try:
        return spark.read.schema(full).parquet(where)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], full)


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")


def append(changes: DataFrame, epoch: int, path: str, keys: list[str], buckets: int = BUCKETS, order: list[str] | None = None) -> None:
    """Writes a batch's changes under its epoch."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order or []), F.desc(F.xxhash64(*changes.columns)))
    rows = changes.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn").withColumn("_bucket", bucket(keys, buckets))
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/delta/_epoch={epoch}")


def _parts(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The bases that count, and the changes since, with _epoch and _bucket."""
    named = _read(spark, f"{path}/manifest", StructType().add("_bucket", "long"), "_c").groupBy("_bucket").agg(F.max("_c").alias("_upto"))
    named = F.broadcast(named)  # at most a row a bucket
    base = _read(spark, f"{path}/base", schema, "_version", "_bucket").join(named, "_bucket").where("_version = _upto")
    since = _read(spark, f"{path}/delta", schema, "_epoch", "_bucket").join(named, "_bucket", "left").where("_epoch > coalesce(_upto, -1)")
    columns = [*schema.names, "_epoch", "_bucket"]
    return base.withColumn("_epoch", F.col("_version")).select(columns), since.select(columns)


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    latest = Window.partitionBy("_bucket", *keys).orderBy(F.desc("_epoch"))
    return rows.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn")


def current(spark: SparkSession, path: str, keys: list[str], schema: StructType) -> DataFrame:
    """The table as of now: buckets without changes are read as they are, the others merged by key."""
    base, since = _parts(spark, path, schema)
    touched = F.broadcast(since.select("_bucket").distinct())  # at most a row a bucket
    merged = _merged(base.join(touched, "_bucket", "left_semi").unionByName(since), keys)
    return base.join(touched, "_bucket", "left_anti").unionByName(merged).select(*schema.names)


def compact(spark: SparkSession, path: str, keys: list[str], schema: StructType, most: int = 4) -> list[int]:
    """Rewrites the buckets with changes of at least ``most`` epochs; returns them."""
    base, since = _parts(spark, path, schema)
    counts = since.groupBy("_bucket").agg(F.count_distinct("_epoch").alias("n"), F.max("_epoch").alias("e")).collect()  # at most a row a bucket
    full = sorted(r["_bucket"] for r in counts if r["n"] >= most)
    if full:
        upto = max(r["e"] for r in counts)
        rows = _merged(base.unionByName(since).where(F.col("_bucket").isin(full)), keys).drop("_epoch")
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/base/_version={upto}")
        spark.createDataFrame([(b,) for b in full], "_bucket bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/_c={upto}")
    return full


def follow(changes: DataFrame, path: str, checkpoint: str, keys: list[str], buckets: int = BUCKETS, most: int = 4, order: list[str] | None = None):
    """The running stream that logs changes and compacts what they touched."""
    schema = changes.schema

    def batch(rows: DataFrame, epoch: int) -> None:
        append(rows, epoch, path, keys, buckets, order)
        compact(rows.sparkSession, path, keys, schema, most)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
