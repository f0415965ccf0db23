"""The change log against a dictionary, its bytes, replays and compaction."""

import os
import random

from pyspark.sql.types import StructType

from graphloom.streaming import changelog as L

SCHEMA = StructType().add("id", "string").add("v", "long").add("note", "string")


def size(where):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(where) for f in fs if f.endswith(".parquet"))


def test_change_log(spark, tmp_path):
    rnd, path, want = random.Random(1), str(tmp_path / "t"), {}
    assert L.current(spark, path, ["id"], SCHEMA).count() == 0 and L.compact(spark, path, ["id"], SCHEMA) == []
    now = lambda: {r["id"]: (r["v"], r["note"]) for r in L.current(spark, path, ["id"], SCHEMA).collect()}
    first = [(f"k{k}", k, "x" * 50) for k in range(3000)] + [(None, 1, None)]
    L.append(spark.createDataFrame(first, SCHEMA), 0, path, ["id"], 8)
    want = {r[0]: r[1:] for r in first}
    assert now() == want
    assert L.compact(spark, path, ["id"], SCHEMA, most=1) == list(range(8)) and now() == want
    whole = size(f"{path}/base")
    for epoch in range(1, 4):
        rows = [(f"k{rnd.randrange(3005)}", epoch * 100 + n, None) for n in range(3)] + [("k7", 5, "a"), ("k7", epoch * 1000, "b")]
        for _ in range(2):  # a replay overwrites its own epoch
            L.append(spark.createDataFrame(rows, SCHEMA), epoch, path, ["id"], 8, ["v"])
        for r in sorted(rows, key=lambda r: r[1]):
            want[r[0]] = r[1:]
        assert now() == want
    assert size(f"{path}/delta/_epoch=3") < whole / 2
    full = L.compact(spark, path, ["id"], SCHEMA, most=3)
    assert full and len(full) < 8 and sorted(os.listdir(f"{path}/base/_version=3")) == sorted([f"_bucket={b}" for b in full] + [x for x in os.listdir(f"{path}/base/_version=3") if not x.startswith("_bucket")])
    assert now() == want and L.compact(spark, path, ["id"], SCHEMA, most=3) == []


def test_change_stream(spark, tmp_path):
    rows = [[(f"k{k}", n, "x") for k in range(n, 60, n + 1)] for n in range(4)]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        L.follow(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["id"], 4, 2).awaitTermination()
    want = {r[0]: r[1] for part in rows for r in part}
    assert {r["id"]: r["v"] for r in L.current(spark, str(tmp_path / "t"), ["id"], SCHEMA).collect()} == want
