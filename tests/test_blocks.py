"""Graph rounds over blocks against rounds of joins (findings of round 4)."""

import random

import pytest

from graphloom.operators import blocks, metrics


def drawn(spark, n=60, m=150, seed=4):
    """A graph with loops, parallel and null ends, ends that are no nodes, lone nodes and a repeated node."""
    rnd = random.Random(seed)
    rows = [(f"n{rnd.randrange(n):02}", f"n{min(n - 1, int(rnd.expovariate(0.1))):02}", rnd.choice([0.5, 1.0, 2.0]), k) for k in range(m)]
    rows += [("n00", "n00", 1.0, m), (None, "n01", 1.0, m), ("n02", None, 1.0, m), ("gone", "n58", 1.0, m), ("n59", "gone", 1.0, m)]
    nodes = spark.createDataFrame([(f"n{k:02}", 100 - k) for k in range(n)] + [("n05", 3)], "id string, pos int")
    return nodes, spark.createDataFrame(rows, "source string, target string, weight double, pos int")


@pytest.mark.parametrize("within", [False, True])
@pytest.mark.parametrize("order", ["id", "pos"])
def test_components_by_blocks(spark, monkeypatch, order, within):
    """Small blocks and waves, and rounds of joins, number the same components; F11: blocks need no join of rounds."""
    nodes, edges = drawn(spark, m=40)
    edges = edges.where("source <> 'n00' or target = 'n00'")
    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "WAVE", 20)
    monkeypatch.setattr(metrics, "connected_components", None)
    got = sorted(map(tuple, metrics.component_ids(nodes, edges, order, within).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(blocks, "NODES", 0)
    assert got == sorted(map(tuple, metrics.component_ids(nodes, edges, order, within).collect()))
    assert len(got) == 61 and len({c for _, c in got}) > 5


def test_communities_by_blocks(spark, monkeypatch):
    """Several blocks give the communities of the rounds of joins; F1: within few jobs, since a round shuffles nothing."""
    nodes, edges = drawn(spark)
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    monkeypatch.setattr(blocks, "BLOCK", 40)
    began = count()
    got = sorted(map(tuple, metrics.communities(nodes, edges).collect()))
    jobs = count() - began
    monkeypatch.setattr(blocks, "NODES", 0)
    began = count()
    assert got == sorted(map(tuple, metrics.communities(nodes, edges).collect()))
    assert jobs < (count() - began) / 2
    assert len({c for _, c in got}) > 2


def test_checked_clusters_by_blocks(spark, monkeypatch):
    """connectedness and modularity of right and of broken clusters, by blocks and by joins."""
    nodes, edges = drawn(spark)
    found = metrics.communities(nodes, edges)
    one = nodes.select("id").distinct().selectExpr("id", "7 as cluster_id")
    want = {}
    for limit in (0, blocks.NODES):
        monkeypatch.setattr(blocks, "NODES", limit)
        want[limit] = [tuple(metrics.checked_clusters(edges, c).first()) for c in (found, one)]
    (a, b), (c, d) = want.values()
    assert a == pytest.approx(c) and b == pytest.approx(d) and a[0] and a[1] > 0.1 and not b[0]
    lone = spark.createDataFrame([("x", 1)], "id string, cluster_id int")
    assert tuple(metrics.checked_clusters(edges, lone).first()) == (True, None)
