"""Sketched closeness and sampled betweenness against the exact forms."""

import random

import pytest

from graphloom.operators import metrics, sketches


def made(spark, n, m, seed=3):
    rnd = random.Random(seed)
    nodes = [(f"n{k}", 1) for k in range(n)]
    edges = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}", rnd.choice([0.5, 1.0, 2.0, 3.25])) for _ in range(m)] if n else []
    both = {(a, b): c for a, b, c in edges if a != b}
    return spark.createDataFrame(nodes, "id string, r int"), spark.createDataFrame([(a, b, c) for (a, b), c in both.items()], "source string, target string, inverse_weight double")


def test_sketched_closeness_is_exact_for_few(spark):
    nodes, edges = made(spark, 40, 90)
    got = {r["id"]: r["out_closeness"] for r in sketches.sketched_closeness(nodes, edges, 64).collect()}
    want = {r["id"]: r["out_closeness"] for r in metrics.closeness(nodes, edges).collect()}
    assert got == pytest.approx(want)
    assert sketches.sketched_closeness(*made(spark, 0, 0)).count() == 0
    lone = spark.createDataFrame([("a", 1), ("a", 1)], "id string, r int")
    assert [tuple(r) for r in sketches.sketched_closeness(lone, edges.where("false")).collect()] == [("a", 0.0, 0.0, 0.0)]
    loops = spark.createDataFrame([("a", "a", 1.0), (None, "a", 1.0), ("a", "gone", 1.0)], "source string, target string, inverse_weight double")
    assert sketches.sketched_closeness(lone, loops).first()["reached"] == 0


def test_sketched_closeness_error(spark):
    nodes, edges = made(spark, 250, 1000)
    want = {r["id"]: r["out_closeness"] for r in metrics.closeness(nodes, edges).collect()}
    state = sketches.distance_sketches(nodes, edges, 16)
    got = {r["id"]: r["out_closeness"] for r in sketches.sketched_closeness(nodes, edges, 16).collect()}
    errors = [abs(got[v] / want[v] - 1) for v in want if want[v]]
    assert sum(errors) / len(errors) < 2 / (2 * 16) ** 0.5 and state.count() < 250 * 110


def plain_dependencies(edges, n):
    """Brandes' dependencies of each source by paths in the order of distance."""
    import heapq

    adj = {f"n{k}": {} for k in range(n)}
    for a, b, c in edges:
        adj[a][b] = c
    for src in adj:
        dist, sigma, before, order, queue = {src: 0.0}, {src: 1.0}, {src: []}, [], [(0.0, src)]
        while queue:
            d, x = heapq.heappop(queue)
            if x in order or d > dist[x]:
                continue
            order.append(x)
            for y, c in adj[x].items():
                if y not in dist or d + c < dist[y] - 1e-9:
                    dist[y], sigma[y], before[y] = d + c, sigma[x], [x]
                    heapq.heappush(queue, (d + c, y))
                elif abs(d + c - dist[y]) < 1e-9:
                    sigma[y] += sigma[x]
                    before[y].append(x)
        delta = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in before[y]:
                delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
        yield from ((src, x, v) for x, v in delta.items() if x != src)


def test_dependencies(spark):
    nodes, edges = made(spark, 25, 60)
    want = {(a, b): v for a, b, v in plain_dependencies([tuple(r) for r in edges.collect()], 25) if v}
    got = {(r["src"], r["id"]): r["delta"] for r in metrics.dependencies(nodes, edges, nodes).collect() if r["delta"]}
    assert got == pytest.approx(want)


def test_sampled_betweenness(spark, monkeypatch):
    n = 1500
    nodes, edges = made(spark, n, 3000)
    every = list(plain_dependencies([tuple(r) for r in edges.collect()], n))
    table = spark.createDataFrame(every, "src string, id string, delta double").cache()
    monkeypatch.setattr(metrics, "dependencies", lambda v, e, sources: table.join(sources.withColumnRenamed("id", "src"), "src", "left_semi"))
    want = dict.fromkeys((f"n{k}" for k in range(n)), 0.0)
    for _, x, v in every:
        want[x] += v / ((n - 1) * (n - 2))
    got = metrics.sampled_betweenness(nodes, edges, error=0.15, first=100).collect()
    assert len({r["sources"] for r in got}) == 1 and 200 < got[0]["sources"] < n and len(got) == n
    assert all(abs(r["betweenness"] - want[r["id"]]) <= r["bound"] <= 0.15 for r in got)
    got = metrics.sampled_betweenness(nodes, edges, error=0.0, first=400).collect()
    assert {r["id"]: r["betweenness"] for r in got} == pytest.approx(want, abs=1e-12) and {(r["bound"], r["sources"]) for r in got} == {(0.0, n)}
    assert metrics.sampled_betweenness(*made(spark, 0, 0)).count() == 0


def sequential(weights, ids):
    """Local moving, node after node, without aggregation: what a plain run gives."""
    near = {v: {} for v in ids}
    for (a, b), w in weights.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    k = {v: sum(near[v].values()) for v in ids}
    m2, com = sum(k.values()), {v: v for v in ids}
    total, moved = dict(k), True
    while moved:
        moved = False
        for v in sorted(ids):
            links = {}
            for u, w in near[v].items():
                links[com[u]] = links.get(com[u], 0) + w
            total[com[v]] -= k[v]
            best = max(sorted({*links, com[v]}), key=lambda c: (links.get(c, 0) - k[v] * total[c] / m2, c == com[v]))
            moved |= best != com[v]
            com[v] = best
            total[best] += k[v]
    return com


def test_communities_are_connected_and_no_worse(spark):
    rnd = random.Random(9)
    group = {f"n{k:02}": k // 12 for k in range(48)}
    weights = {}
    for a in group:
        for b in group:
            if a < b and rnd.random() < (0.5 if group[a] == group[b] else 0.04):
                weights[(a, b)] = 1.0
    nodes = spark.createDataFrame([(v,) for v in group], "id string")
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "source string, target string, weight double")
    found = metrics.communities(nodes, edges)
    plain = spark.createDataFrame([(v, c) for v, c in sequential(weights, list(group)).items()], "id string, cluster_id string")
    assert metrics.modularity(edges, found).first()[0] >= metrics.modularity(edges, plain).first()[0] - 1e-9
    com = {r["id"]: r["cluster_id"] for r in found.collect()}
    for c in set(com.values()):
        mine = {v for v in com if com[v] == c}
        seen, todo = set(), [min(mine)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [b if a == v else a for a, b in weights if v in (a, b) and {a, b} <= mine]
        assert seen == mine


def test_rounds_take_the_place_of_earlier_ones(spark, tmp_path, monkeypatch):
    """One round's table is left, and it names nodes by numbers; long names, a loop, a null end and an end that is no node."""
    from graphloom.operators import sketches

    monkeypatch.setattr(sketches, "shared_dir", lambda _: f"file://{tmp_path}/s")
    name = lambda k: f"{k} " + "n" * 50
    nodes = spark.createDataFrame([(name(k),) for k in range(5)], "id string")
    edges = [(name(0), name(1), 2.0), (name(1), name(2), 1.0), (name(0), name(2), 9.0), (name(2), name(3), 0.5), (name(3), name(3), 1.0), (name(3), None, 1.0), (name(3), "none", 1.0)]
    out = sketches.distance_sketches(nodes, spark.createDataFrame(edges, "source string, target string, inverse_weight double"))
    rows = sorted((r["id"][0], r["dist"]) for r in out.collect())
    assert rows == sorted([(str(k), 0.0) for k in range(5)] + [("0", 2.0), ("0", 3.0), ("0", 3.5), ("1", 1.0), ("1", 1.5), ("2", 0.5)])
    rounds = [p for p in (tmp_path / "s").iterdir() if p.name.isdigit()]
    assert len(rounds) == 1 and dict(spark.read.parquet(f"file://{rounds[0]}").dtypes)["id"] == "bigint"


@pytest.mark.parametrize("lengths", [[1.0], [0.5, 1.0, 2.0, 3.25]])
def test_sketches_by_ranks(spark, monkeypatch, lengths):
    """entries sent out by ranks, few at a time, give the sketches of the rounds; equal distances, repeated and null ends, unknown ends."""
    from graphloom.operators import reach

    rnd = random.Random(8)
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(120)], "id string")
    rows = [(f"n{rnd.randrange(120)}", f"n{rnd.randrange(110)}", rnd.choice(lengths)) for _ in range(420)]
    edges = spark.createDataFrame(rows + [("n1", "gone", 1.0), ("gone", "n2", 1.0), (None, "n3", 1.0), ("n4", None, 1.0)], "source string, target string, inverse_weight double")
    seen = lambda df: sorted((r["id"], r["r"], round(r["dist"], 9)) for r in df.collect())
    monkeypatch.setattr(reach, "CELLS", 900)
    tables, write = [], sketches.written
    monkeypatch.setattr(sketches, "written", lambda df, where: tables.append(where) or write(df, where))
    got, near = seen(sketches.distance_sketches(nodes, edges, 4)), {r["id"]: tuple(r)[1:] for r in sketches.sketched_closeness(nodes, edges, 4).collect()}
    assert len(tables) < 40
    monkeypatch.setattr(reach, "EDGES", 0)
    assert got == seen(sketches.distance_sketches(nodes, edges, 4)) and len(got) > 120 * 4
    want = {r["id"]: tuple(r)[1:] for r in sketches.sketched_closeness(nodes, edges, 4).collect()}
    assert near.keys() == want.keys() and all(near[v] == pytest.approx(want[v]) for v in want)
