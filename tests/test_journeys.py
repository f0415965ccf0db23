"""Demo journeys and paths of many pairs, against plain searches."""

import random
from collections import deque
from math import ceil

import pytest

from graphloom.operators import journeys as J

NODES = "id string, depth int, importance double, pagerank double, betweenness double, effort double, extra int"


def plain_path(adj, start, goal):
    """The path of the fewest edges whose every predecessor is the smallest of the level before."""
    level, pred, here = {start: 0}, {start: None}, [start]
    while here and goal not in level:
        near = {}
        for u in sorted(here):
            for v in adj.get(u, ()):
                if v not in level:
                    near.setdefault(v, u)
        here = list(near)
        for v, u in near.items():
            level[v], pred[v] = level[u] + 1, u
    if goal not in level:
        return []
    out = [goal]
    while pred[out[-1]] is not None:
        out.append(pred[out[-1]])
    return out[::-1]


def learning(n):
    return (n["depth"] is None, n["depth"] or 0, n["importance"] is None, -(n["importance"] or 0), n["id"])


def down(n, *names):
    return (*(x for c in names for x in (n[c] is None, -(n[c] or 0))), n["id"])


def stitched(keys, adj):
    out = [(keys[0]["id"], "key")] if keys else []
    for a, b in zip(keys, keys[1:], strict=False):
        out += [(x, "connector") for x in plain_path(adj, a["id"], b["id"])[1:]] + [(b["id"], "key")]
    return out


def plain_education(nodes, adj, most, least):
    key = sorted(nodes, key=lambda n: down(n, "importance"))[: ceil(1.5 * most)]
    key = sorted({n["id"]: n for n in [*key, *sorted(nodes, key=learning)[:1]]}.values(), key=learning)
    order, ids = [], {n["id"] for n in key}
    for x, _ in stitched(key, adj):
        if x not in order:
            order.append(x)
    first = [(x, "key" if x in ids else "connector") for x in order][:most]
    rest = sorted((n for n in nodes if n["id"] not in dict(first)), key=lambda n: down(n, "pagerank", "betweenness"))[: max(0, least - len(first))]
    return first + [(n["id"], "fill") for n in sorted(rest, key=learning)]


def plain_dependencies(nodes, adj, most, least):
    known = {n["id"]: n for n in nodes}
    peaks = sorted((n for n in nodes if n["effort"] is not None), key=lambda n: (-n["effort"], n["id"]))[:1]
    chosen = {}
    if peaks:
        back, todo = {peaks[0]["id"]}, deque([peaks[0]["id"]])
        while todo:
            v = todo.popleft()
            for u, vs in adj.items():
                if v in vs and u not in back:
                    back.add(u)
                    todo.append(u)
        of = {}
        for n in nodes:
            if n["id"] in back:
                of.setdefault(n["depth"], []).append(n)
        each = max(1, most // max(1, len([d for d in of if d is not None])))
        best = sorted((n for ns in of.values() for n in sorted(ns, key=lambda n: down(n, "importance"))[:each]), key=learning)
        for x, role in stitched(best, adj):
            chosen[x] = max(role, chosen.get(x, ""))
        if peaks[0]["id"] in {n["id"] for n in best}:
            chosen[peaks[0]["id"]] = "peak"
    rest = sorted((n for n in nodes if n["id"] not in chosen), key=lambda n: down(n, "betweenness", "pagerank"))[: max(0, least - len(chosen))]
    every = {**{k: v for k, v in chosen.items() if k in known}, **{n["id"]: "fill" for n in rest}}
    return [(n["id"], every[n["id"]]) for n in sorted((known[k] for k in every), key=learning)][:most]


def made(seed, n, m):
    rnd = random.Random(seed)
    some = lambda f: None if rnd.random() < 0.1 else f()
    nodes = [{"id": f"n{k}", "depth": some(lambda: rnd.randint(0, 4)), "importance": some(lambda: rnd.randint(0, 9) / 10), "pagerank": some(rnd.random), "betweenness": some(rnd.random), "effort": some(lambda: float(rnd.randint(0, 20))), "extra": 1} for k in range(n)]
    edges = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)] if n else []
    return nodes, edges


def tables(spark, nodes, edges):
    return spark.createDataFrame([tuple(n.values()) for n in [*nodes, *nodes[:2]]], NODES), spark.createDataFrame([*edges, *edges[:3], (None, "n0")], "source string, target string")


def neighbours(edges):
    adj = {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, set()).add(b)
    return adj


def test_between(spark):
    nodes, edges = made(1, 60, 110)
    rnd = random.Random(2)
    pairs = [(k, f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for k in range(25)] + [(90, "n1", "n1"), (91, "n1", None), (92, "n1", "gone")]
    chain = [(f"c{k:03}", f"c{k + 1:03}") for k in range(12)]
    got = J.between(spark.createDataFrame([*pairs, (93, "c000", "c012")], "pair int, start string, goal string"), tables(spark, nodes, edges + chain)[1]).collect()
    adj = neighbours(edges + chain)
    want = {(p, k, x) for p, a, b in [*pairs, (93, "c000", "c012")] if b for k, x in enumerate(plain_path(adj, a, b))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("seed", "n", "m", "most", "least"), [(1, 0, 0, 10, 15), (2, 8, 9, 10, 15), (3, 60, 90, 12, 15), (4, 60, 70, 30, 15), (5, 40, 30, 4, 3)])
def test_journeys(spark, seed, n, m, most, least):
    nodes, edges = made(seed, n, m)
    v, e = tables(spark, nodes, edges)
    adj = neighbours(edges)
    for built, plain in ((J.educational_journey, plain_education), (J.dependency_journey, plain_dependencies)):
        got = sorted(tuple(r) for r in built(v, e, most, least).select("step", "id", "role").collect())
        assert got == [(k + 1, *x) for k, x in enumerate(plain(nodes, adj, most, least))]


def test_pairs_meet_halfway(spark, monkeypatch):
    """F8: a pair that meets at a hub does not reach the hub's other neighbours; a pair without a path ends with its smaller side."""
    links = [("s", "m1"), ("m1", "hub"), ("hub", "m2"), ("m2", "g"), ("g", "m0"), ("m0", "hub")] + [("hub", f"leaf{k}") for k in range(300)]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links] + [("lone", "lone")], "source string, target string")
    sizes, write = [], J.written

    def counted(df, where):
        out = write(df, where)
        sizes.extend([out.count()] * (not where.endswith("hops")))
        return out

    monkeypatch.setattr(J, "written", counted)
    got = J.between(spark.createDataFrame([(1, "s", "g"), (2, "s", "lone")], "pair int, start string, goal string"), edges).collect()
    assert sorted((r["pair"], r["step"], r["id"]) for r in got) == [(1, 0, "s"), (1, 1, "m1"), (1, 2, "hub"), (1, 3, "m0"), (1, 4, "g")]
    assert max(sizes) < 20
