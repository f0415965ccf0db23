"""The best title of each query, against all pairs; and the nearest goals, against a search from each."""

import random
import re

import pytest

from graphloom.functions import text as T

WORDS = "graph neural network learning deep of the on large scale method alloy steel titanium oxide a b spectroscopy xspectroscopyofoxides electroencephalography".split()


def plain_score(query, title):
    norm = lambda x: re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()
    q, t = norm(query), norm(title)
    if not q or not t:
        return 0.0
    if q == t:
        return 1.0
    if min(len(q), len(t)) >= 16 and (q in t or t in q):
        return 0.95
    words = lambda x: {w for w in re.findall("[a-z0-9]+", x) if len(w) > 2 and w not in T.STOP_WORDS}
    a, b = words(q), words(t)
    return 0.7 * len(a & b) / len(a) + 0.3 * len(a & b) / len(b) if a and b else 0.0


@pytest.mark.parametrize("least", [0.6, 0.2, 0.97])
def test_best_titles(spark, least):
    rnd = random.Random(5)
    title = lambda: " ".join(rnd.choices(WORDS, k=rnd.randint(0, 7)))
    papers = [(k, title()) for k in range(120)] + [(900, None), (901, ""), (902, "Of the"), (903, "A B"), (904, "yelectroencephalographyz")]
    queries = [(k, title()) for k in range(80)] + [(800, None), (801, "of THE"), (802, "a - b!"), (803, "Electroencephalography"), (804, "titanium " * 500 + "oxide")] + [(k + 500, t.upper() + "!") for k, t in papers[:10]]
    got = {r["query_id"]: (r["paper_id"], round(r["score"], 9)) for r in T.best_titles(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(papers, "paper_id int, title string"), least).collect()}
    want = {}
    for q, text in queries:
        score, paper = max((round(plain_score(text, t), 9), -p) for p, t in papers)
        if score >= least:
            want[q] = (-paper, score)
    assert got == want


def test_nearest_goals(spark):
    from graphloom.operators import metrics

    rnd = random.Random(7)
    nodes = [(f"n{k}", "FailureMode" if k % 6 == 0 else "Material") for k in range(60)]
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(90)]
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    got = {r["id"]: r["proximity"] for r in metrics.proximity(spark.createDataFrame(nodes, "id string, type string"), spark.createDataFrame([*edges, (None, "n0")], "source string, target string"), hops=4).collect()}
    for v, _ in nodes:
        level, here = {v: 0}, [v]
        for k in range(1, 5):
            here = [y for x in here for y in adj.get(x, ()) if level.setdefault(y, k) == k]
        d = min((level[g] for g, t in nodes if t == "FailureMode" and g != v and g in level), default=None)
        assert got[v] == pytest.approx(0.0 if d is None else 1 / (d + 1))
