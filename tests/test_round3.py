"""Tests of the findings of round 3."""


def _plans(df, word):
    return df._jdf.queryExecution().executedPlan().toString().count(word)


def test_gap_edges_meet_pairs(spark):
    """Edges, loops and parallel edges of many gaps at one node; no join by one end alone."""
    from graphloom.operators import gaps

    g = spark.createDataFrame([("g1", ["m", "x"]), ("g2", ["m", "y"]), ("g2", ["m", "y"]), ("g3", ["z"]), ("g4", [None, "x", "x"]), ("g5", None)], "gap_id string, related array<string>")
    e = spark.createDataFrame([("m", "x", "A"), ("x", "m", "A"), ("x", "m", "B"), ("x", "m", "B"), ("m", "m", "L"), ("y", "x", "A"), ("z", "z", "L"), (None, "m", "A"), ("m", None, "A")], "source string, target string, type string")
    out = gaps.gap_edges(g, e)
    want = {("g1", "m", "x", "A"), ("g1", "x", "m", "A"), ("g1", "x", "m", "B"), ("g1", "m", "m", "L"), ("g2", "m", "m", "L"), ("g3", "z", "z", "L")}
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(want) and set(rows) == want
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and joins[0].count(" = ") == 2


def test_upserts_fold_in_order(spark):
    """Proposals of one pair in order, parallel edges, null ends and null confidences, without a Python function a pair."""
    from graphloom.operators import similarity

    kinds = "source string, target string, type string, confidence double, pos int"
    edges = spark.createDataFrame([("a", "b", "X", 0.5, 1), ("a", "b", "Y", 0.7, 0), ("c", "d", "X", 0.5, 0), ("k", "l", "X", None, 0), (None, "n", "X", 0.1, 0), ("s", "t", "X", 0.3, 4), ("s", "t", "X", 0.2, 5)], kinds)
    more = spark.createDataFrame([
        ("a", "b", "X", 0.6, 0), ("a", "b", "Z", 0.65, 1), ("a", "b", "Z", 0.7, 2), ("a", "b", "W", 0.9, 3), ("c", "d", "X", 0.4, 0), ("e", "f", "Q", 0.2, 9), ("e", "f", "R", 0.2, 10),
        ("k", "l", "X", 0.2, 0), (None, "n", "Y", 0.9, 0), ("s", "t", "X", 0.9, 0),
    ], kinds)
    out = similarity.upsert_edges(edges, more)
    assert out.columns == ["source", "target", "type", "confidence", "pos", "origin"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [
        ("a", "b", "W", 0.9, 3, "replaced"), ("c", "d", "X", 0.5, 0, "kept"), ("e", "f", "R", 0.2, 10, "replaced"), ("k", "l", "X", 0.2, 0, "updated"),
        (None, "n", "X", 0.1, 0, "kept"), (None, "n", "Y", 0.9, 0, "added"), ("s", "t", "X", 0.9, 4, "updated"), ("s", "t", "X", 0.2, 5, "kept"),
    ]))
    assert _plans(out, "InArrow") == 0


def test_bounded_neighbours(spark):
    """With a similarity bound every list is the exact one above it: copies, near copies, zero vectors, and few probes found both ways."""
    import numpy as np

    from graphloom.operators import knn

    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 12))
    v = np.concatenate((base, base[:90] + rng.normal(size=(90, 12)) * 0.25, base[:9], base[:1], np.zeros((2, 12))))
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    sim = np.round(u @ u.T, 9)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id bigint, embedding array<double>")
    want = {}
    for k in range(len(v)):
        for rank, j in enumerate(np.lexsort((np.arange(len(v)), -sim[k]))[: len(v)][[x != k for x in np.lexsort((np.arange(len(v)), -sim[k]))]][:5]):
            if sim[k, j] >= 0.8:
                want[k, rank + 1] = int(j)
    got = {(r["id"], r["rank"]): r["other"] for r in knn.nearest_of_all(df, 5, least=0.8, target=0.5).collect()}
    assert got == want
    few = {(r["id"], r["other"]) for r in knn.nearest_of_all(df, 5, least=0.8, cells=12, sample=240, probes=2).collect()}
    exact = {(k, j) for (k, _), j in want.items()}
    assert len(few & exact) >= 0.9 * len(exact)
    far = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(200, 60)))], "id bigint, v array<double>")
    assert knn.fit(far, 200, 5, least=0.85, target=0.9)[1] < knn.fit(far, 200, 5, target=0.9)[1]  # the bound, not the far nearest, says how many


def test_similar_pairs(spark):
    """Every pair of classes in and across blocks, each copy with its class only, zero and null vectors with nothing."""
    import numpy as np

    from graphloom.operators import similarity

    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 6))
    v = [*base.tolist(), *base[:3].tolist(), base[0].tolist(), [0.0] * 6, [0.0] * 6, None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id bigint, embedding array<double>")
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if round(float(u[a] @ u[b]), 9) >= 0.6} | {(0, 40), (1, 41), (2, 42), (0, 43)}
    for block in (7, 1000):
        rows = [(r["a"], r["b"]) for r in similarity.similar_pairs(df, 0.6, block=block).collect()]
        assert len(rows) == len(want) and set(rows) == want
    assert similarity.similar_pairs(df.where("id < 0"), 0.6).count() == 0


def test_titles_of_one_form_are_one(spark):
    """Copies of a title and of a query are compared once: each query gets the smallest paper_id, and a long title takes one pass."""
    import time

    from graphloom.functions import text as T

    words = " ".join(f"w{k * 7919 % 99991}" for k in range(60_000))
    papers = spark.createDataFrame([(9, "Copper slag flotation kinetics"), (4, "copper slag, flotation kinetics!"), (5, words + " unusual closing words of it"), (6, None), (7, " ")], "paper_id int, title string")
    queries = spark.createDataFrame([(1, "copper slag flotation kinetics"), (2, "Copper slag flotation kinetics."), (3, "unusual closing words of it"), (8, None)], "query_id int, query string")
    began = time.time()
    out = T.best_titles(queries, papers)
    got = {(r["query_id"], r["paper_id"], r["score"]) for r in out.collect()}
    assert got == {(1, 4, 1.0), (2, 4, 1.0), (3, 5, 0.95)}
    assert time.time() - began < 60
    assert "Aggregate [t#" in out._jdf.queryExecution().optimizedPlan().toString() and "Aggregate [q#" in out._jdf.queryExecution().optimizedPlan().toString()


def test_bridges_join_each_edge_once(spark):
    from graphloom.operators import gaps

    n = spark.createDataFrame([("a", 1, 0.6), ("b", 2, 0.7), ("c", 2, 0.5), ("d", None, 0.9), ("e", 1, 0.4)], "id string, cluster_id int, bridge_score double")
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "c"), ("c", "d"), ("d", "b"), ("e", "b"), ("e", "c"), ("c", "gone")], "source string, target string")
    out = gaps.bridges(n, e)
    assert {(r["id"], r["confidence"]) for r in out.collect()} == {("a", 0.76), ("b", 0.78), ("c", 0.74)}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """Every labelled row trains or scales, by several replicas; words that only few rows have are learnt; runs of unknown words cut short change no maximum."""
    import zlib

    import numpy as np

    from graphloom.llm import toxicity

    rng = np.random.default_rng(8)
    learn = [k for k in range(2400) if zlib.crc32(str(k).encode()) % 3 != 1]
    texts = {k: " ".join(f"w{x}" for x in rng.integers(0, 200, 12)) + (f" bad{k % 9}" if k % 4 == 0 else "") for k in range(2400)}
    docs = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in texts], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "REPLICA_ROWS", 300)
    seen, sizes = [], toxicity._start
    monkeypatch.setattr(toxicity, "_start", lambda known, z, rate: seen.append(rate) or sizes(known, z, rate))
    scored = toxicity.score(docs, labels).collect()
    test = [r for r in scored if r["held_out"]]
    assert len(test) + len(learn) == 2400 and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in test]) > 0.97
    assert abs(seen[0] - 0.25) < 0.02
    known = np.sort(rng.choice(toxicity.BUCKETS, 60_000, replace=False))
    net, _ = toxicity._start(known, rng.normal(size=len(known)), 0.3)
    raw = [t.encode() for t in list(texts.values())[:50]] + [b"", b"one", b"a b", b"a b c d e f"]
    cut = list(toxicity._encoded(raw, known))
    got = toxicity._pooled(net.rows[np.concatenate(cut)].sum(1), np.concatenate(([0], np.cumsum([len(c) for c in cut]))), net) @ net.out + net.bias
    assert np.allclose(got, toxicity.logits(raw, net), atol=1e-5) and sum(map(len, cut)) < sum(len(t.split()) for t in raw)


def test_decontamination_meets_few_texts_at_once(monkeypatch):
    """No task decodes or indexes a whole batch; the results are those of one shard."""
    import pyarrow as pa

    from graphloom.llm import decontam

    query = decontam.phrases([("1", b"one two three"), ("2", b"x")])
    monkeypatch.setattr(decontam, "_read_query", lambda f: query)
    texts = pa.array(["a one two three b", None, "x " * 40, "", "three two one", "x"] * 50)
    want = list(decontam.search_shard([(t or "").encode() for t in texts.to_pylist()], [query]))
    sizes, search = [], decontam.search_shard
    monkeypatch.setattr(decontam, "SHARD_BYTES", 100)
    monkeypatch.setattr(decontam, "search_shard", lambda t, q: sizes.append(sum(map(len, t))) or search(t, q))
    assert list(decontam._found(texts.slice(6), ["f"])) == want[6:]
    assert list(decontam._found(texts[:0], ["f"])) == [] and max(sizes) <= 100 and len(sizes) > 40


def test_batches_for_workers_are_bounded(spark, tmp_path):
    """Token output: no batch of whole texts, whatever its rows, is held at once by a worker and its JVM; the setting does not outlive the write."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    import public_tokenizers
    from graphloom.functions.shared import batches_of
    from graphloom.llm import tokens

    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 100).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "b"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with batches_of(spark, 1 << 18):
        n, most = docs.mapInArrow(sizes, "n bigint, b bigint").agg(F.sum("n"), F.max("b")).first()
    assert n == 3000 and most < 1 << 19
    seen = []
    write = tokens.written
    tokens.written = lambda df, where: seen.append(spark.conf.get(key)) or write(df, where)
    try:
        out = tokens.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), uri=f"file://{tmp_path}/t")
    finally:
        tokens.written = write
    assert seen == [str(tokens.BATCH_BYTES)] and spark.conf.get(key) == before
    assert out.count() == 3000


def test_communities_carry_numbers(spark, monkeypatch):
    """Rounds hold numbers, not names, and give the communities and numbers of the names; a name is as long as it likes, an unknown end keeps its links."""
    from graphloom.operators import metrics

    names = [f"{c}{k}" * 3 for c in "ab" for k in range(4)]
    pairs = [(x, y, 1.0) for x in names for y in names if x < y and x[0] == y[0]] + [(names[0], names[4], 0.1), ("gone", names[5], 1.0), (None, names[1], 1.0)]
    nodes = spark.createDataFrame([(x,) for x in [*names, "lone"]], "id string")
    edges = spark.createDataFrame(pairs, "source string, target string, weight double")
    rounds, write = [], metrics.written
    monkeypatch.setattr(metrics, "written", lambda df, where: rounds.append((where.split("/")[-1], dict(df.dtypes))) or write(df, where))
    got = {r["id"]: r["cluster_id"] for r in metrics.communities(nodes, edges).collect()}
    assert got == {x: "ab".index(x[0]) for x in names} | {"lone": 2}
    assert all("string" not in kinds.values() for where, kinds in rounds if where[:1] in "cgrm")
    none = metrics.communities(nodes, edges.where("false"))
    assert sorted(r["cluster_id"] for r in none.collect()) == list(range(9))


def test_ranks_have_no_gaps(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphloom.operators.components import ranked

    ids = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("x"))
    got = {r["id"]: r["rank"] for r in ranked(ids.union(ids), f"file://{tmp_path}/r").collect()}
    assert [got[x] for x in sorted(got)] == list(range(5000))


def test_entities_need_direct_triples_only(spark, sf):
    """Entities of direct triples are those of all triples; the query joins no derived ones and reads its edges once."""
    from graphloom.operators import triples
    from graphloom.plans import registry
    from graphloom.plans.tables import table

    nodes = spark.createDataFrame([("m", "Material", "M"), ("a", "Application", ""), ("p", "Property", "P"), ("p", "Property", "P2"), ("x", "Unknown", "X")], "id string, type string, name string")
    edges = spark.createDataFrame([("m", "a", "APPLIED_IN", 1), ("m", "p", "IMPROVES", 2), ("m", "x", "IMPROVES", 1), ("gone", "p", "IMPROVES", 1), (None, "p", "IMPROVES", 1)], "source string, target string, type string, co_occurrence_count int")
    got = sorted(r[0] for r in triples.entities(triples.direct_triples(nodes, edges)).collect())
    assert got == sorted(r[0] for r in triples.entities(triples.triples(nodes, edges)).collect()) == ["M", "P", "P2", "a"]
    every = triples.triples(table(spark, sf, "nodes"), table(spark, sf, "edges"))
    for name, keep in (("i5_entities", lambda x: True), ("i12_entity_lookup", lambda x: x.startswith("Supplier"))):
        out = registry.QUERIES[name](spark, sf)
        assert {r[0] for r in out.collect()} == {x for r in every.collect() for x in (r["Subject"], r["Object"]) if keep(x)}
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") < 12
