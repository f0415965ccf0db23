"""Graph metrics: weights, degrees, PageRank, paths-based measures, communities, bridges."""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written
from graphloom.operators import blocks, reach
from graphloom.operators.components import connected_components, numbered, ranked


def collapsed(edges: DataFrame, order: str = "pos") -> DataFrame:
    """Parallel edges collapse to the last listed of each (source, target); a missing weight is 1."""
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    w = Window.partitionBy("source", "target").orderBy(F.desc(order), F.desc("type"))
    return edges.withColumn("weight", weight).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clean_weights(edges: DataFrame, eps: float = 1e-9) -> DataFrame:
    """no self-loops; weights that are not positive become eps; inverse_weight = min(1 / weight, 1e9)."""
    raw = F.col("weight").try_cast("double")
    weight = F.when(raw > 0, raw).otherwise(F.lit(eps))
    return edges.where("source <> target").withColumn("weight", weight).withColumn("inverse_weight", F.least(1 / F.col("weight"), F.lit(1e9)))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree_in, degree_out, degree_centrality ((in + out) / (n - 1); 0 for one node)."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("degree_in"), F.sum("o").alias("degree_out"))
    n = nodes.agg(F.count("*").alias("n"))
    out = nodes.select("id").join(sums, "id", "left").join(F.broadcast(n))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    both = zero("degree_in") + zero("degree_out")
    return out.select("id", zero("degree_in").alias("degree_in"), zero("degree_out").alias("degree_out"), F.when(F.col("n") > 1, both / (F.col("n") - 1)).otherwise(0.0).alias("degree_centrality"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, weighted: bool = True) -> DataFrame:
    """id, pagerank.  Dangling mass is spread evenly; with tolerance 0 all rounds run.

    Shares are a written table; each round is one join and one aggregate, and its ranks are written to the shared folder, since the
    next round reads them three times.  A relation subset is a filter on edges before the call.
    """
    spark = nodes.sparkSession
    where = shared_dir(spark)
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if weighted and "weight" in edges.columns else F.lit(1.0)
    inside = edges.select("source", "target", weight.alias("w")).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    if weighted:
        inside = inside.where("w > 0")
    out = inside.groupBy("source").agg(F.sum("w").alias("total"))
    share = written(inside.join(out, "source").select("source", "target", (F.col("w") / F.col("total")).alias("p")), f"{where}/edges")
    senders = share.select(F.col("source").alias("id")).distinct().withColumn("sends", F.lit(True))
    ranks = written(ids.join(senders, "id", "left").select("id", F.coalesce("sends", F.lit(False)).alias("sends"), F.lit(1.0 / n).alias("pagerank")), f"{where}/0")
    for k in range(1, rounds + 1):
        given = share.join(ranks, share["source"] == ranks["id"]).groupBy("target").agg(F.sum(F.col("p") * F.col("pagerank")).alias("got"))
        lost = ranks.where("not sends").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("lost"))
        value = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        new = ranks.join(given, ranks["id"] == given["target"], "left").join(F.broadcast(lost)).select("id", "sends", value.alias("pagerank"), F.abs(value - F.col("pagerank")).alias("moved"))
        new = written(new, f"{where}/{k}")
        if tolerance and k % 5 == 0 and (new.agg(F.sum("moved")).first()[0] or 0.0) < n * tolerance:
            return new.select("id", "pagerank")
        ranks = new.select("id", "sends", "pagerank")
    return ranks.select("id", "pagerank")


def component_ids(nodes: DataFrame, edges: DataFrame, order: str = "pos", within: bool = False) -> DataFrame:
    """id, component_id: weak components numbered from 0 by their first node; within: edges with an end that is no node join nothing.

    Up to ``blocks.NODES`` names, edges are numbered once and join components block by block; beyond, by rounds of joins.
    """
    where = shared_dir(nodes.sparkSession)
    ids = nodes.select("id").where("id is not null")
    ends = [edges.select(F.col(c).alias("id")) for c in ("source", "target")]
    names = written(ranked(ids if within else ids.union(ends[0]).union(ends[1]).where("id is not null"), f"{where}/names"), f"{where}/ranks")
    n = names.count()
    own = nodes.select("id", F.col(order).alias("_at"))
    if n <= blocks.NODES:
        label = blocks.components(blocks.packed(blocks.named_ends(names, edges), f"{where}/edges"), n)
        if within and order == "id":  # the smallest of a component is its first
            return blocks.looked_up(nodes.select("id").join(names, "id"), np.unique(label, return_inverse=True)[1], "component_id")
        named = own.join(blocks.looked_up(names, label, "label"), "id")
    else:
        if within:
            edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        found = connected_components(edges, "source", "target")
        named = own.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = written(named, f"{where}/named")
    firsts = written(named.groupBy("label").agg(F.min(F.struct("_at", "id")).alias("first")), f"{where}/firsts")
    place = ranked(firsts.select("first"), f"{where}/places").select(F.col("id").alias("first"), F.col("rank").cast("int").alias("component_id"))
    return named.join(firsts.join(place, "first").select("label", "component_id"), "label").select("id", "component_id")


def distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame, cost: Column | None = None, max_rounds: int = 100_000) -> DataFrame:
    """(src, id, dist, sigma): for every source the distances of all it reaches and the number of shortest paths.

    Sources run in parallel: one relaxation round joins the frontier of all sources with the edges.  edges: source, target, and
    inverse_weight unless cost is given.  Rounds go on until nothing moves; max_rounds is a safety limit that raises.
    """
    spark = nodes.sparkSession
    where = shared_dir(spark)
    hops = written(edges.where("source <> target").select("source", "target", (F.col("inverse_weight") if cost is None else cost).cast("double").alias("c")), f"{where}/edges")
    state = written(sources.select(F.col("id").alias("src"), "id", F.lit(0.0).alias("dist")), f"{where}/0")
    frontier = state
    for k in range(1, max_rounds + 1):
        step = frontier.join(hops, frontier["id"] == hops["source"]).groupBy("src", "target").agg(F.min(F.col("dist") + F.col("c")).alias("new"))
        merged = state.join(step.withColumnRenamed("target", "id"), ["src", "id"], "full")
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist") - 1e-12))
        state = written(merged.select("src", "id", F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"), better.alias("fresh")), f"{where}/{k}")
        frontier = state.where("fresh").select("src", "id", "dist")
        state = state.select("src", "id", "dist")
        if frontier.limit(1).count() == 0:
            return state
    raise RuntimeError(f"distances: paths still get shorter after {max_rounds} rounds")


def _shortest_dag(dist: DataFrame, edges: DataFrame, cost: Column) -> DataFrame:
    """(src, source, target, at): the edges on shortest paths from each source; at: the distance of the target."""
    e = edges.where("source <> target").select("source", "target", cost.alias("c"))
    a = dist.select("src", F.col("id").alias("source"), F.col("dist").alias("da"))
    b = dist.select("src", F.col("id").alias("target"), F.col("dist").alias("db"))
    return a.join(e, "source").join(b, ["src", "target"]).where(F.abs(F.col("da") + F.col("c") - F.col("db")) <= reach.EQUAL * (1 + F.abs("db"))).where("da < db").select("src", "source", "target", "da", "db")


def _hop_levels(dist: DataFrame, dag: DataFrame, where: str) -> DataFrame:
    """(src, id, level): the most edges on a shortest path from src; all predecessors of a node are on lower levels."""
    level = written(dist.where("src = id").select("src", "id", F.lit(0).alias("level"), F.lit(True).alias("fresh")), f"{where}/l0")
    k = 0
    while level.where("fresh").limit(1).count():
        k += 1
        up = dag.join(level.where("fresh").select("src", F.col("id").alias("source"), "level"), ["src", "source"]).groupBy("src", F.col("target").alias("id")).agg((F.max("level") + 1).alias("new"))
        both = level.select("src", "id", "level").join(up, ["src", "id"], "full")
        higher = F.col("new").isNotNull() & (F.col("level").isNull() | (F.col("new") > F.col("level")))
        level = written(both.select("src", "id", F.when(higher, F.col("new")).otherwise(F.col("level")).alias("level"), higher.alias("fresh")), f"{where}/l{k}")
    return level.drop("fresh")


def dependencies(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, id, delta): Brandes' dependency of each source on each node: the share of its shortest paths that lead through the node, summed over the targets.

    Up to ``reach.EDGES`` edges, each task walks the whole graph from its own sources and returns dependencies above 0; beyond, all
    sources at once: distances, then path counts forward and dependencies backward by the hops of shortest paths, so the number of
    rounds is that of their edges, whatever the weights.
    """
    where = shared_dir(nodes.sparkSession)
    hops = written(edges.where("source <> target").select("source", "target", F.col("inverse_weight").cast("double").alias("c")), f"{where}/hops")
    if hops.count() <= reach.EDGES:
        kind = sources.schema["id"].dataType.simpleString()

        def walk(g, v):
            src, at, delta = reach.dependencies(g, v)
            yield pa.RecordBatch.from_arrays([g.names.take(pa.array(v[src])), g.names.take(pa.array(at)), pa.array(delta)], names=["src", "id", "delta"])

        return reach.from_each(sources, reach.graph(hops, sources), walk, f"src {kind}, id {kind}, delta double")
    return _dependencies_by_joins(nodes, hops.withColumnRenamed("c", "inverse_weight"), sources, where)


def _dependencies_by_joins(nodes: DataFrame, edges: DataFrame, sources: DataFrame, where: str) -> DataFrame:
    """(src, id, delta) for graphs too large to be broadcast, 0 too: a row for each pair of a source and a node it reaches."""
    dist = written(distances(nodes, edges, sources), f"{where}/dist")
    dag = written(_shortest_dag(dist, edges, F.col("inverse_weight").cast("double")).select("src", "source", "target"), f"{where}/edges")
    level = _hop_levels(dist, dag, where)
    lv = level.select("src", F.col("id").alias("target"), F.col("level").alias("lt"))
    dag = written(dag.join(lv, ["src", "target"]).join(lv.select("src", F.col("target").alias("source"), F.col("lt").alias("ls")), ["src", "source"]), f"{where}/dag")
    top = level.agg(F.max("level")).first()[0] or 0
    sigma = written(level.where("level = 0").select("src", "id", F.lit(1.0).alias("sigma")), f"{where}/s0")
    for k in range(1, top + 1):
        new = dag.where(F.col("lt") == k).join(sigma.withColumnRenamed("id", "source"), ["src", "source"]).groupBy("src", F.col("target").alias("id")).agg(F.sum("sigma").alias("sigma"))
        sigma = sigma.unionByName(written(new, f"{where}/s{k}"))
    paths = dag.join(sigma.withColumnRenamed("id", "source").withColumnRenamed("sigma", "ss"), ["src", "source"]).join(sigma.withColumnRenamed("id", "target").withColumnRenamed("sigma", "st"), ["src", "target"])
    paths = written(paths.select("src", "source", "target", "ls", (F.col("ss") / F.col("st")).alias("r")), f"{where}/paths")
    delta = written(level.select("src", "id", F.lit(0.0).alias("delta")).where("false"), f"{where}/d0")
    for k in range(top - 1, -1, -1):
        got = paths.where(F.col("ls") == k).join(delta.withColumnRenamed("id", "target"), ["src", "target"], "left").groupBy("src", F.col("source").alias("id")).agg(F.sum(F.col("r") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("delta"))
        delta = delta.unionByName(written(got, f"{where}/d{k + 1}"))
    return delta.where("src <> id")


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
    """id, betweenness on inverse_weight, directed and normalised by (n-1)(n-2); 0 for fewer than three nodes.

    Exact over all sources; with ``pivots`` the sums over these sources are scaled by n / pivots.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if n < 3:
        return ids.withColumn("betweenness", F.lit(0.0))
    sources = ids if pivots is None else pivots.select("id").distinct()
    scale = 1.0 if pivots is None else n / max(1, sources.count())
    total = dependencies(nodes, edges, sources).groupBy("id").agg(F.sum("delta").alias("d"))
    return ids.join(total, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale / ((n - 1) * (n - 2))).alias("betweenness"))


def sampled_betweenness(nodes: DataFrame, edges: DataFrame, error: float = 0.05, risk: float = 0.1, first: int = 128, seed: int = 5) -> DataFrame:
    """F7 with a stated error: id, betweenness, bound, sources: with probability 1 - risk every value is within its bound, and no bound is above ``error``.

    Sources are drawn by a hash, twice as many each time, until the empirical Bernstein bound of each node, shared out over nodes and
    rounds, is small enough; when all are drawn, the values are exact and the bounds 0.  A source's dependency is counted once.
    """
    where = shared_dir(nodes.sparkSession)
    ids = written(nodes.select("id").distinct(), f"{where}/ids")
    edges = written(edges.select("source", "target", "inverse_weight"), f"{where}/hops")  # each round reads them
    n = ids.count()
    if n < 3:
        return ids.select("id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("bound"), F.lit(n).cast("bigint").alias("sources"))
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rounds = max(1, ceil(log2(max(2.0, n / first))) + 1)
    share = log(3 * n * rounds / risk)
    parts, low, drawn, k = None, 0.0, 0, 0
    while low < 1.0:
        k += 1
        high = min(1.0, first * 2 ** (k - 1) / n)
        some = written(ids.where((place >= low) & (place < high)), f"{where}/sources{k}")
        drawn, low = drawn + some.count(), high
        x = F.col("delta") / (n - 2)
        part = written(dependencies(nodes, edges, some).groupBy("id").agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2")), f"{where}/sums{k}")
        parts = part if parts is None else parts.unionByName(part)
        if not drawn:
            continue
        sums = ids.join(parts.groupBy("id").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2")), "id", "left").na.fill(0.0)
        spread = F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / drawn) / max(1, drawn - 1))
        bound = F.lit(0.0) if low >= 1.0 else F.sqrt(2 * spread * share / drawn) + 3 * share / drawn
        found = written(sums.select("id", (F.col("s1") / drawn * n / (n - 1)).alias("betweenness"), bound.alias("bound"), F.lit(drawn).cast("bigint").alias("sources")), f"{where}/found{k}")
        if found.agg(F.max("bound")).first()[0] <= error:
            return found
    return found


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """F8: id, out_closeness: (r / (n - 1)) * (r / sum of distances), r reached nodes."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    hops = written(edges.where("source <> target").select("source", "target", F.col("inverse_weight").cast("double").alias("c")), f"{shared_dir(nodes.sparkSession)}/hops")
    if hops.count() <= reach.EDGES:  # each task adds up what its own sources reach

        def sums(g, v):
            dist = reach.distances(g, v)
            far = dist < np.inf
            yield pa.RecordBatch.from_arrays([g.names.take(pa.array(v)), pa.array(far.sum(1) - 1), pa.array(np.where(far, dist, 0.0).sum(1))], names=["id", "r", "s"])

        found = reach.from_each(ids, reach.graph(hops, ids), sums, f"id {ids.schema['id'].dataType.simpleString()}, r bigint, s double")
    else:
        found = distances(nodes, hops, ids, F.col("c")).where("src <> id").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("r"), F.sum("dist").alias("s"))
    value = F.when((F.col("s") > 0) & F.lit(n > 1), (F.col("r") / max(1, n - 1)) * (F.col("r") / F.col("s"))).otherwise(0.0)
    return ids.join(found, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("out_closeness"))


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(id, scc): scc is the smallest node of the strongly connected component.

    Rounds of colouring: every open node takes the smallest id that reaches it; nodes that reach their colour's root inside the colour
    form its component and leave.  Nodes without open predecessors or successors leave first as components of one.
    """
    spark = nodes.sparkSession
    where = shared_dir(spark)
    open_ = written(nodes.select("id").distinct(), f"{where}/open")
    hops = written(edges.select("source", "target").where("source <> target").distinct(), f"{where}/hops")
    done = open_.select("id", F.col("id").alias("scc")).where("false")
    serial = 0
    for _ in range(max_rounds):
        live = hops.join(open_.withColumnRenamed("id", "source"), "source", "left_semi").join(open_.withColumnRenamed("id", "target"), "target", "left_semi")
        serial += 1
        live = written(live, f"{where}/live{serial}")
        trivial = open_.join(live.select(F.col("source").alias("id")), "id", "left_anti").union(open_.join(live.select(F.col("target").alias("id")), "id", "left_anti")).distinct()
        serial += 1
        trivial = written(trivial, f"{where}/t{serial}")
        if trivial.limit(1).count():
            done = done.unionByName(trivial.select("id", F.col("id").alias("scc")))
            serial += 1
            open_ = written(open_.join(trivial, "id", "left_anti"), f"{where}/open{serial}")
            if open_.limit(1).count() == 0:
                break
            continue
        color = open_.select("id", F.col("id").alias("color"))
        while True:
            near = live.join(color.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("color").alias("c"))
            serial += 1
            new = written(color.join(near, "id", "left").select("id", F.least("color", F.coalesce("c", "color")).alias("color"), (F.coalesce("c", "color") < F.col("color")).alias("moved")), f"{where}/c{serial}")
            color = new.select("id", "color")
            if new.where("moved").limit(1).count() == 0:
                break
        member = color.where("id = color")
        while True:
            back = live.join(member.select(F.col("id").alias("target"), F.col("color").alias("ct")), "target").join(color.withColumnRenamed("id", "source"), "source").where("color = ct").select(F.col("source").alias("id"), "color").distinct()
            serial += 1
            new = written(back.join(member.select("id"), "id", "left_anti"), f"{where}/m{serial}")
            if new.limit(1).count() == 0:
                break
            serial += 1
            member = written(member.unionByName(new), f"{where}/m{serial}")
        done = done.unionByName(member.select("id", F.col("color").alias("scc")))
        serial += 1
        open_ = written(open_.join(member, "id", "left_anti"), f"{where}/open{serial}")
        if open_.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"strong_components: nodes are still open after {max_rounds} rounds")
    return done


def prerequisites(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """id, prerequisite_depth (longest chain of components before it) and learning_effort (difficulties of its own component
    plus the largest effort of a component before it; difficulty 3 where missing).  edges: prerequisite (source) of (target)."""
    spark = nodes.sparkSession
    where = shared_dir(spark)
    scc = written(strong_components(nodes, edges), f"{where}/scc")
    own = nodes.select("id", F.coalesce(F.col("difficulty").cast("double"), F.lit(3.0)).alias("d")).join(scc, "id").groupBy("scc").agg(F.sum("d").alias("own"))
    hops = edges.join(scc.select(F.col("id").alias("source"), F.col("scc").alias("a")), "source").join(scc.select(F.col("id").alias("target"), F.col("scc").alias("b")), "target").where("a <> b").select("a", "b").distinct()
    hops = written(hops, f"{where}/hops")
    state = written(own.select("scc", "own", F.lit(0).alias("depth"), F.col("own").alias("effort")), f"{where}/0")
    for k in range(1, max_rounds + 1):
        up = hops.join(state.select(F.col("scc").alias("a"), "depth", "effort"), "a").groupBy(F.col("b").alias("scc")).agg(F.max("depth").alias("md"), F.max("effort").alias("me"))
        depth, effort = F.coalesce(F.col("md") + 1, F.lit(0)), F.col("own") + F.coalesce("me", F.lit(0.0))
        new = written(state.join(up, "scc", "left").select("scc", "own", depth.alias("depth"), effort.alias("effort"), ((depth != F.col("depth")) | (effort != F.col("effort"))).alias("moved")), f"{where}/{k}")
        state = new.drop("moved")
        if new.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"prerequisites: depths still move after {max_rounds} rounds")
    return scc.join(state, "scc").select("id", F.col("depth").alias("prerequisite_depth"), F.col("effort").alias("learning_effort"))


def material_counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, synthesis_diversity (on targets of SYNTHESIZED_BY), property_coverage, application_breadth, characterization_richness (always 0), failure_modes."""
    at_source = edges.groupBy(F.col("source").alias("id")).agg(
        F.count_if(F.col("type").isin("IMPROVES", "DEGRADES", "CHARACTERIZED_BY")).alias("property_coverage"),
        F.count_if(F.col("type") == "APPLIED_IN").alias("application_breadth"), F.count_if(F.col("type") == "HAS_FAILURE_MODE").alias("failure_modes"),
    )
    at_target = edges.where("type = 'SYNTHESIZED_BY'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("synthesis_diversity"))
    out = nodes.select("id").join(at_source, "id", "left").join(at_target, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("id", zero("synthesis_diversity"), zero("property_coverage"), zero("application_breadth"), F.lit(0).cast("bigint").alias("characterization_richness"), zero("failure_modes"))


def proximity(nodes: DataFrame, edges: DataFrame, kind: str = "FailureMode", counts: DataFrame | None = None, hops: int = 5) -> DataFrame:
    """id, proximity: the larger of counts and 1 / (d + 1), d the steps (at most ``hops``) to a node of the kind other than itself.

    Each node carries the labels (d, goal) of its two nearest goals, so there are at most two rows a node, however many goals there are.
    """
    where = shared_dir(nodes.sparkSession)
    e = written(edges.where("source <> target").select("source", "target").distinct(), f"{where}/edges")
    labels = written(nodes.where(F.col("type") == kind).select("id", F.col("id").alias("goal"), F.lit(0).alias("d")).distinct(), f"{where}/0")
    frontier = labels
    for k in range(1, hops + 1):
        # The two nearest goals of a node are among the two nearest of the nodes it leads to; two are enough for one that is not the node itself.
        step = frontier.join(e, frontier["id"] == e["target"]).select(F.col("source").alias("id"), "goal").distinct().join(labels.select("id", "goal"), ["id", "goal"], "left_anti")
        first = step.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("goal"))).where("_k <= 2")
        have = labels.groupBy("id").agg(F.count("*").alias("_have"))
        frontier = written(first.join(have, "id", "left").where(F.col("_k") + F.coalesce("_have", F.lit(0)) <= 2).select("id", "goal", F.lit(k).alias("d")), f"{where}/{k}")
        labels = labels.unionByName(frontier)
        if frontier.limit(1).count() == 0:
            break
    near = labels.where("goal <> id").groupBy("id").agg(F.max(1.0 / (F.col("d") + 1)).alias("p"))
    out = nodes.select("id").join(near, "id", "left")
    if counts is None:
        return out.select("id", F.coalesce("p", F.lit(0.0)).alias("proximity"))
    return out.join(counts.select("id", F.col("failure_modes").cast("double").alias("c")), "id", "left").select("id", F.greatest(F.coalesce("p", F.lit(0.0)), F.coalesce("c", F.lit(0.0))).alias("proximity"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w): the weights of both directions added, a < b."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return edges.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(weight).alias("w"))


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 4) -> DataFrame:
    """id, cluster_id: modularity communities by local moving and aggregation, numbered by their smallest node.

    All nodes weigh their moves at once; in alternate rounds only moves to a smaller (or larger) community name count, which keeps
    pairs from swapping, and ties go to the smaller name, so the result is deterministic.  Before a level's communities become nodes,
    each is split into its connected parts, which never lowers modularity, so no community is disconnected.  Nodes travel as numbers in
    the order of their names; a null name is no node.  Up to ``blocks.NODES`` names the edges stay in blocks and communities are
    broadcast; beyond, rounds are joins.
    """
    where = shared_dir(nodes.sparkSession)
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    own = written(edges.where("source <> target").select("source", "target", weight.alias("weight")), f"{where}/edges")
    names = written(ranked(nodes.select("id").union(own.select("source")).union(own.select("target")).where("id is not null"), f"{where}/names"), f"{where}/numbers")
    n = names.count()
    pairs = undirected(blocks.named_ends(names, own, F.col("weight")).withColumnsRenamed({"a": "source", "b": "target"}))
    both = pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    listed = written(nodes.select("id").distinct().join(names, "id"), f"{where}/listed")
    if n > blocks.NODES:
        return _communities_by_joins(both, listed.select("id", F.col("rank").alias("n")), where, resolution, rounds, levels)
    com = blocks.communities(blocks.packed(both, f"{where}/g0", by_node=True), n, where, resolution, rounds, levels)
    ranks = np.sort(listed.select("rank").toArrow()["rank"].to_numpy())
    _, first, which = np.unique(com[ranks], return_index=True, return_inverse=True)
    cluster = np.zeros(n, np.int32)
    cluster[ranks] = np.argsort(np.argsort(first))[which]
    return blocks.looked_up(listed, cluster, "cluster_id")


def _communities_by_joins(graph: DataFrame, names: DataFrame, where: str, resolution: float, rounds: int, levels: int) -> DataFrame:
    """The communities of a graph (a, b, w; both directions) whose nodes are too many to be broadcast; names: (id, n)."""
    graph = written(graph, f"{where}/g0")
    total = graph.agg(F.sum("w")).first()[0] or 0.0
    member = written(names.select("n", F.col("n").alias("com")), f"{where}/m")
    for level in range(levels if total else 0):
        strength = graph.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k"))
        com = written(strength.select("v", "k", F.col("v").alias("com")), f"{where}/c{level}_0")
        changed = False
        for k in range(1, rounds + 1):
            sized = com.join(com.groupBy("com").agg(F.sum("k").alias("sum")), "com").select("v", "k", "com", "sum")
            # Each node tells its neighbours its community and that one's size; all that a node hears meets in one shuffle, and is added, weighed and chosen from there.
            heard = graph.where("a <> b").join(sized.select(F.col("v").alias("b"), F.col("com").alias("to"), F.col("sum").alias("size")), "b").select(F.col("a").alias("v"), "to", "size", "w")
            near = heard.repartition("v").groupBy("v", "to").agg(F.sum("w").alias("links"), F.first("size").alias("size"))
            here = F.col("to") == F.col("com")
            gain = F.col("links") - resolution * F.col("k") * (F.col("size") - F.when(here, F.col("k")).otherwise(0.0)) / total
            side = F.col("to") < F.col("com") if k % 2 else F.col("to") > F.col("com")
            scored = near.join(sized, "v").where(here | side).select("v", "to", here.alias("here"), gain.alias("gain"))
            other = lambda x: F.when(~F.col("here"), x)
            best = scored.groupBy("v").agg(F.max(F.when(F.col("here"), F.col("gain"))).alias("g0"), F.max(other(F.col("gain"))).alias("g"), F.min_by(other(F.col("to")), other(F.struct(-F.round("gain", 9), "to"))).alias("to"))
            stay = F.coalesce("g0", -resolution * F.col("k") * (F.col("sum") - F.col("k")) / total)
            better = F.coalesce(F.col("g") > stay + 1e-9, F.lit(False))
            moved = written(sized.join(best, "v", "left").select("v", "k", F.when(better, F.col("to")).otherwise(F.col("com")).alias("com"), better.alias("moved")), f"{where}/c{level}_{k}")
            any_moved = moved.where("moved").limit(1).count() > 0
            com = moved.drop("moved")
            changed |= any_moved
            if not any_moved and k > 1:
                break
        com = written(_connected(graph, com), f"{where}/r{level}")
        member = written(member.join(com.select(F.col("v").alias("com"), F.col("com").alias("new")), "com", "left").select("n", F.coalesce("new", "com").alias("com")), f"{where}/m{level}")
        if not changed:
            break
        merged = graph.join(com.select(F.col("v").alias("a"), F.col("com").alias("ca")), "a").join(com.select(F.col("v").alias("b"), F.col("com").alias("cb")), "b")
        graph = written(merged.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), f"{where}/g{level + 1}")
    firsts = written(member.groupBy("com").agg(F.min("n").alias("first")), f"{where}/firsts")
    place = ranked(firsts.select("first"), f"{where}/ranks").select(F.col("id").alias("first"), F.col("rank").alias("cluster_id"))
    return member.join(firsts.join(place, "first"), "com").join(names, "n").select("id", F.col("cluster_id").cast("int").alias("cluster_id"))


def _connected(graph: DataFrame, com: DataFrame) -> DataFrame:
    """(v, k, com) with communities split into their connected parts, each named by its smallest node."""
    own = com.select("v", "com")
    inside = graph.where("a < b").join(own.select(F.col("v").alias("a"), F.col("com").alias("ca")), "a").join(own.select(F.col("v").alias("b"), F.col("com").alias("cb")), "b").where("ca = cb")
    return com.drop("com").join(connected_components(inside).select(F.col("node").alias("v"), "label"), "v", "left").select("v", "k", F.coalesce("label", "v").alias("com"))


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a clustering (id, cluster_id) on the undirected projection."""
    pairs = undirected(edges)
    both = pairs.join(clusters.select(F.col("id").alias("a"), F.col("cluster_id").alias("ca")), "a").join(clusters.select(F.col("id").alias("b"), F.col("cluster_id").alias("cb")), "b")
    inside = both.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("i"))
    ends = both.select(F.col("ca").alias("c"), "w").unionByName(both.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return inside.join(ends).select((F.col("i") / F.col("m") - resolution * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def checked_clusters(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: connected (whether every cluster of (id, cluster_id) is connected by edges inside it) and the modularity of the clusters."""
    spark, where = edges.sparkSession, shared_dir(edges.sparkSession)
    own = clusters.select("id", "cluster_id").where("id is not null")
    names = written(ranked(own.select("id"), f"{where}/names"), f"{where}/ranks")
    n = names.count()
    if n > blocks.NODES:
        return _checked_by_joins(edges, clusters)
    packed = blocks.packed(blocks.named_ends(names, edges.where("source <> target"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w")), f"{where}/edges")
    rows = own.join(names, "id").select("rank", "cluster_id").toArrow()
    kinds, cluster = np.unique(rows["cluster_id"].to_numpy(), return_inverse=True)
    placed = np.zeros(n, np.int32)
    placed[rows["rank"].to_numpy()] = cluster

    def sums(a, b, w, placed):
        # The weight at each cluster, and behind these the weight inside each.
        x, y, most = placed[a], placed[b], int(placed.max()) + 1
        same = x == y
        found = np.concatenate((np.bincount(x, w, most) + np.bincount(y, w, most), np.bincount(x[same], w[same], most)))
        return np.flatnonzero(found), found[found != 0]

    at, x = blocks.asked(packed, sums, placed, kind=np.float64)
    total = np.bincount(at, x, 2 * len(kinds))
    m, k = total[: len(kinds)].sum() / 2, total[: len(kinds)]
    value = float(total[len(kinds) :].sum() / m - (k * k).sum() / (4 * m * m)) if m else None
    parts = len(np.unique(blocks.components(packed, n, placed)))
    return spark.createDataFrame([(parts == len(kinds), value)], "connected boolean, modularity double")


def _checked_by_joins(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    own = clusters.select(F.col("id").alias("source"), F.col("cluster_id").alias("c")), clusters.select(F.col("id").alias("target"), F.col("cluster_id").alias("c2"))
    inside = edges.join(own[0], "source").join(own[1], "target").where("c = c2")
    parts = connected_components(inside, "source", "target").join(clusters, F.col("node") == F.col("id")).groupBy("cluster_id").agg(F.count_distinct("label").alias("n"))
    lone = clusters.join(inside.select(F.col("source").alias("id")).union(inside.select("target")), "id", "left_anti").groupBy("cluster_id").agg(F.count("*").alias("n"))
    split = parts.unionByName(lone).groupBy("cluster_id").agg(F.sum("n").alias("n")).agg((F.max("n") == 1).alias("connected"))
    return split.join(F.broadcast(modularity(edges, clusters)))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other): distinct neighbours, either direction, without the node itself."""
    return edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source")).where("id <> other").distinct()


def bridge_scores(nodes: DataFrame, edges: DataFrame, weight: float = 0.7) -> DataFrame:
    """F16: id, bridge_score: weight * betweenness + (1 - weight) * share of neighbours in other clusters.  nodes: id, cluster_id, betweenness."""
    near = neighbours(edges).join(nodes.select("id", F.col("cluster_id").alias("c1")), "id").join(nodes.select(F.col("id").alias("other"), F.col("cluster_id").alias("c2")), "other")
    share = near.groupBy("id").agg(F.avg((F.col("c1") != F.col("c2")).cast("double")).alias("share"))
    return nodes.join(share, "id", "left").select("id", (weight * F.col("betweenness") + (1 - weight) * F.coalesce("share", F.lit(0.0))).alias("bridge_score"))


def inter_cluster(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with source_cluster, target_cluster and is_inter_cluster."""
    own = nodes.select("id", "cluster_id")
    out = edges.join(own.select(F.col("id").alias("source"), F.col("cluster_id").alias("source_cluster")), "source").join(own.select(F.col("id").alias("target"), F.col("cluster_id").alias("target_cluster")), "target")
    return out.withColumn("is_inter_cluster", F.col("source_cluster") != F.col("target_cluster"))


def safe_value(value: Column) -> Column:
    """null, NaN and infinities become 0."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def assembled(nodes: DataFrame, *metrics: DataFrame) -> DataFrame:
    """nodes with the columns of all metric tables (by id), numbers made safe."""
    out = nodes
    for m in metrics:
        safe = [safe_value(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes if c != "id"]
        out = out.join(m.select("id", *safe), "id", "left")
    return out


def mention_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """concept_id, nodes (sorted), n: the distinct neighbours of nodes of type Concept."""
    concepts = nodes.where("type = 'Concept'").select("id")
    near = neighbours(edges).join(concepts, "id", "left_semi")
    return near.groupBy(F.col("id").alias("concept_id")).agg(F.array_sort(F.collect_set("other")).alias("nodes"), F.count("*").alias("n"))


def node_concepts(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """id, concepts: the sorted distinct neighbours of the given types, empty where there is none."""
    own = nodes.where(F.col("type").isin(*kinds)).select(F.col("id").alias("other"))
    near = neighbours(edges).join(own, "other", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("concepts"))
    return nodes.select("id").join(near, "id", "left").select("id", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))


def largest(nodes: DataFrame, edges: DataFrame, n: int = 1000, by: str = "pagerank") -> tuple[DataFrame, DataFrame]:
    """the n nodes with the highest value and the edges among them."""
    top = nodes.orderBy(F.desc(by), "id").limit(n)
    ids = top.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return top, inside


def course_sequence(nodes: DataFrame) -> DataFrame:
    """id, position, cluster_id of chunks whose id is slug:c:N, to be read in order of position."""
    at = F.regexp_extract("id", r"^[^:]*:c:(\d+)$", 1)
    return nodes.where("type = 'Chunk'").where(at != "").select("id", at.cast("bigint").alias("position"), *(["cluster_id"] if "cluster_id" in nodes.columns else [])).orderBy("position", "id")


def cluster_tour(nodes: DataFrame) -> DataFrame:
    """the node of the highest PageRank of each cluster, in the order of clusters' mean depth."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("pagerank"), "id")
    top = nodes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("cluster_id", "id", "pagerank")
    at = nodes.groupBy("cluster_id").agg(F.avg(F.col("depth").cast("double")).alias("progress"))
    return top.join(at, "cluster_id").withColumn("step", F.row_number().over(Window.orderBy("progress", "cluster_id"))).select("step", "cluster_id", "id")


def compared(expected: DataFrame, actual: DataFrame, relative: float = 0.01, absolute: float = 0.001) -> DataFrame:
    """(id, metric, status): PASS, FAIL, MISS or NaN of long tables (id, metric, value)."""
    both = expected.select("id", "metric", F.col("value").alias("e")).join(actual.select("id", "metric", F.col("value").alias("a")), ["id", "metric"], "full")
    near = F.when(F.col("e") == 0, F.abs("a") <= absolute).otherwise(F.abs(F.col("a") - F.col("e")) <= relative * F.abs("e"))
    status = F.when(F.col("e").isNull() | F.col("a").isNull(), "MISS").when(F.isnan("e") | F.isnan("a"), "NaN").when(near, "PASS").otherwise("FAIL")
    return both.select("id", "metric", status.alias("status"))
