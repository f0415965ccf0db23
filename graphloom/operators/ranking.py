"""Ranking of scholarly papers: citation graph, six signals, sensitivity, calibration, ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import STOP_WORDS, evidence_spans, tokenize

SIGNALS = ["topical", "impact", "prestige", "velocity", "methodology", "reproducibility"]
# Weights of the signals by profile.
PROFILES = {
    "balanced": (0.3, 0.2, 0.2, 0.1, 0.1, 0.1),
    "influence_heavy": (0.2, 0.3, 0.3, 0.1, 0.05, 0.05),
    "method_repro_heavy": (0.2, 0.1, 0.1, 0.1, 0.25, 0.25),
    "frontier_heavy": (0.25, 0.1, 0.1, 0.3, 0.15, 0.1),
    "topic_heavy": (0.45, 0.15, 0.1, 0.1, 0.1, 0.1),
}
# Words that screen a paper's text.
METHOD_MARKERS = "ablation analysis baseline benchmark compare comparison dataset empirical evaluation experiment metric result validation".split()
UNCERTAINTY_MARKERS = ["confidence interval", "error bar", "limitation", "limitations", "significance", "statistical", "variance"]
REPRODUCIBILITY_MARKERS = ["artifact", "checkpoint", "code", "dataset", "github", "open source", "reproduce", "reproducibility", "repository"]


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up towards +infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def normalized_works(works: DataFrame) -> DataFrame:
    """L1: works (id, title, percentile, citations, labels: array of (name, score), open flags, rank): id and title required, labels of
    0.2 or without score, percentile within [0, 1], citations not negative, open if any flag says so."""
    have = works.where("id is not null and trim(coalesce(title, '')) <> ''")
    return have.withColumns(
        {
            "labels": F.array_distinct(F.transform(F.filter("labels", lambda x: (F.coalesce(x["score"], F.lit(1.0)) >= 0.2) & (F.trim(F.coalesce(x["name"], F.lit(""))) != "")), lambda x: F.trim(x["name"]))),
            "percentile": F.when(F.col("percentile").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "percentile"))),
            "citations": F.greatest(F.coalesce("citations", F.lit(0)), F.lit(0)),
            "open_access": F.exists("open", lambda x: x) if "open" in works.columns else F.col("open_access"),
        }
    )


def citation_edges(papers: DataFrame, references: DataFrame) -> DataFrame:
    """L2: references (source, target) whose ends are both in the set; repeated ones stay."""
    ids = papers.select("paper_id").distinct()
    return references.join(ids.withColumnRenamed("paper_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("paper_id", "target"), "target", "left_semi")


def neighbourhood(seeds: DataFrame, references: DataFrame, n: int = 10, most: int = 100) -> DataFrame:
    """L3: (paper_id, origin, expanded_from): seeds, then up to ``n`` references a seed (``most`` in all) and up to ``most`` citing works a seed."""
    ids = seeds.select("paper_id")
    outgoing = references.join(ids.withColumnRenamed("paper_id", "source"), "source").where("source <> target").join(ids.select(F.col("paper_id").alias("target")), "target", "left_anti")
    w = Window.partitionBy("source").orderBy("target")
    outgoing = outgoing.distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).groupBy(F.col("target").alias("paper_id")).agg(F.min("source").alias("expanded_from")).orderBy("paper_id").limit(most)
    incoming = references.join(ids.withColumnRenamed("paper_id", "target"), "target").join(ids.select(F.col("paper_id").alias("source")), "source", "left_anti")
    v = Window.partitionBy("target").orderBy("source")
    incoming = incoming.distinct().withColumn("_k", F.row_number().over(v)).where(F.col("_k") <= most).groupBy(F.col("source").alias("paper_id")).agg(F.min("target").alias("expanded_from"))
    rows = ids.select("paper_id", F.lit("seed").alias("origin"), F.lit(None).cast(seeds.schema["paper_id"].dataType).alias("expanded_from"))
    rows = rows.unionByName(outgoing.select("paper_id", F.lit("outgoing_reference").alias("origin"), "expanded_from")).unionByName(incoming.select("paper_id", F.lit("incoming_citation").alias("origin"), "expanded_from"))
    first = Window.partitionBy("paper_id").orderBy(F.when(F.col("origin") == "seed", 0).when(F.col("origin") == "outgoing_reference", 1).otherwise(2))
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def citation_degrees(edges: DataFrame) -> DataFrame:
    """L4: paper_id, cited (in), cites (out)."""
    ends = edges.select(F.col("target").alias("paper_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("source").alias("paper_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("paper_id").agg(F.sum("i").alias("cited"), F.sum("o").alias("cites"))


def topical(papers: DataFrame, topic: str) -> DataFrame:
    """paper_id, topical: 0.65 share of the topic's words found, 0.25 rank prior, 0.1 share of words in the title."""
    import re

    wanted = sorted({w for w in re.findall("[a-z0-9]+", topic.lower()) if len(w) > 2 and w not in STOP_WORDS})
    words = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
    total = papers.agg(F.count("*").alias("_n"))
    found = F.size(F.array_intersect(words, tokenize(F.concat_ws(" ", "title", "abstract")))) / max(1, len(wanted))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower("title"), w))) / max(1, len(wanted))
    prior = F.when(F.col("_n") > 1, 1 - (F.col("source_rank") - 1) / (F.col("_n") - 1)).otherwise(1.0)
    return papers.join(F.broadcast(total)).select("paper_id", ((0.65 * found + 0.25 * prior + 0.1 * hits) * 100).alias("topical"))  # one row


def impact(papers: DataFrame) -> DataFrame:
    """paper_id, impact: the percentile, else the logarithm of citations over the largest."""
    top = papers.agg(F.greatest(F.lit(1.0), F.max(F.log1p("citations"))).alias("_m"))
    return papers.join(F.broadcast(top)).select("paper_id", F.coalesce(F.col("percentile") * 100, F.log1p("citations") / F.col("_m") * 100).alias("impact"))


def prestige(ranks: DataFrame, usable: bool = True) -> DataFrame:
    """paper_id, prestige: PageRank (paper_id, pagerank) scaled between 0 and the maximum; null without edges."""
    bounds = ranks.agg(F.least(F.lit(0.0), F.min("pagerank")).alias("_lo"), F.greatest(F.lit(0.0), F.max("pagerank")).alias("_hi"))
    span = F.when(F.col("_hi") - F.col("_lo") == 0, 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    value = (F.col("pagerank") - F.col("_lo")) / span * 100
    return ranks.join(F.broadcast(bounds)).select("paper_id", (value if usable else F.lit(None).cast("double")).alias("prestige"))


def velocity(papers: DataFrame, as_of: int) -> DataFrame:
    """paper_id, velocity: citations a year since publication, as logarithm over the largest; null without a year."""
    speed = F.when(F.col("year").isNotNull(), F.col("citations") / F.greatest(F.lit(1), as_of - F.col("year") + 1))
    rows = papers.select("paper_id", speed.alias("_v"))
    top = rows.agg(F.greatest(F.lit(1.0), F.max(F.log1p(F.coalesce("_v", F.lit(0.0))))).alias("_m"))
    return rows.join(F.broadcast(top)).select("paper_id", (F.log1p("_v") / F.col("_m") * 100).alias("velocity"))


# Rubric items with the sections they look at.
RUBRIC = {
    "limitations": ("limitations discussion conclusion", UNCERTAINTY_MARKERS),
    "reproducibility-path": ("reproducibility methodology experiments", [*REPRODUCIBILITY_MARKERS, "command", "environment", "instructions"]),
    "experimental-details": ("methodology experiments", "ablation baseline dataset evaluation experiment hyperparameter metric training".split()),
    "statistical-significance": ("results experiments", UNCERTAINTY_MARKERS),
    "compute-resources": ("methodology experiments", "accelerator cluster compute cpu gpu hours memory tpu".split()),
}


def rubric(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, item, answer): two or more distinct markers among a section's first four hits present, one partial, none missing, no such section not_evaluated."""
    parts = []
    for item, (names, markers) in RUBRIC.items():
        own = sections.where(F.col("section").isin(*names.split()))
        have = own.groupBy("paper_id").agg(F.count("*").alias("_s"))
        hits = evidence_spans(own, markers, "paper_id", "body", most=4).groupBy("paper_id").agg(F.count_distinct("marker").alias("_h"))
        answer = F.when(F.col("_s").isNull(), "not_evaluated").when(F.col("_h") >= 2, "present").when(F.col("_h") == 1, "partial").otherwise("missing")
        parts.append(papers.select("paper_id").join(have, "paper_id", "left").join(hits, "paper_id", "left").select("paper_id", F.lit(item).alias("item"), answer.alias("answer")))
    return reduce(DataFrame.unionByName, parts)


def rubric_value(answers: DataFrame, items: list[str], most: float) -> DataFrame:
    """paper_id, value: the mean of the evaluated answers (1, 0.5, 0) times ``most``."""
    weight = F.when(F.col("answer") == "present", 1.0).when(F.col("answer") == "partial", 0.5).when(F.col("answer") == "missing", 0.0)
    return answers.where(F.col("item").isin(*items)).groupBy("paper_id").agg((F.coalesce(F.avg(weight), F.lit(0.0)) * most).alias("value"))


def marker_counts(papers: DataFrame, markers: list[str]) -> DataFrame:
    """paper_id, hits: distinct markers in title and abstract."""
    text = papers.select("paper_id", F.concat_ws("\n", "title", "abstract").alias("text"))
    return evidence_spans(text, markers, "paper_id", "text", most=100).groupBy("paper_id").agg(F.count_distinct("marker").alias("hits"))


def methodology(papers: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """paper_id, methodology: 7 a method marker, 6 an uncertainty marker, 14 for an abstract over 80 characters, 10 for full text, rubric up to 32; at most 100; null without text."""
    out = papers.join(marker_counts(papers, METHOD_MARKERS).withColumnRenamed("hits", "_a"), "paper_id", "left").join(marker_counts(papers, UNCERTAINTY_MARKERS).withColumnRenamed("hits", "_b"), "paper_id", "left")
    if answers is not None:
        out = out.join(rubric_value(answers, ["experimental-details", "statistical-significance", "limitations", "compute-resources"], 32), "paper_id", "left")
    else:
        out = out.withColumn("value", F.lit(0.0))
    long = F.coalesce(F.length("abstract") > 80, F.lit(False))
    full = F.col("full_text").isNotNull() if "full_text" in papers.columns else F.lit(False)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = zero("_a") * 7 + zero("_b") * 6 + F.when(long, 14).otherwise(0) + F.when(full, 10).otherwise(0) + zero("value")
    return out.select("paper_id", F.when(long | full, F.least(F.lit(100.0), total.cast("double"))).alias("methodology"))


def reproducibility(papers: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """paper_id, reproducibility: 30 if open, 30 for code, 7 a marker up to 25, rubric up to 20; at most 100."""
    text = papers.select("paper_id", F.concat_ws("\n", "title", "abstract").alias("text"))
    spans = evidence_spans(text, REPRODUCIBILITY_MARKERS, "paper_id", "text", most=100)
    found = spans.groupBy("paper_id").agg(F.count_distinct("marker").alias("_h"), F.bool_or(F.col("marker").isin("github", "code", "repository", "open source")).alias("_c"))
    out = papers.join(found, "paper_id", "left")
    out = out.join(rubric_value(answers, ["reproducibility-path"], 20), "paper_id", "left") if answers is not None else out.withColumn("value", F.lit(0.0))
    total = F.when(F.col("open_access"), 30).otherwise(0) + F.when(F.col("_c"), 30).otherwise(0) + F.least(F.coalesce("_h", F.lit(0)) * 7, F.lit(25)) + F.coalesce("value", F.lit(0.0))
    return out.select("paper_id", F.least(F.lit(100.0), total.cast("double")).alias("reproducibility"))


def signals(papers: DataFrame, ranks: DataFrame, topic: str, as_of: int, usable: bool = True, answers: DataFrame | None = None) -> DataFrame:
    """paper_id, title, retracted and the six signals; a null signal is not available."""
    out = papers.select("paper_id", "title", F.coalesce("retracted", F.lit(False)).alias("retracted"))
    for part in (topical(papers, topic), impact(papers), prestige(ranks, usable), velocity(papers, as_of), methodology(papers, answers), reproducibility(papers, answers)):
        out = out.join(part, "paper_id", "left")
    return out


def combined(scored: DataFrame, weights: tuple[float, ...] = PROFILES["balanced"]) -> DataFrame:
    """Adds score: weights over the available signals, rounded; a retracted paper has at most 20."""
    top = reduce(lambda a, b: a + b, [F.coalesce(F.col(s) * w, F.lit(0.0)) for s, w in zip(SIGNALS, weights, strict=True)])
    have = reduce(lambda a, b: a + b, [F.when(F.col(s).isNotNull(), w).otherwise(0.0) for s, w in zip(SIGNALS, weights, strict=True)])
    raw = F.when(have > 0, top / have).otherwise(0.0)
    return scored.withColumn("score", rounded(F.when(F.col("retracted"), F.least(raw, F.lit(20.0))).otherwise(raw)))


def ranked(scored: DataFrame) -> DataFrame:
    """Adds rank: by score, title, id.  Distinct scores are counted first, so only papers of one score are sorted together."""
    counts = scored.groupBy("score").agg(F.count("*").alias("_n"))  # scores have two digits: at most 10,001 rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("score").orderBy("title", "paper_id"))
    return scored.withColumn("_l", local).join(F.broadcast(before), "score").withColumn("rank", F.col("_before") + F.col("_l")).drop("_l", "_before")


def profile_ranks(scored: DataFrame) -> DataFrame:
    """(profile, paper_id, score, rank) under every profile."""
    parts = [ranked(combined(scored, w)).select(F.lit(p).alias("profile"), "paper_id", "score", "rank") for p, w in PROFILES.items()]
    return reduce(DataFrame.unionByName, parts)


def sensitivity(ranks: DataFrame) -> DataFrame:
    """paper_id, best and worst rank and their profiles, range, and stable (0), sensitive (up to 2) or volatile."""
    spread = F.max("rank") - F.min("rank")
    return ranks.groupBy("paper_id").agg(
        F.min("rank").alias("best"), F.max("rank").alias("worst"), F.min_by("profile", F.struct("rank", "profile")).alias("best_profile"), F.max_by("profile", F.struct("rank", "profile")).alias("worst_profile"),
        spread.alias("range"), F.when(spread == 0, "stable").when(spread <= 2, "sensitive").otherwise("volatile").alias("stability"),
    )


def preference_pairs(explicit: DataFrame, ranked_ids: DataFrame, longest: int = 40, most: int | None = 500) -> DataFrame:
    """(preferred, over): explicit pairs and all ordered pairs of a ranked list (source, position, paper_id) of at most ``longest``, each once, at most ``most`` (None: all)."""
    short = ranked_ids.where(F.col("position") < longest)
    a, b = short.alias("a"), short.alias("b")
    listed = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.position") < F.col("b.position"))).select(F.col("a.paper_id").alias("preferred"), F.col("b.paper_id").alias("over"), F.lit(1).alias("_k"), F.col("a.position").alias("_p"), F.col("b.position").alias("_q"))
    rows = explicit.select("preferred", "over", F.lit(0).alias("_k"), F.lit(0).alias("_p"), F.lit(0).alias("_q")).unionByName(listed).where("preferred <> over")
    w = Window.partitionBy("preferred", "over").orderBy("_k", "_p", "_q")
    once = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    if most is not None:
        once = once.orderBy("_k", "_p", "_q", "preferred", "over").limit(most)
    return once.select("preferred", "over")


def agreement(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per profile: satisfied, violated, tied, rate, and place by (rate, satisfied, name)."""
    own = ranks.select("profile", "paper_id", "rank")
    both = pairs.join(own.select("profile", F.col("paper_id").alias("preferred"), F.col("rank").alias("rp")), "preferred").join(own.select("profile", F.col("paper_id").alias("over"), F.col("rank").alias("ro")), ["profile", "over"])
    out = both.groupBy("profile").agg(F.count_if(F.col("rp") < F.col("ro")).alias("satisfied"), F.count_if(F.col("rp") > F.col("ro")).alias("violated"), F.count_if(F.col("rp") == F.col("ro")).alias("tied"))
    out = out.withColumn("rate", F.round(F.col("satisfied") / (F.col("satisfied") + F.col("violated") + F.col("tied")), 4))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), F.desc("satisfied"), "profile")))  # five rows


def ledger(ranked_papers: DataFrame, notes: DataFrame, top: int = 25) -> DataFrame:
    """(rank, paper_id, status) of the first ``top`` papers; the first note (paper_id, pos, status) of each, else not_checked."""
    w = Window.partitionBy("paper_id").orderBy("pos")
    first = notes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("paper_id", "status")
    return ranked_papers.where(F.col("rank") <= top).select("rank", "paper_id").join(first, "paper_id", "left").select("rank", "paper_id", F.coalesce("status", F.lit("not_checked")).alias("status"))


def field_clusters(scored: DataFrame, labels: DataFrame, top: int = 12) -> DataFrame:
    """Per label: papers, mean score, citations, years; the ``top`` labels by papers, then mean score.  labels: (paper_id, label)."""
    both = labels.distinct().join(scored, "paper_id")
    out = both.groupBy("label").agg(F.count("*").alias("papers"), F.round(F.avg("score"), 4).alias("mean_score"), F.sum("citations").alias("citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return out.orderBy(F.desc("papers"), F.desc("mean_score"), "label").limit(top)


def roles(scored: DataFrame, degrees: DataFrame, as_of: int) -> DataFrame:
    """(paper_id, roles): foundation, frontier, bridge, method anchor, reproducibility anchor, else lead."""
    own = scored.join(degrees, "paper_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    marks = F.array_compact(
        F.array(
            F.when((zero("impact") >= 70) | (zero("prestige") >= 70), "foundation"), F.when((F.col("year") >= as_of - 2) | (zero("velocity") >= 70), "frontier"),
            F.when((zero("cited") > 0) & (zero("cites") > 0), "bridge"), F.when(zero("methodology") >= 60, "method_anchor"), F.when(zero("reproducibility") >= 60, "reproducibility_anchor"),
        )
    )
    return own.select("paper_id", F.when(F.size(marks) > 0, marks).otherwise(F.array(F.lit("lead"))).alias("roles"))


def critiques(ranked_papers: DataFrame, top: int = 10) -> DataFrame:
    """(rank, paper_id, strengths, concerns, verdict) of the first ``top``: signals of 70 or more are strengths, of under 40 or missing concerns."""
    strong = F.array_compact(F.array(*[F.when(F.col(s) >= 70, F.lit(s)) for s in SIGNALS]))
    weak = F.array_compact(F.array(F.when(F.col("retracted"), F.lit("retracted")), *[F.when(F.coalesce(F.col(s), F.lit(0.0)) < 40, F.lit(s)) for s in SIGNALS]))
    verdict = F.when(F.col("retracted"), "avoid").when((F.size(strong) >= 3) & (F.size(weak) <= 1), "read_first").when(F.size(weak) >= 4, "weak_evidence").otherwise("read_with_care")
    return ranked_papers.where(F.col("rank") <= top).select("rank", "paper_id", F.array_join(strong, ",").alias("strengths"), F.array_join(weak, ",").alias("concerns"), verdict.alias("verdict"))


def next_actions(ranked_papers: DataFrame, stability: DataFrame, outcomes: DataFrame, most: int = 8) -> DataFrame:
    """(place, priority, action, paper_id): rules over rank, sensitivity and ledger, by priority, action and rank; the first ``most``."""
    own = ranked_papers.select("paper_id", "rank")
    parts = [
        own.where("rank <= 3").select(F.lit(1).alias("priority"), F.lit("read_paper").alias("action"), "paper_id", "rank"),
        own.join(outcomes.where("status = 'failed'").select("paper_id"), "paper_id").select(F.lit(2).alias("priority"), F.lit("resolve_failure").alias("action"), "paper_id", "rank"),
        own.join(outcomes.where("status = 'not_checked' and rank <= 5").select("paper_id"), "paper_id").select(F.lit(3).alias("priority"), F.lit("reproduce").alias("action"), "paper_id", "rank"),
        own.where("rank <= 20").join(stability.where("stability = 'volatile'").select("paper_id"), "paper_id").select(F.lit(4).alias("priority"), F.lit("check_weights").alias("action"), "paper_id", "rank"),
    ]
    top = reduce(DataFrame.unionByName, parts).orderBy("priority", "action", "rank", "paper_id").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("priority", "action", "rank", "paper_id"))).select("place", "priority", "action", "paper_id")


def extreme_signals(scored: DataFrame, n: int = 2, weakest: bool = False) -> DataFrame:
    """(paper_id, signals): the n strongest or weakest available signals, in order."""
    pairs = F.filter(F.array(*[F.struct((F.col(s) * (1 if weakest else -1)).alias("v"), F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(SIGNALS)]), lambda x: x["v"].isNotNull())
    return scored.select("paper_id", F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: x["s"]), ",").alias("signals"))


def worksheet_pairs(ranked_papers: DataFrame, stability: DataFrame, top: int = 20, most: int = 12) -> DataFrame:
    """(a, b, reason): neighbours in rank with close scores, and volatile papers with the first; each unordered pair once, at most ``most``."""
    best = ranked_papers.where(F.col("rank") <= top)  # the first twenty
    w = Window.orderBy("rank")
    near = best.withColumn("b", F.lead("paper_id").over(w)).withColumn("gap", F.col("score") - F.lead("score").over(w)).where("b is not null and gap <= 5").select(F.col("paper_id").alias("a"), "b", F.lit(0).alias("_k"), "rank", F.lit("close_scores").alias("reason"))
    first = best.where("rank = 1").select(F.col("paper_id").alias("a"))
    loose = best.join(stability.where("stability = 'volatile'").select("paper_id"), "paper_id").where("rank > 1").join(first).select("a", F.col("paper_id").alias("b"), F.lit(1).alias("_k"), "rank", F.lit("volatile").alias("reason"))
    rows = near.unionByName(loose)
    v = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("_k", "rank")
    return rows.withColumn("_rn", F.row_number().over(v)).where("_rn = 1").orderBy("_k", "rank").limit(most).select("a", "b", "reason")


def acceptance(critique: DataFrame) -> DataFrame:
    """(paper_id, criteria): what a reproduction of each paper has to show, from its concerns."""
    base = F.array(F.lit("main result within stated tolerance"), F.lit("commands and environment recorded"))
    more = F.transform(F.filter(F.split("concerns", ","), lambda c: c != ""), lambda c: F.concat(F.lit("address "), c))
    return critique.select("paper_id", F.array_join(F.slice(F.array_distinct(F.concat(base, more)), 1, 10), "; ").alias("criteria"))


def cross_checks(ranked_papers: DataFrame, stability: DataFrame, n: int = 3) -> DataFrame:
    """(check, paper_id, value): the gap between the first two scores, and the n papers of the widest range of ranks."""
    two = ranked_papers.where("rank <= 2").agg(F.min_by("paper_id", "rank").alias("paper_id"), (F.max("score") - F.min("score")).alias("value"))
    wide = stability.orderBy(F.desc("range"), "paper_id").limit(n).select(F.lit("unstable").alias("check"), "paper_id", F.col("range").cast("double").alias("value"))
    return two.select(F.lit("top_gap").alias("check"), "paper_id", F.round("value", 4).alias("value")).unionByName(wide)


def explorer(ranked_papers: DataFrame, degrees: DataFrame, role_table: DataFrame) -> DataFrame:
    """(paper_id, title, score, rank, cited, cites, role) of all papers."""
    out = ranked_papers.join(degrees, "paper_id", "left").join(role_table, "paper_id", "left")
    return out.select("paper_id", "title", "score", "rank", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("cites", F.lit(0)).alias("cites"), F.element_at("roles", 1).alias("role"))


def with_full_text(ranked_papers: DataFrame, texts: DataFrame, top: int = 10) -> DataFrame:
    """(paper_id, status, chars): full text of the first ``top``: available, missing or error; texts: (paper_id, full_text, error)."""
    out = ranked_papers.where(F.col("rank") <= top).select("paper_id").join(texts, "paper_id", "left")
    status = F.when(F.col("error").isNotNull(), "error").when(F.length(F.trim("full_text")) > 0, "available").otherwise("missing")
    return out.select("paper_id", status.alias("status"), F.coalesce(F.length("full_text"), F.lit(0)).alias("chars"))


def access_plan(routes: DataFrame) -> DataFrame:
    """(paper_id, route, url, status): the best of a paper's routes (paper_id, pos, route, url, open, fetchable): the first fetchable, else open, else any."""
    once = routes.withColumn("_rn", F.row_number().over(Window.partitionBy("paper_id", "url").orderBy("pos"))).where("_rn = 1")
    order = F.when(F.col("fetchable"), 0).when(F.col("open"), 1).otherwise(2)
    best = once.groupBy("paper_id").agg(F.min(F.struct(order.alias("o"), "pos", "route", "url")).alias("b"))
    return best.select("paper_id", "b.route", "b.url", F.when(F.col("b.o") == 0, "ready").when(F.col("b.o") == 1, "open_page").otherwise("restricted").alias("status"))


def resolved(identifiers: DataFrame, keys: DataFrame) -> DataFrame:
    """(identifier, paper_id): papers by identifier; of several keys (kind, key, paper_id) the kind's order decides: work, doi, arxiv, pmid, pmcid."""
    order = F.array(*[F.lit(k) for k in ("work", "doi", "arxiv", "pmid", "pmcid")])
    hits = identifiers.join(keys, F.lower("identifier") == F.lower("key")).withColumn("_o", F.array_position(order, F.col("kind")))
    return hits.groupBy("identifier").agg(F.min_by("paper_id", F.struct("_o", "paper_id")).alias("paper_id"))


def evidence_packet(spans: DataFrame, most: int = 5, longest: int = 260) -> DataFrame:
    """(paper_id, items): at most ``most`` evidence texts of at most ``longest`` characters."""
    w = Window.partitionBy("paper_id").orderBy("start", "marker")
    top = spans.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    return top.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.substring("excerpt", 1, longest).alias("x")))), lambda s: s["x"]).alias("items"))


def manifest_violations(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run_id, rule): required fields, known status, exactly one primary artifact, no raw text."""
    parts = [
        runs.where("coalesce(workflow, '') = '' or coalesce(slug, '') = ''").select("run_id", F.lit("required").alias("rule")),
        runs.where("status not in ('completed', 'failed', 'running')").select("run_id", F.lit("status").alias("rule")),
        runs.join(artifacts.where("primary").groupBy("run_id").agg(F.count("*").alias("n")), "run_id", "left").where("coalesce(n, 0) <> 1").select("run_id", F.lit("one_primary").alias("rule")),
        artifacts.where("raw_text").select("run_id", F.lit("raw_text").alias("rule")).distinct(),
    ]
    return reduce(DataFrame.unionByName, parts)


def run_id(workflow: Column, slug: Column, at: Column) -> Column:
    """A stable id: 16 hex digits of SHA-256 over the parts joined by a zero byte."""
    return F.substring(F.sha2(F.concat_ws("\u0000", workflow, slug, at), 256), 1, 16)


def profiles(spark: SparkSession) -> DataFrame:
    """The weight profiles as a table that a user can replace."""
    return spark.createDataFrame([(p, *w) for p, w in PROFILES.items()], "profile string, " + ", ".join(f"{s} double" for s in SIGNALS))
