"""Personal data by weak supervision: labelers vote, EM weighs them, a final classifier decides.

The base kinds are found by pattern and stay.  Candidates for more spans are loose forms: mail
addresses written out, phone numbers without country code, national ids, account numbers, and a
title with a name.  On every base span and candidate of all documents five labelers vote 1, 0 or
abstain (-1): the strict pattern, a gazetteer of titles, domains and prefixes, the words before
the span, the length of its digits, and whether it repeats one digit or ends in a blank form.  All
votes are counted by pattern of votes (a few hundred rows at most); on those counts
expectation-maximisation estimates each labeler's reliability and the probability of every vote
pattern.  With these as soft labels, a naive-Bayes span classifier is trained on features of the
span itself (kind, length, digits, separators, capitals), again from counts over all documents;
candidates with a probability of at least ``THRESHOLD`` become spans of kind ``other``.

Everything is DataFrame and SQL functions; only the two count tables, whose sizes are bounded by
the numbers of votes and feature values, reach the driver.  Null counts as empty; texts are
scanned whole; repeated rows count each; with no candidate at all nothing is added; extra columns
are ignored.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written
from graphloom.llm import spans as S

KINDS = ["email", "ip", "card", "phone"]
THRESHOLD = 0.5
#: A match starts at the head of its run of characters or where the last one ended (\\G), since an earlier start in the run
#: would do as well; loops that need not step back never do (++).  So a run is read once, whatever its length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A maximal run of digits with single separators; runs of other than 16 to 19 digits fail anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Loose forms, and the words that two labelers look for.
LOOSE = {
    "spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?[\[(]?(?:at|@)[\])]? ?[A-Za-z0-9-]{1,63} ?[\[(]?(?:dot|\.)[\])]? ?(?:com|net|org|edu|de|fr|es)\b",
    "number": r"(?<![0-9+.-])(?<![0-9][ .-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![ .-]?[0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?",
}
CUES = r"(?i)(?:mail|phone|tel|call|fax|mobile|contact|address|adresse|card|visa|ssn|iban|account|konto|name|dear|ip|host|server)[^A-Za-z]{0,12}$"
GAZETTEER = r"(?i)^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\b|(?:com|net|org|edu)$|^\+1|^(?:10|192\.168|127)\.|^(?:DE|FR|ES|GB|IT|NL)[0-9]{2}"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the check sum."""
    d = F.reverse(_digits(x))
    places = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)))

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The base spans of all kinds, kind by kind."""
    email = S.found(text, EMAIL, "email", text.contains("@"))
    ip = F.filter(S.found(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]")), lambda s: F.forall(F.split(s["text"], r"\."), lambda p: p.cast("double") <= 255))
    card = F.filter(S.found(text, CARD, "card", text.rlike("[0-9](?:[ -]?[0-9]){15}")), lambda s: luhn(s["text"]))
    count = lambda s: F.length(_digits(s["text"]))
    phone = F.filter(S.found(text, PHONE, "phone", text.contains("+")), lambda s: (count(s) >= 8) & (count(s) <= 15))
    return F.concat(email, ip, card, phone)


def _needed(kind: str, text: Column) -> Column:
    if kind == "spelled":
        return (text.contains("@") | text.contains(" at ") | text.contains("(at)") | text.contains("[at]")) & text.rlike(LOOSE[kind])
    return text.rlike({"number": "[0-9]{3}", "national": "[0-9]{3}-[0-9]{2}-", "account": "[A-Z]{2}[0-9]{2}", "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\b"}[kind])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base, loose: arrays of (kind, start, end, text, before); loose ones overlap no base span."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    loose = F.concat(*[S.found(F.col("text"), p, k, _needed(k, F.col("text"))) for k, p in LOOSE.items()])
    # Both are columns before they are compared, so that no pattern is matched again.
    return text.select("doc_id", "base", loose.alias("loose")).withColumn("loose", S.free(F.col("loose"), F.col("base")))


def votes(s: Column) -> list[Column]:
    """Each labeler's vote on a span: 1, 0, or -1 where it has no opinion."""
    n = F.length(_digits(s["text"]))
    strict = F.when(s["kind"].isin(*KINDS), 1).when(s["kind"].isin("national", "account", "spelled"), -1).otherwise(0)
    gazetteer = F.when(s["text"].rlike(GAZETTEER), 1).otherwise(-1)
    context = F.when(s["before"].rlike(CUES), 1).when(s["before"].rlike("[0-9=#/]\\s*$"), 0).otherwise(-1)
    length = F.when(s["kind"].isin("email", "ip", "spelled", "name"), -1).when((n >= 8) & (n <= 19), 1).otherwise(0)
    blank = F.when(_digits(s["text"]).rlike("^([0-9])\\1{5,}$"), 0).otherwise(-1)
    return [strict, gazetteer, context, length, blank]


def features(s: Column) -> list[Column]:
    """Features of the span itself, each with few values."""
    bucket = lambda x: F.least(x, F.lit(24)) / 4
    return [
        F.when(s["kind"].isin(*KINDS), "base").otherwise(s["kind"]),
        bucket(F.length(s["text"])).cast("int").cast("string"),
        bucket(F.length(_digits(s["text"]))).cast("int").cast("string"),
        F.least(F.length(F.regexp_replace(s["text"], "[A-Za-z0-9]", "")), F.lit(6)).cast("string"),
        F.least(F.length(F.regexp_replace(s["text"], "[^A-Z]", "")), F.lit(4)).cast("string"),
    ]


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]], float]:
    """EM over counted vote patterns: each pattern's probability, each labeler's (rate of 1 given 1, given 0), the prior."""
    total = sum(counts.values())
    if not total:
        return {}, [], 0.5
    m = len(next(iter(counts)))
    rates, prior = [(0.8, 0.3)] * m, 0.5
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v in counts:
            a, b = math.log(prior), math.log(1 - prior)
            for (p, q), x in zip(rates, v, strict=True):
                if x >= 0:
                    a += math.log(p if x else 1 - p)
                    b += math.log(q if x else 1 - q)
            post[v] = 1 / (1 + math.exp(min(700.0, b - a)))
        rates = []
        for k in range(m):
            heard = [(v, n) for v, n in counts.items() if v[k] >= 0]
            yes, no = sum(n * post[v] for v, n in heard), sum(n * (1 - post[v]) for v, n in heard)
            p = (sum(n * post[v] for v, n in heard if v[k]) + 4) / (yes + 5)  # a labeler is held to be better than chance
            q = (sum(n * (1 - post[v]) for v, n in heard if v[k]) + 1) / (no + 5)
            rates.append((p, min(q, p)))
        prior = min(0.99, max(0.01, sum(n * post[v] for v, n in counts.items()) / total))
    return post, rates, prior


def train(found: DataFrame) -> tuple[float, list[dict[str, float]]]:
    """The span classifier: bias, and for each feature the weight of each value."""
    every = found.select(F.explode(F.concat("base", "loose")).alias("s"))
    table = every.select(F.array(*[v.cast("int") for v in votes(F.col("s"))]).alias("v"), F.array(*features(F.col("s"))).alias("f")).groupBy("v", "f").count()
    # Rows are bounded by vote patterns times feature values, whatever the number of documents.
    rows = [(tuple(r["v"]), tuple(r["f"]), float(r["count"])) for r in table.collect()]
    counts: dict[tuple[int, ...], float] = {}
    for v, _, n in rows:
        counts[v] = counts.get(v, 0.0) + n
    post, _, _ = reliabilities(counts)
    if not rows:
        return -1.0, []
    yes, no = sum(n * post[v] for v, _, n in rows), sum(n * (1 - post[v]) for v, _, n in rows)
    weights: list[dict[str, float]] = []
    for k in range(len(rows[0][1])):
        values = {f[k] for _, f, _ in rows}
        of = {x: (sum(n * post[v] for v, f, n in rows if f[k] == x) + 1, sum(n * (1 - post[v]) for v, f, n in rows if f[k] == x) + 1) for x in values}
        weights.append({x: math.log(a / (yes + len(values))) - math.log(b / (no + len(values))) for x, (a, b) in of.items()})
    return math.log((yes + 1) / (no + 1)), weights


def probability(s: Column, model: tuple[float, list[dict[str, float]]]) -> Column:
    bias, weights = model
    score = F.lit(float(bias))
    for value, table in zip(features(s), weights, strict=False):
        known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(w)) for k, w in sorted(table.items())))
        score = score + F.coalesce(F.element_at(known, value), F.lit(0.0))
    return 1 / (1 + F.exp(-score))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end, text, before)."""
    found = written(candidates(docs), shared_dir(docs.sparkSession))  # texts are matched once; spans alone go on
    model = train(found)
    likely = F.filter("loose", lambda s: probability(s, model) >= threshold)
    kept = S.first_of_each(likely)
    return found.select("doc_id", "base", F.transform(kept, lambda s: s.withField("kind", F.concat(F.lit("other_"), s["kind"]))).alias("added"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: counts by kind, the base digest, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(S.written(S.ordered(F.col("base"), KINDS, True)), 256).alias("base_sha256"),
        S.written(S.ordered(F.concat("base", "added"), [*KINDS, *[f"other_{k}" for k in LOOSE]], True)).alias("spans"),
    )
