"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The base kinds are found by pattern.  The method adds spans of kind ``markov``: runs of at least
``RUN`` letters, digits and ``+/_=-`` that no base span overlaps and whose log-likelihood ratio
under two first-order character models is above ``THRESHOLD``.  The models are trained from
labelled samples: the secrets that the base patterns find are random strings, the other words of
the sampled texts are ordinary identifiers.  The sample is bounded: of each label the rows with the smallest
hash of the id, at most ``SAMPLE_ROWS``.  Only the table of transition counts (at most
70 x 70 numbers) reaches the driver; it returns as one literal.

Everything is DataFrame and SQL functions.  Null counts as empty and has no span; texts are
scanned whole; repeated rows are scanned each; an empty table gives an empty result (and models
of equal, uniform transitions); extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import spans as S

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex"]
SAMPLE_ROWS = 2000
RUN = 20
THRESHOLD = 6.0
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=.-"


def base_spans(text: Column) -> Column:
    """The base spans of all kinds, kind by kind."""
    marked = (text.contains(":") | text.contains("=")) & text.rlike("(?i)password|passwd|secret|token|api_?key")
    assign = F.filter(S.found(text, ASSIGN, "assign", marked), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 8)
    access = F.filter(S.found(text, "AKIA[A-Z0-9]+", "access", text.contains("AKIA")), lambda s: s["end"] - s["start"] >= 16)
    # A maximal run of 32 or more is what is left of all runs once the shorter ones are dropped.
    digits = S.found(text, "[0-9a-f]{32,}", "hex", text.rlike("[0-9a-f]{32}"))
    return F.concat(assign, access, digits)


def _place(char: Column) -> Column:
    return F.instr(F.lit(ALPHABET), char)


def _chars(string: Column) -> Column:
    return F.regexp_extract_all(string, F.lit("(?s)."), F.lit(0))


def _transitions(strings: DataFrame) -> DataFrame:
    """(label, string) to counts of character pairs (label, a, b, n); a string's start counts as symbol 0."""
    chars = strings.select("label", _chars(F.col("string")).alias("c"))
    pair = lambda c, i: F.struct(F.when(i > 0, F.get("c", i - 1)).alias("a"), c.alias("b"))
    pairs = chars.select("label", F.explode(F.transform("c", pair)).alias("p"))
    placed = pairs.select("label", F.coalesce(F.instr(F.lit(ALPHABET), F.col("p.a")), F.lit(0)).alias("a"), F.instr(F.lit(ALPHABET), F.col("p.b")).alias("b"))
    return placed.groupBy("label", "a", "b").agg(F.count("*").alias("n"))


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, string): 1 for secrets in base spans, 0 for other words of four or more characters."""
    text = F.col("text")
    has_secret, has_text = F.size(base_spans(text)) > 0, F.length(text) > 0
    n = docs.agg(F.count_if(has_secret), F.count_if(has_text)).first()

    def first(has: Column, n: int) -> DataFrame:
        """The bounded sample; about twice as many rows are sorted, whatever the size of the table."""
        place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
        return docs.where((place < int(min(1.0, 2 * rows / max(1, n)) * (1 << 30))) & has).orderBy(place, "doc_id").limit(rows)

    secret = first(has_secret, n[0]).select(F.explode(base_spans(text)).alias("s"))
    value = F.when(F.col("s.kind") == "assign", F.regexp_extract("s.text", ASSIGN, 2)).otherwise(F.col("s.text"))
    random = secret.select(F.lit(1).alias("label"), value.alias("string"))
    plain = first(has_text, n[1]).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{4,}"), 0)).alias("string"))
    # A secret's string is no ordinary identifier, even where the pattern's context is missing.
    plain = plain.where(~F.col("string").rlike("^[0-9a-f]{32,}$|^AKIA[A-Z0-9]{12,}$")).join(random.select("string").distinct(), "string", "left_anti")
    return random.unionByName(plain.select(F.lit(0).alias("label"), "string"))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratios of all transitions, row by row of the preceding symbol (0: start)."""
    n = len(ALPHABET)
    counts = [[[0.5] * (n + 1) for _ in range(n + 1)] for _ in range(2)]
    for r in _transitions(labelled_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows)).collect():  # at most 2 * 69 * 69 rows
        counts[r["label"]][r["a"]][r["b"]] += r["n"]
    out = []
    for a in range(n + 1):
        random, plain = (sum(counts[k][a][1:]) for k in (1, 0))
        out += [0.0] + [math.log(counts[1][a][b] / random) - math.log(counts[0][a][b] / plain) for b in range(1, n + 1)]
    return out


def ratio(string: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of random string over ordinary identifier."""
    n = len(ALPHABET) + 1
    scores = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum"))

    def step(s: Column, char: Column) -> Column:
        b = _place(char)
        return F.struct(b.alias("a"), (s["sum"] + F.element_at(scores, s["a"] * n + b + 1)).alias("sum"))

    return F.aggregate(_chars(string), start, step, lambda s: s["sum"])


def scan(docs: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end, text)."""
    table = train(docs, rows)
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pattern = f"[A-Za-z0-9+/_=-]{{{RUN},}}"
    runs = S.found(F.col("text"), pattern, "markov", F.col("text").rlike(pattern))
    both = text.select("doc_id", base_spans(F.col("text")).alias("base"), runs.alias("runs"))
    return both.select("doc_id", "base", F.filter(S.free(F.col("runs"), F.col("base")), lambda s: ratio(s["text"], table) > threshold).alias("added"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: counts by kind, the base digest, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(S.written(S.ordered(F.col("base"), KINDS, False)), 256).alias("base_sha256"),
        S.written(S.ordered(F.concat("base", "added"), [*KINDS, "markov"], False)).alias("spans"),
    )
