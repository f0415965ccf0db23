"""Text columns: slugs, cleaning, tokens, cuts, evidence, identifiers, markdown, budgets."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from graphloom.functions import automaton

# Words that carry no topic.
STOP_WORDS = (
    "a about after all an and are as at based by for from how in into is it its of on or paper papers research study the their this to using via we with"
).split()
# Cyrillic letters and their Latin form, for slugs.
CYRILLIC = "а a б b в v г g д d е e ё yo ж zh з z и i й y к k л l м m н n о o п p р r с s т t у u ф f х h ц ts ч ch ш sh щ sch ъ _ ы y ь _ э e ю yu я ya".split()


def slug(name: Column) -> Column:
    """B1: the stem of a file name, Cyrillic transliterated, lower case, blanks and dots as _."""
    out = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    for a, b in zip(CYRILLIC[::2], CYRILLIC[1::2], strict=True):
        out = F.replace(out, F.lit(a), F.lit("" if b == "_" else b))
    return F.regexp_replace(out, r"[ .]", "_")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composition; the one step of preprocessing that Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def preprocess(text: Column) -> Column:
    """B2: composed Unicode, without script and style elements."""
    return nfc(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", ""))


def tokenize(text: Column) -> Column:
    """Distinct-free list of [a-z0-9]+ of three or more characters that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def words(text: Column) -> Column:
    """The word tokenizer that slicing uses: runs of letters and digits, and single other marks."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), 0)


def slices(docs: DataFrame, most: int, id_col: str = "id") -> DataFrame:
    """B3 (hard cuts): (id, part, token_start, token_end, text): windows of ``most`` tokens, contiguous; the last takes the rest."""
    sized = docs.select(id_col, words(F.col("text")).alias("w")).where("size(w) > 0")
    parts = F.sequence(F.lit(0), F.ceil(F.size("w") / most).cast("int") - 1)
    cut = sized.select(id_col, "w", F.explode(parts).alias("part"))
    start = F.col("part") * most
    return cut.select(id_col, "part", start.alias("token_start"), F.least(start + most, F.size("w")).alias("token_end"), F.array_join(F.slice("w", start + 1, F.lit(most)), " ").alias("text"))


PIECE = r"\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"


def _priority(before: Column, after: Column) -> Column:
    """The kind of the boundary between two pieces: 1 before a heading, then paragraph, sentence, phrase, word, and 6 inside one."""
    gap = after.rlike(r"^\s")
    return (
        F.when(before.isNull(), 9).when(after.rlike(r"^\s*\n\s*#"), 1).when(after.rlike(r"^\s*\n\s*\n"), 2).when(gap & before.rlike(r"[.!?]\z"), 3)
        .when(gap & before.rlike(r"[,;:]\z"), 4).when(gap, 5).otherwise(6)
    )


def soft_slices(docs: DataFrame, most: int, shift: int, id_col: str = "id") -> DataFrame:
    """B3 (soft cuts): (id, part, token_start, token_end, text): contiguous windows of about ``most`` tokens, each cut at the best boundary
    within ``shift`` (< most) tokens of its full length, by 1000 * kind + distance; texts keep their blanks, and the last window takes the rest.

    Kinds are told once a token, and a fold over a text's windows carries the cut before, so the work is linear in the text.
    """
    cut = docs.select(id_col, F.regexp_extract_all(F.col("text"), F.lit(PIECE), 0).alias("w")).where("size(w) > 0")
    # The generator keeps the kinds from being told again in each step of the fold.
    cut = cut.select(id_col, "w", F.explode(F.array(F.transform("w", lambda x, i: _priority(F.get("w", i - 1), x)))).alias("kinds"))
    n = F.size("w")

    def step(s: Column, _: Column) -> Column:
        low = s["at"] + most - shift
        near = F.transform(F.slice("kinds", low + 1, F.lit(2 * shift + 1)), lambda k, i: F.struct((k * 1000 + F.abs(i - shift)).alias("score"), (low + i).alias("at")))
        at = F.when(n - s["at"] <= most, n).otherwise(F.array_min(near)["at"])
        return F.when(s["at"] >= n, s).otherwise(F.struct(at.alias("at"), F.concat(s["cuts"], F.array(at)).alias("cuts")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("cuts"))
    cut = cut.select(id_col, "w", F.aggregate(F.sequence(F.lit(1), F.ceil(n / (most - shift)).cast("int")), start, step, lambda s: s["cuts"]).alias("cuts"))
    parts = cut.select(id_col, "w", "cuts", F.posexplode("cuts").alias("part", "token_end")).withColumn("token_start", F.coalesce(F.get("cuts", F.col("part") - 1), F.lit(0)))
    return parts.select(id_col, "part", "token_start", "token_end", F.array_join(F.slice("w", F.col("token_start") + 1, F.col("token_end") - F.col("token_start")), "").alias("text"))


# Kinds of boundary, their patterns and weights; the smaller weight is better.
BOUNDARIES = {"section": (r"\n#{1,6} [^\n]*\n", 1), "paragraph": (r"\n\s*\n", 2), "sentence": (r"[.!?]\s+", 3), "phrase": (r"[,;:]\s+", 4), "word": (r"\s+", 5)}


def _ends(pieces: Column, hits: Column) -> Column:
    """The ends of matches, from the pieces between them and the matches."""
    upto = lambda a, n: F.length(F.array_join(F.slice(a, F.lit(1), n), ""))
    return F.transform(hits, lambda _, i: upto(pieces, i + 1) + upto(hits, i + 1))


def _scored(low: Column, target: Column, weight: int):
    def score(e: Column) -> Column:
        at = low + e
        return F.struct((weight * F.abs(at - target) * F.when(at > target, 0.9).otherwise(1.0)).cast("double").alias("score"), at.alias("at"))

    return score


def soft_boundary(text: Column, target: Column, shift: int) -> Column:
    """The best cut (characters) within ``shift`` of target: least weight * distance, 0.9 of it after the target; the target if there is none."""
    low = F.greatest(target - shift, F.lit(0))
    near = F.substring(text, low + 1, F.lit(2 * shift))
    found = []
    for pattern, weight in BOUNDARIES.values():
        pieces, hits = F.split(near, pattern, -1), F.regexp_extract_all(near, F.lit(pattern), 0)
        found.append(F.filter(F.transform(_ends(pieces, hits), _scored(low, target, weight)), lambda s: F.abs(s["at"] - target) <= shift))
    return F.coalesce(F.array_min(F.concat(*found))["at"], target)


def safe_cut(before: Column, after: Column) -> Column:
    """Whether a cut between the two texts is inside no word, link, tag, formula, code, list item or table row.

    The table rule uses escaped bars, as documented for the reference; its code, by reading, matches every line.
    """
    inside_word = before.rlike(r"[\p{L}\p{N}]$") & after.rlike(r"^[\p{L}\p{N}]")
    url = before.rlike(r"https?://\S*$") & after.rlike(r"^\S")
    link = before.rlike(r"\[[^\]]*$") | before.rlike(r"\]\([^)]*$")
    tag = before.rlike(r"<[^<>]*$") & after.rlike(r"^[^<>]*>")
    code = (F.size(F.split(before, "```")) - 1) % 2 == 1
    tick = (F.size(F.split(F.element_at(F.split(before, "\n"), -1), "`")) - 1) % 2 == 1
    formula = (F.size(F.split(before, r"\$\$")) - 1) % 2 == 1
    row = before.rlike(r"\n\|[^\n]*$") & ~before.rlike(r"\n$")
    return ~(inside_word | url | link | tag | code | tick | formula | row)


def cut_quality(before: Column, after: Column) -> Column:
    """1 after a section or paragraph, 0.8 after a sentence, 0.5 after a phrase, 0.2 else; 0 if unsafe."""
    value = F.when(before.rlike(r"\n\s*\n\s*$") | after.rlike("^#{1,6} "), 1.0).when(before.rlike(r"[.!?]\s*$"), 0.8).when(before.rlike(r"[,;:]\s*$"), 0.5).otherwise(0.2)
    return F.when(safe_cut(before, after), value).otherwise(0.0)


def fallback_cut(text: Column, target: Column, most: int) -> Column:
    """The safe cut nearest to target (steps of 10 up to 30 % of ``most``); target itself where none is safe."""
    reach = int(most * 0.3) // 10
    steps = F.array(*[F.lit(s * k * 10) for k in range(reach + 1) for s in ((1, -1) if k else (1,))])
    good = F.filter(steps, lambda s: (target + s > 0) & (target + s < F.length(text)) & safe_cut(F.substring(text, F.lit(1), target + s), F.substring(text, target + s + 1, F.length(text))))
    return target + F.coalesce(F.get(good, F.lit(0)), F.lit(0))


def numbered(parts: DataFrame, file_col: str = "source_file", order: str = "part", start: int = 0) -> DataFrame:
    """A global number ``order_no`` of the rows: files' counts give each file's offset, so no window spans all rows."""
    counts = parts.groupBy(file_col).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(file_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy(file_col).orderBy(order))
    return parts.withColumn("_local", local).join(before.drop("_n"), file_col).withColumn("order_no", F.col("_before") + F.col("_local") - 1 + start).drop("_local", "_before")


def cleaned_reply(reply: Column) -> Column:
    """A reply without its code fence, quotes inside HTML attributes repaired."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.regexp_replace(bare, r'(<[A-Za-z][^<>]*?=)"([^"<>]*)"', r"$1'$2'")


def abstract(index: Column) -> Column:
    """The text of an inverted index (word to positions); on one position the last word wins; no blank before a mark."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, k: F.transform(e["value"], lambda p: F.struct(p.alias("p"), k.alias("k"), e["key"].alias("w")))))
    # Bound by a lambda, so that the pairs are sorted once and not for each word.
    last = F.get(F.transform(F.array(F.array_sort(pairs)), lambda o: F.filter(o, lambda x, i: F.coalesce(F.get(o, i + 1)["p"] != x["p"], F.lit(True)))), F.lit(0))
    return F.regexp_replace(F.array_join(F.transform(last, lambda x: x["w"]), " "), r" ([,.;:!?])", "$1")


def evidence_spans(docs: DataFrame, markers: list[str], id_col: str = "id", text_col: str = "text", context: int = 70, most: int = 8) -> DataFrame:
    """(id, marker, start, end, excerpt): whole-word hits of the markers, case-insensitive (an s may follow a single word); the first
    ``most`` by (marker's place in the list, start).  All markers are found in one pass over the text."""
    return automaton.evidence(docs, markers, id_col, text_col, context, most)


def collected_spans(fields: dict[str, tuple[DataFrame, int]], markers: list[str], id_col: str = "id", most: int = 14) -> DataFrame:
    """Spans over several fields (name: table of id and text, and the field's cap), each once, the first ``most`` in the order of fields."""
    out = None
    for k, (name, (docs, cap)) in enumerate(fields.items()):
        part = evidence_spans(docs, markers, id_col, most=cap).select(id_col, F.lit(k).alias("_k"), F.lit(name).alias("field"), "marker", "start", "end", "excerpt")
        out = part if out is None else out.unionByName(part)
    out = out.dropDuplicates([id_col, "field", "marker", "start", "end"])
    w = Window.partitionBy(id_col).orderBy("_k", "start", "marker")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_k")


# Names of sections and their headings.
SECTIONS = {
    "abstract": "abstract|summary|overview",
    "introduction": "introduction|background|motivation",
    "methodology": "methodology|methods|approach|method",
    "experiments": "experiments|experimental setup|evaluation setup|setup",
    "results": "results|findings|performance",
    "discussion": "discussion|analysis|interpretation",
    "limitations": "limitations|limit|weaknesses",
    "reproducibility": "reproducibility|artifact|artifacts|code availability|data availability|code and data availability",
    "conclusion": "conclusion|conclusions|closing",
}


def sections(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, section, body): the lines below each known heading up to the next heading-like line; equal sections are joined."""
    spark = docs.sparkSession
    alias = spark.createDataFrame([(a, s) for s, names in SECTIONS.items() for a in names.split("|")], "token string, section string")
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    token = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.col("line"), r"^\s*(?:#{1,6}\s*)?(?:\d+(?:\.\d+)*\.?\s+)?", ""), r"[:.*\s]+$", "")))
    heading = F.col("line").rlike(r"^\s*#{1,6}\s+\S")
    named = lines.withColumn("token", token).join(F.broadcast(alias), "token", "left")
    head = heading | F.col("section").isNotNull()
    w = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = named.withColumn("_head", head).withColumn("_of", F.sum(F.col("_head").cast("int")).over(w))
    name = part.where("_head").select(id_col, "_of", "section")
    body = part.where("not _head").select(id_col, "_of", "n", "line").join(name.where("section is not null"), [id_col, "_of"])
    out = body.groupBy(id_col, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return out.withColumn("body", F.trim("body")).where("body <> ''")


def jats_text(xml: Column) -> Column:
    """Text of article XML: titles as headings, paragraphs as lines, common entities resolved."""
    out = F.regexp_replace(xml, r"(?is)<title[^>]*>(.*?)</title>", "\n## $1\n")
    out = F.regexp_replace(out, r"(?i)</?(?:p|sec|abstract|list-item|break)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def _match(value: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.trim(value), pattern, group), F.lit(""))


def doi(value: Column) -> Column:
    """The DOI in a value, without closing marks."""
    bare = F.regexp_replace(F.trim(value), r"(?i)^https?://(?:dx\.)?doi\.org/|^doi:", "")
    return F.regexp_replace(_match(bare, r"(?i)(10\.\d{4,9}/[^\s\"'<>]+)"), r"[).,;]+$", "")


def arxiv_id(value: Column) -> Column:
    """An arXiv id: bare, prefixed, or in an arxiv.org address."""
    form = r"(\d{4}\.\d{4,5}(?:v\d+)?)"
    return F.coalesce(_match(value, f"(?i)^{form}$"), _match(value, rf"(?i)^arxiv(?:\s*:\s*|\s+){form}$"), _match(value, rf"(?i)^https?://(?:[^/]*\.)?arxiv\.org/(?:abs|pdf|html)/{form}(?:\.pdf)?/?(?:[?#].*)?$"))


def pmid(value: Column) -> Column:
    """A PubMed id, strict."""
    return F.coalesce(_match(value, r"(?i)^pmid\s*:\s*(\d{5,})$"), _match(value, r"(?i)^https?://pubmed\.ncbi\.nlm\.nih\.gov/(\d{5,})/?$"), _match(value, r"^(\d{5,})$"))


def pmcid(value: Column) -> Column:
    """A PubMed Central id, strict."""
    number = F.coalesce(_match(value, r"(?i)^pmcid\s*:\s*(?:PMC)?(\d+)$"), _match(value, r"(?i)^PMC(\d+)$"), _match(value, r"(?i)^https?://(?:(?:www\.)?ncbi\.nlm\.nih\.gov/pmc|pmc\.ncbi\.nlm\.nih\.gov|europepmc\.org)/articles/PMC(\d+)/?$"))
    return F.concat(F.lit("PMC"), number)


def work_id(value: Column) -> Column:
    """The short id of a work."""
    return F.upper(_match(value, r"(?i)(W\d+)$"))


def collected_urls(entries: Column) -> Column:
    """http(s) entries (type, url), the first of each."""
    good = F.filter(entries, lambda e: e["url"].rlike(r"(?i)^https?://[^\s/]+"))
    return F.filter(good, lambda e, i: ~F.exists(F.slice(good, F.lit(1), i), lambda o: (o["type"] == e["type"]) & (o["url"] == e["url"])))


def normal_title(title: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one blank; empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), F.lit(""))


def title_match(query: Column, title: Column) -> Column:
    """1 for equal normal forms, 0.95 where one of 16 characters or more is in the other, else 0.7 recall + 0.3 precision of the words."""
    q, t = normal_title(query), normal_title(title)
    qs, ts = F.array_distinct(tokenize(q)), F.array_distinct(tokenize(t))
    both = F.size(F.array_intersect(qs, ts))
    contained = (F.least(F.length(q), F.length(t)) >= CONTAINED) & (F.contains(q, t) | F.contains(t, q))
    shared = F.when((F.size(qs) == 0) | (F.size(ts) == 0), 0.0).otherwise(0.7 * both / F.greatest(F.size(qs), F.lit(1)) + 0.3 * both / F.greatest(F.size(ts), F.lit(1)))
    return F.when((q == "") | (t == ""), 0.0).when(q == t, 1.0).when(contained, 0.95).otherwise(shared)


#: From so many characters on, a title that is part of another matches it.
CONTAINED = 16


def best_titles(queries: DataFrame, papers: DataFrame, least: float = 0.6) -> DataFrame:
    """(query_id, paper_id, score): the best match of each query of at least ``least`` (above 0); of equal ones the smallest paper_id.

    Exact, without comparing all pairs: a score of ``least`` by words needs (least - 0.3) / 0.7 of the query's words, so two sets that
    reach it share one of the query's rarest words, all but so many less one; equal forms meet by equality; and of two titles one of which
    is in the other, the shorter one's first 16 characters are among the longer one's runs of 16.  A pair that meets several ways is scored once.
    Equal forms are one title (its smallest paper_id) and one query: copies are not compared.
    """
    every = queries.select(F.col("query_id").alias("_id"), normal_title(F.col("query")).alias("q")).where("q <> ''")
    left = every.groupBy("q").agg(F.min("_id").alias("query_id")).withColumn("w", F.array_distinct(tokenize(F.col("q"))))
    right = papers.select("paper_id", normal_title(F.col("title")).alias("t")).where("t <> ''").groupBy("t").agg(F.min("paper_id").alias("paper_id")).withColumn("w", F.array_distinct(tokenize(F.col("t"))))
    having = right.select("paper_id", F.explode("w").alias("w"))
    known = left.select("query_id", F.size("w").alias("n"), F.explode("w").alias("w")).join(having.groupBy("w").agg(F.count("*").alias("df")), "w")
    need = F.greatest(F.ceil(F.col("n") * (max(least - 0.3, 0.0) / 0.7) - 1e-9), F.lit(1))
    rare = known.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "w"))).withColumn("known", F.count("*").over(Window.partitionBy("query_id")))
    pairs = [rare.where(F.col("k") <= F.col("known") - need + 1).select("query_id", "w").join(having, "w").select("query_id", "paper_id")]
    pairs.append(left.join(right.select("paper_id", F.col("t").alias("q")), "q").select("query_id", "paper_id"))
    if least <= 0.95:
        runs = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=(.{{{CONTAINED}}}))"), 1)))  # noqa: E731 (one pass over the title)
        long_q, long_t = left.where(F.length("q") >= CONTAINED), right.where(F.length("t") >= CONTAINED)
        head = lambda c: F.substring(c, 1, CONTAINED).alias("g")
        pairs.append(long_q.select("query_id", head("q")).join(long_t.select("paper_id", runs(F.col("t")).alias("g")), "g").select("query_id", "paper_id"))
        pairs.append(long_t.select("paper_id", head("t")).join(long_q.select("query_id", runs(F.col("q")).alias("g")), "g").select("query_id", "paper_id"))
    met = reduce(DataFrame.unionByName, pairs).distinct()
    both = met.join(left.select("query_id", "q"), "query_id").join(right.select("paper_id", "t"), "paper_id").withColumn("score", title_match(F.col("q"), F.col("t")))
    best = both.where((F.col("score") >= least) & (F.col("score") > 0)).groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "paper_id")).alias("b"))
    named = left.select("query_id", "q").join(best, "query_id").select("q", "b.paper_id", (-F.col("b.s")).alias("score"))
    return every.join(named, "q").select(F.col("_id").alias("query_id"), "paper_id", "score")


@F.pandas_udf(ArrayType(StringType()))
def _redecoded(texts: pd.Series) -> pd.Series:
    def forms(t):
        if t is None:
            return None
        out = [t]
        for code in ("cp866", "latin1", "cp1251"):
            try:
                out.append(t.encode(code).decode("utf-8"))
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return out

    return texts.map(forms)


def repaired(text: Column) -> Column:
    """The best re-decoding of a text: Cyrillic letters count 1, box drawing -3, Latin-1 letters -2; the first of equals."""
    count = lambda t, pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    score = lambda t: count(t, "[\\u0400-\\u04FF]") - 3 * count(t, "[\\u2500-\\u257F]") - 2 * count(t, "[\\u00C0-\\u00FF]")
    scored = F.transform(_redecoded(text), lambda t, i: F.struct(score(t).alias("s"), (-i).alias("i"), t.alias("t")))
    return F.array_max(scored)["t"]


def markdown_elements(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, position, type, level, content): headings, code, tables, images, lists and paragraphs; blocks by gaps and islands of lines."""
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    w = Window.partitionBy(id_col).orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike("^\\s*```")
    lines = lines.withColumn("_f", F.sum(fence.cast("int")).over(upto))
    code = fence | (F.col("_f") % 2 == 1)
    kind = (
        F.when(code, "code").when(F.col("line").rlike("^#{1,6} "), "heading").when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "table").when(F.col("line").rlike(r"^\s*!\[[^\]]*\]\([^)]*\)\s*$"), "image")
        .when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)]) "), "list").when(F.trim("line") == "", "blank").otherwise("paragraph")
    )
    lines = lines.withColumn("type", kind)
    fresh = (F.col("type") != F.lag("type").over(w)) | F.lag("type").over(w).isNull() | F.col("type").isin("heading", "image") | ((F.col("type") == "code") & fence & (F.col("_f") % 2 == 1))
    lines = lines.withColumn("_b", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(upto)).where("type <> 'blank'")
    out = lines.groupBy(id_col, "_b", "type").agg(F.min("n").alias("position"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"))
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract("content", "^(#+)", 1)))
    return out.select(id_col, "position", "type", level.alias("level"), "content")


def table_quality(table: Column) -> Column:
    """Whether a pipe table is of low quality: under two rows, 30 % empty cells, rows that differ by two cells, or no separator row."""
    rows = F.filter(F.split(table, "\n"), lambda r: F.contains(r, F.lit("|")))
    separator = lambda r: r.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")
    body = F.filter(rows, lambda r: ~separator(r))
    cells = F.transform(body, lambda r: F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"))
    flat = F.flatten(cells)
    empty = F.size(F.filter(flat, lambda c: F.trim(c) == "")) / F.greatest(F.size(flat), F.lit(1))
    widths = F.transform(cells, lambda c: F.size(c))
    return (F.size(body) < 2) | (empty >= 0.3) | (F.array_max(widths) - F.array_min(widths) >= 2) | ((F.size(F.filter(rows, separator)) == 0) & (F.size(F.split(table, r"\|")) > 20))


def sheet_grid(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(file, sheet, row, line): merged ranges filled from their first cell, outer empty rows and columns trimmed, lines as pipe rows.

    cells: file, sheet, row, col, value; merges: file, sheet, r1, c1, r2, c2.
    """
    keys = ["file", "sheet"]
    head = merges.join(cells.select(*keys, F.col("row").alias("r1"), F.col("col").alias("c1"), "value"), [*keys, "r1", "c1"])
    filled = head.select(*keys, F.explode(F.sequence("r1", "r2")).alias("row"), "c1", "c2", "value").select(*keys, "row", F.explode(F.sequence("c1", "c2")).alias("col"), "value")
    every = cells.join(filled.select(*keys, "row", "col", F.col("value").alias("_v")), [*keys, "row", "col"], "full").select(*keys, "row", "col", F.coalesce("_v", "value").alias("value"))
    used = every.where("trim(coalesce(value, '')) <> ''")
    box = used.groupBy(*keys).agg(F.min("col").alias("cl"), F.max("col").alias("ch"), F.max("row").alias("rh"))
    lines = every.join(box, keys).where("row <= rh and col between cl and ch").groupBy(*keys, "row", "cl", "ch").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit(""))))).alias("m"))
    line = F.array_join(F.transform(F.sequence("cl", "ch"), lambda c: F.coalesce(F.replace(F.try_element_at("m", c), F.lit("|"), F.lit("\\|")), F.lit(""))), " | ")
    return lines.select(*keys, "row", F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))


def budgeted(parts: DataFrame, group: str, order: str, total: int = 32_000, each: int = 8_000) -> DataFrame:
    """Parts (group, order, text) cut to ``each`` characters, and by group to ``total``: the part at the limit is cut, later ones go."""
    own = parts.withColumn("text", F.substring("text", 1, each))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = own.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    return before.where(F.col("_before") < total).withColumn("text", F.substring("text", F.lit(1), (total - F.col("_before")).cast("int"))).drop("_before")


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    """The text, or its first characters and a mark, ``most`` in all."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def topic_slug(topic: Column, most: int = 60) -> Column:
    """A topic as a file name."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(topic), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def payload_text(payload: Column) -> Column:
    """Text of a JSON payload: a string, a list of strings by line, or an object's first non-blank of text, content, markdown, fullText, full_text."""
    fields = [F.nullif(F.trim(F.get_json_object(payload, f"$.{k}")), F.lit("")) for k in ("text", "content", "markdown", "fullText", "full_text")]
    lines = F.array_join(F.from_json(payload, "array<string>"), "\n")
    string = F.get_json_object(F.concat(F.lit('{"v":'), payload, F.lit("}")), "$.v")
    long = F.array_join(F.filter(F.map_values(F.from_json(payload, "map<string,string>")), lambda v: F.length(v) > 200), "\n")
    start = F.substring(F.trim(payload), 1, 1)
    return F.nullif(F.when(start == "{", F.coalesce(*fields, long)).when(start == "[", lines).when(start == '"', string).otherwise(payload), F.lit(""))
