"""Many patterns at once, against one regular expression a pattern."""

import random
import re

import pytest

from graphloom.functions import automaton as A
from graphloom.functions import text as T


def plain_mentions(chunks, terms):
    """Word boundaries as regular expressions have them."""
    return {(c, k) for c, text in chunks for k, t in terms if t and t.strip() and text is not None and re.search(r"\b" + re.escape(t.lower()) + r"\b", text.lower())}


BITS = ["a", "b", "the", "The", "tokens", "token", "c++", "++", "é", "x_y", " ", "  ", ", ", "-", "\n", "s", "1", "straße", "New York", "york"]


@pytest.mark.parametrize("bound", [10**6, -1])
def test_mentions(spark, bound, monkeypatch):
    from graphloom.operators import build

    monkeypatch.setattr(A, "MOST_PATTERNS", bound)  # by the automaton, and by the join beyond its bound
    rnd = random.Random(4)
    chunks = [(f"c{k}", "".join(rnd.choices(BITS, k=rnd.randint(0, 25)))) for k in range(80)] + [("none", None), ("empty", ""), ("long", "a b, " * 40_000 + "New York")]
    terms = [(f"k{k}", "".join(rnd.choices(BITS, k=rnd.randint(1, 3)))) for k in range(40)] + [("blank", "  "), ("nothing", ""), ("same", "the"), ("again", "THE")]
    got = build.mentions(spark.createDataFrame(chunks, "id string, text string"), spark.createDataFrame(terms, "concept_id string, term string"))
    assert {(r["source"], r["target"]) for r in got.collect()} == plain_mentions(chunks, terms)
    one = spark.createDataFrame([("k", None, ["the", "york"])], "concept_id string, term string, aliases array<string>")
    docs = spark.createDataFrame(chunks, "id string, text string")
    assert {r["source"] for r in build.mentions(docs, one).collect()} == {c for c, _ in plain_mentions(chunks, [("k", "the"), ("k", "york")])}
    assert build.mentions(docs, one.where("false")).count() == 0 == build.mentions(docs.where("false"), one).count()


@pytest.mark.parametrize("bound", [10**6, -1])
def test_known_in_goals(spark, bound, monkeypatch):
    from graphloom.operators import triples

    monkeypatch.setattr(A, "MOST_PATTERNS", bound)
    rnd = random.Random(6)
    goals = [(k, "".join(rnd.choices(BITS, k=12))) for k in range(60)] + [(99, None), (98, "")]
    labels = sorted({"".join(rnd.choices(BITS, k=rnd.randint(1, 2))) for _ in range(40)} | {" ", ""})
    got = triples.known_in_goals(spark.createDataFrame(goals, "goal_id int, goal string"), spark.createDataFrame([(x,) for x in labels], "label string"))
    assert {tuple(r) for r in got.collect()} == {(g, x) for g, t in goals for x in labels if x.strip() and t and x.lower() in t.lower()}


def plain_spans(text, markers, most, context):
    low, out = (text or "").lower(), []
    for m in markers:
        tail = "" if " " in m or m.endswith("s") else "s?"
        for x in re.finditer(rf"(?<![0-9a-z]){re.escape(m.lower())}{tail}(?![0-9a-z])", low):
            if len(out) < most:
                out.append((m, x.start(), x.end(), text[max(0, x.start() - context) : x.end() + context].strip()))
    return out


@pytest.mark.parametrize("most", [1, 5, 100])
def test_evidence_spans(spark, most):
    rnd = random.Random(8)
    texts = ["".join(rnd.choices(BITS, k=rnd.randint(0, 60))) for _ in range(80)] + [None, "", "İ the token", "the" * 50, "the " * 20_000 + "tokens"]
    markers = ["token", "tokens", "the", "a b", "New York", "York", "c++", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = T.evidence_spans(rows, markers, text_col="body", context=7, most=most).collect()
    for k, t in enumerate(texts):
        want = plain_spans("".join(c if len(c.lower()) == 1 else "I" for c in t or ""), markers, most, 7)
        assert [tuple(r)[1:4] for r in got if r["id"] == k] == [w[:3] for w in want]
        if t and "İ" not in t:
            assert [r["excerpt"] for r in got if r["id"] == k] == [w[3] for w in want]
    assert T.evidence_spans(rows, [], text_col="body").count() == 0 == T.evidence_spans(rows.where("false"), markers, text_col="body").count()
