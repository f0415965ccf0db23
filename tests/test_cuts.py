"""Safe cuts against a plain version that looks at both parts of the text at every cut."""

import random
import re

import numpy as np
import pytest

from graphloom.functions import cuts as C

ITEMS = [r"^\d+\.\s+", r"^  \d+\.\s+", r"^  [a-z]\.\s+", r"^\t\d+\.\s+", r"^\t[a-z]\.\s+", r"^[-*+]\s+", r"^  [-*+]\s+", r"^\t[-*+]\s+", r"^•\s+", r"^  •\s+"]


def plain_safe(text, i):
    a, b = text[:i], text[i:]
    if not a or not b:
        return True
    item = lambda line: any(re.match(p, line) for p in ITEMS)
    row = lambda line: re.match(r"^\s*\|.*\|", line)
    return not (
        (a[-1].isalnum() and b[0].isalnum())
        or (re.search(r"https?://[^\s)>\]]*$", a) and not a.endswith("\n") and re.match(r"[^\s)>\]]", b))
        or a.count("[") > a.count("]")
        or (a.endswith("]") and b.startswith("("))
        or "](h" in a[-10:]
        or (a.endswith("](") and a.count("(") > a.count(")"))
        or a.rfind("<") > a.rfind(">")
        or a.count("$") % 2
        or a.count("`") % 2
        or (any(item(x) for x in a.split("\n")[-3:]) and item(b.split("\n")[0]))
        or (any(row(x) for x in a.split("\n")[-5:]) and any(row(x) for x in b.split("\n")[:5]))
        or a[-200:].count("<table") - a[-200:].count("</table") > 0
    )


BITS = ["word", " ", "\n", "\n\n", "12. ", "7.", "- ", "* x", "+ ", "  - ", "  3. ", "  b. ", "\tc. ", "\t- ", "• ", "  • ", "| a | b |", "|", " | ", "[", "]", "](", "](http://x.y/z", ")", "(", "<", ">", "<table", "</table>", "$", "`", "```", "https://a.b/c_d", "http://", "é", "\U0001f600", "Привет", "Dr. ", ". ", ", ", "# Head", "\nChapter 1", "\r\n", " ", "a" * 30, "<h2>", "٣. "]


@pytest.mark.parametrize("seed", range(120))
def test_safe_positions(seed):
    rnd = random.Random(seed)
    some = rnd.sample(BITS, rnd.randint(3, len(BITS)))
    text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 120)))
    assert C.safe_positions(text).tolist() == [bool(plain_safe(text, i)) for i in range(len(text) + 1)], repr(text)


def test_states_that_end_far_away():
    text = "x <" + "a " * 500 + "> y [" + "b " * 700 + "] z"
    safe = C.safe_positions(text)
    assert not safe[4:1003].any() and safe[1005] and not safe[1010:2400].any() and safe[-2]


def plain_cuts(text, most, shift):
    """Slices by the rule, each candidate judged anew."""
    ends = [m.end() for m in re.finditer(C.PIECE, text)]
    if not ends:
        return []
    ends[-1] = len(text)
    chars, n, start, out = [0, *ends], len(ends), 0, []
    found = {}
    for kind, pattern in C.KINDS:
        for m in re.finditer(pattern.replace("<h[1-6]", "<h[1-6][^>]*>"), text):
            found[m.end()] = min(kind, found.get(m.end(), 9))
    while n - start > most:
        goal = start + most
        low, high = max(start + 1, goal - shift), min(n, goal + shift)
        near = sorted((k * 1000 + abs(x - chars[goal]), x) for x, k in found.items() if chars[low] <= x <= chars[high])[:50]
        best = []
        for _, x in near:
            p = min(range(n + 1), key=lambda p: (abs(chars[p] - x), -p))
            if low <= p <= high and plain_safe(text, chars[p]):
                best.append((found[x] * 1000 + abs(p - goal), p))
        if best:
            at = min(best)[1]
        else:
            value = lambda b: next((v for v, p in C.QUALITY if re.search(p, b)), C.WORST)
            safe = [(value(text[max(0, chars[p] - 50) : chars[p]]) + abs(p - goal) * 0.1, p) for p in range(low, high + 1) if plain_safe(text, chars[p])]
            far = [goal + s * k for s in (1, -1) for k in range(shift + 1, int(most * 0.3), 10)]
            far = [p for p in far if start < p < n and plain_safe(text, chars[p])]
            at = min(safe)[1] if safe else far[0] if far else min(n, goal + shift)
        out.append(at)
        start = at
        if at == n:
            return out
    return [*out, n]


@pytest.mark.parametrize("seed", range(25))
def test_cuts(seed):
    rnd = random.Random(seed)
    some = rnd.sample(BITS, 12) + ["word", " ", ". ", "\n"]
    text = "".join(rnd.choice(some) + rnd.choice([" ", " ", ""]) for _ in range(rnd.randint(0, 260)))
    most, shift = rnd.choice([(10, 3), (50, 8), (70, 2)])
    tokens, chars, why = C.cuts(text, most, shift)
    assert tokens == plain_cuts(text, most, shift), repr(text)
    assert "".join(text[a:b] for a, b in zip([0, *chars], chars, strict=False)) == (text if tokens else "")
    safe = C.safe_positions(text)
    assert all(safe[c] for c, w in zip(chars, why, strict=True) if w != "forced")


def test_safe_slices(spark):
    texts = [None, "", "   ", "one", "Some words here. More words, and [a link](http://x.y/z) too.\n\n- item\n- item\n" * 40, "x" * 100_000 + " y" * 3000, "a b\r\n" * 500]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id bigint, text string, part int")
    rows = C.safe_slices(docs, 50, 8).collect()
    for k, t in enumerate(texts):
        mine = sorted((r for r in rows if r["id"] == k), key=lambda r: r["part"])
        assert "".join(r["text"] for r in mine) == ("" if t is None or not t.strip() else t)
        assert [r["token_start"] for r in mine][1:] == [r["token_end"] for r in mine][:-1]
        assert all(r["safe"] or r["reason"] == "forced" for r in mine)
    n = {r["id"]: r for r in C.safe_cuts(docs).collect()}
    assert all(n[k]["n_safe"] == int(C.safe_positions(t or "").sum()) for k, t in enumerate(texts))
    assert C.safe_slices(docs.where("false"), 50, 8).count() == 0


def test_long_texts_are_linear():
    import time

    text = ("1" * 200_000 + "[" * 1000 + "<h1" * 50_000 + " |" * 100_000 + "http://" * 20_000) * 2
    began = time.time()
    assert len(C.safe_positions(text)) == len(text) + 1
    assert len(C.cuts(text, 5000, 500)[0]) > 10
    assert time.time() - began < 20
    assert np.flatnonzero(C.safe_positions("ab cd")).tolist() == [0, 2, 3, 5]
