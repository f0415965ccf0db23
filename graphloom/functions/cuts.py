"""B6 to B8 in linear time: every safe cut of a text from one pass, and slices that cut only there.

A cut at i parts a text into its first i characters and the rest.  What makes a cut unsafe hangs on
the state that a reader who comes from the left has at i (open brackets, the last < or >, the parity of
dollars and backticks, the start of an open link, the last lines' kinds) and on the line that follows.  Each
state is a running sum or maximum over the characters, so all cuts of a text cost one pass.

Whole texts are looked at; a text of null has no slices.  Two patterns are taken as meant, not as
written where they came from: a bar of a table row is a bar (unescaped, it would match any line, and no
cut would be safe), and ] ends a link's address.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The kinds of boundary, best first, as (kind, pattern); a cut is where a match ends.
KINDS = [
    (1, r"(?:^|\n)(?=<h[1-6])"),  # counts only with a > somewhere after it
    (1, r"(?:^|\n)(?=#{1,6}\s)"),
    (1, r"(?i)(?:^|\n)(?=(?:Глава|Параграф|Часть|Chapter|Section|Раздел|Урок|Тема)\s)"),
    (2, r"\n\n+"),
    (2, r"```\s*\n"),
    (3, r"(?<!Dr)(?<!Mr)(?<!Mrs)(?<!Ms)(?<!Prof)(?<!St)(?<!vs)(?<!etc)(?<!т\.д)(?<!т\.п)(?<!и\.д)(?<!и\.п)[.!?]\s+"),
    (4, r"\n"),
    (5, r"[,;:]\s+"),
    (6, r"\s+"),
]
# What ends just before a cut, and how good that is; the less, the better.
QUALITY = [(1, r"(?i)</h[1-6]>\s*$"), (1, r"\n#{1,6}\s+.*$"), (1, r"(?i)\n(?:Глава|Chapter|Раздел)\s+.*$"), (5, r"\n\n\Z"), (10, r"[.!?]\s*$"), (15, r"\n\Z"), (20, r"[,;]\s*$"), (50, r"  \Z")]
WORST = 100
PIECE = r"\s*(?:\w+|[^\s\w])"
#: So many candidates of a window are looked at.
MOST_CANDIDATES = 50
HTML_TABLE = 200


def _last(flags: np.ndarray) -> np.ndarray:
    """For each cut i, the last place below i that is marked, or -1."""
    n = len(flags)
    out = np.full(n + 1, -1)
    out[1:] = np.maximum.accumulate(np.where(flags, np.arange(n), -1)) if n else out[1:]
    return out


def _next(flags: np.ndarray) -> np.ndarray:
    """For each cut i, the first place from i on that is marked, or the length."""
    n = len(flags)
    out = np.full(n + 1, n)
    out[:-1] = np.minimum.accumulate(np.where(flags, np.arange(n), n)[::-1])[::-1] if n else out[:-1]
    return out


def _count(flags: np.ndarray) -> np.ndarray:
    """For each cut i, how many places below i are marked."""
    return np.concatenate(([0], np.cumsum(flags)))


def _starts(text: str, needle: str, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[[m.start() for m in re.finditer(re.escape(needle), text)]] = True
    return out


def _shifted(a: np.ndarray, k: int) -> np.ndarray:
    """a[i + k], False beyond the end."""
    return np.concatenate((a[k:], np.zeros(min(k, len(a)), bool)))


def _any_of_last(flags: np.ndarray, own: np.ndarray, line: np.ndarray, k: int) -> np.ndarray:
    """Whether the part of its own line before a cut, or one of the k - 1 whole lines above, is marked."""
    c = _count(flags)
    return own | (c[line] > c[np.maximum(line - (k - 1), 0)])


def safe_positions(text: str) -> np.ndarray:
    """For each cut from 0 to the length, whether it is safe: inside no word, link, address, tag, formula, code, list or table."""
    n = len(text)
    if n == 0:
        return np.ones(1, bool)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, of = np.unique(chars, return_inverse=True)
    letters = [chr(c) for c in kinds]

    def is_(f) -> np.ndarray:
        return np.array([f(c) for c in letters], bool)[of]

    def at(*cs: str) -> np.ndarray:
        return is_(lambda c: c in cs)

    cut = np.arange(n + 1)
    pad = lambda a: np.concatenate((a, [False]))  # noqa: E731  the character after the cut
    pre = lambda a: np.concatenate(([False], a))  # noqa: E731  the character before it
    space, line_end = is_(str.isspace), at("\n")
    alnum = is_(str.isalnum)
    bad = pre(alnum) & pad(alnum)

    stop = space | at(")", ">", "]")
    address = np.zeros(n, bool)  # marked at the last character of ://
    for m in re.finditer("https?://", text):
        address[m.end() - 1] = True
    bad |= (_last(address) > _last(stop)) & pad(~stop)

    opened = _count(at("[")) - _count(at("]"))
    rounds = _count(at("(")) - _count(at(")"))
    target = _starts(text, "](h", n)
    bad |= (opened > 0) | (pre(at("]")) & pad(at("(")))
    seen = _count(target)  # whole within the last ten characters: starts from i - 10 to i - 3
    bad |= seen[np.maximum(cut - 2, 0)] > seen[np.maximum(cut - 10, 0)]
    bad |= np.concatenate(([False, False], _starts(text, "](", n)))[: n + 1] & (rounds > 0)
    bad |= _last(at("<")) > _last(at(">"))
    bad |= (_count(at("$")) % 2 == 1) | (_count(at("`")) % 2 == 1)

    line = _count(line_end)  # the line of a cut
    begin = _last(line_end) + 1  # where it begins
    finish = _next(line_end)  # where it ends
    first = np.concatenate(([0], np.flatnonzero(line_end) + 1))

    blank = pad(space & ~line_end)[: n + 1]
    digit = is_(str.isdecimal)
    after_run = _next(~digit)[:n]
    dot, wide = pad(at(".")), np.concatenate((blank, [False]))
    number = digit & dot[after_run] & wide[after_run + 1]
    bullet = at("-", "*", "+") & wide[1 : n + 1]
    point = at("•") & wide[1 : n + 1]
    letter = is_(lambda c: "a" <= c <= "z" and len(c) == 1) & dot[1 : n + 1] & np.concatenate((wide[2:], [False]))[:n]
    two = at(" ") & _shifted(at(" "), 1)
    item = number | bullet | point | (two & _shifted(number | letter | bullet | point, 2)) | (at("\t") & _shifted(number | letter | bullet, 1))
    # How much of a line its mark takes, with one blank: to the dot and blank, or the sign and blank.
    body = np.arange(n) + np.where(two, 2, np.where(at("\t"), 1, 0))
    body = np.minimum(body, n - 1)
    size = np.where(digit[body], after_run[body] + 2, body + np.where(letter[body] & ~digit[body] & ~bullet[body] & ~point[body], 3, 2)) - np.arange(n)
    padded, sizes = pad(item), np.concatenate((size, [0]))
    own = padded[begin] & (cut - begin >= sizes[begin])
    listed = _any_of_last(padded[first], own, line, 3) & padded
    bad |= listed & (cut > 0) & (cut < n)

    bar = at("|")
    after_blanks = _next(~space | line_end)  # the first character of the line that is no blank
    shown = pad(bar)[after_blanks]
    bars = _next(bar)
    second = bars[np.minimum(after_blanks + 1, n)]
    row = shown & (second < finish)
    own = row[begin] & (second[begin] < cut)
    below = np.concatenate((row[first], np.zeros(5, bool)))  # the four lines below the cut's own
    c = _count(below)
    ahead = row | (c[np.minimum(line + 5, len(first))] > c[np.minimum(line + 1, len(first))])
    bad |= _any_of_last(row[first], own, line, 5) & ahead & (cut > 0) & (cut < n)
    back = np.maximum(cut - HTML_TABLE, 0)

    def whole(needle: str) -> np.ndarray:
        """How many are whole within the last characters before a cut."""
        begun = _count(_starts(text, needle, n))
        return np.maximum(np.concatenate(([0] * (len(needle) - 1), begun))[: n + 1] - begun[back], 0)

    bad |= whole("<table") > whole("</table>")
    bad[[0, n]] = False
    return ~bad


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The places where boundaries are, ascending, and the best kind of each."""
    best: dict[int, int] = {}
    last = text.rfind(">")
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text):
            if "<h" not in pattern or m.end() < last:
                best.setdefault(m.end(), kind)
    at = np.array(sorted(best), int)
    return at, np.array([best[x] for x in at.tolist()], int)


def _quality(before: str) -> int:
    return next((value for value, pattern in QUALITY if re.search(pattern, before)), WORST)


def cuts(text: str, most: int, shift: int, safe: np.ndarray | None = None) -> tuple[list[int], list[int], list[str]]:
    """The ends of a text's slices in pieces and in characters, and why each was cut there.

    A slice has about ``most`` pieces.  Of the 50 nearest boundaries by 1000 * kind + distance around its full length, the best
    that is safe and within ``shift`` pieces is taken; else the best safe piece there; else one further away, in steps of 10 up
    to 0.3 * most, ahead first; else the cut is forced at the full length plus shift.  The last slice takes the rest.
    """
    ends = np.array([m.end() for m in re.finditer(PIECE, text)], int)
    n = len(ends)
    if n == 0:
        return [], [], []
    ends[-1] = len(text)
    safe = safe_positions(text) if safe is None else safe
    at, kinds = boundaries(text)
    chars = np.concatenate(([0], ends))  # where a cut before piece i is
    out: tuple[list[int], list[int], list[str]] = ([], [], [])
    start = 0
    while n - start > most:
        goal = start + most
        low, high = max(start + 1, goal - shift), min(n, goal + shift)
        a, b = np.searchsorted(at, chars[low]), np.searchsorted(at, chars[high], side="right")
        near = np.lexsort((at[a:b], kinds[a:b] * 1000 + np.abs(at[a:b] - chars[goal])))[:MOST_CANDIDATES] + a
        where = np.searchsorted(chars, at[near])
        where = np.where((where > 0) & (chars[np.minimum(where, n)] - at[near] > at[near] - chars[where - 1]), where - 1, where)
        good = (where >= low) & (where <= high) & safe[chars[np.minimum(where, n)]]
        found, why = -1, "boundary"
        if good.any():
            scored = kinds[near][good] * 1000 + np.abs(where[good] - goal)
            found = int(where[good][np.lexsort((where[good], scored))[0]])
        if found < 0:
            some = np.arange(low, high + 1)
            some, why = some[safe[chars[some]]], "safe"
            if len(some):
                found = min((_quality(text[max(0, chars[p] - 50) : chars[p]]) + abs(p - goal) * 0.1, p) for p in some.tolist())[1]
        if found < 0:
            further = np.arange(shift + 1, int(most * 0.3), 10)
            tried = [p for p in [*(goal + further).tolist(), *(goal - further).tolist()] if start < p < n and safe[chars[p]]]
            found, why = (tried[0], "extended") if tried else (min(n, goal + shift), "forced")
        out[0].append(found)
        out[1].append(int(chars[found]))
        out[2].append(why)
        start = found
        if start == n:
            return out
    out[0].append(n)
    out[1].append(len(text))
    out[2].append("end")
    return out


def safe_slices(docs: DataFrame, most: int, shift: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """B3 with B6 to B8: (id, part, token_start, token_end, reason, safe, text): contiguous slices of whole texts, cut where it is safe (see ``cuts``)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):  # slices of some texts at a time
                part = batch.slice(begin, 64)
                out: dict[str, list] = {c: [] for c in ("row", "part", "token_start", "token_end", "reason", "safe", "text")}
                for row, text in enumerate(part["text"].to_pylist()):
                    if not text:
                        continue
                    safe = safe_positions(text)
                    tokens, chars, why = cuts(text, most, shift, safe)
                    for k, (a, b, c, d) in enumerate(zip([0, *tokens], tokens, [0, *chars], chars, strict=False)):
                        for name, value in zip(out, (row, k, a, b, why[k], bool(safe[d]), text[c:d]), strict=True):
                            out[name].append(value)
                ids = part["id"].take(pa.array(out.pop("row"), pa.int64()))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["id", *out])

    rows = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(slice_, f"id {kind}, part bigint, token_start bigint, token_end bigint, reason string, safe boolean, text string").withColumnRenamed("id", id_col)


def safe_cuts(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n_cuts, n_safe, places): of each text, how many cuts there are, how many are safe, and the sum of their places."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.flatnonzero(safe_positions(t or "")) for t in batch["text"].to_pylist()]
            cut = [len(t or "") + 1 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(cut, pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array([int(r.sum()) for r in rows], pa.int64())], names=["id", "n_cuts", "n_safe", "places"])

    rows = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(count, f"id {kind}, n_cuts bigint, n_safe bigint, places bigint").withColumnRenamed("id", id_col)
