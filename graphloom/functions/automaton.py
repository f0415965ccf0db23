"""Many patterns at once: one Aho-Corasick automaton over all of them, one pass over each text.

The work is the length of the texts plus the hits, whatever the number of patterns.  Patterns travel to the
tasks only when their count and size, which are measured first, are within ``MOST_PATTERNS`` and
``MOST_CHARS``; ``collected`` says None beyond, and the callers then take a join by n-grams.  A worker builds
an automaton once and keeps it for its later tasks.

Matching ignores case, letter by letter, so that places in the lower-case text are places in the text.
Null texts and empty patterns have no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PATTERNS = 1_000_000
MOST_CHARS = 20_000_000

_KEPT: dict[str, object] = {}


def collected(patterns: DataFrame, column: str) -> list[str] | None:
    """The distinct patterns in order, if they are few and short enough for every task to hold."""
    only = patterns.select(F.col(column).alias("p")).where("p <> ''").distinct()
    n, chars = only.agg(F.count("*"), F.coalesce(F.sum(F.length("p")), F.lit(0))).first()
    return sorted(r["p"] for r in only.collect()) if n <= MOST_PATTERNS and chars <= MOST_CHARS else None


def lowered(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton(patterns: list[str]):
    """The automaton of the lower-case patterns; its values are their places in the list."""
    key = hashlib.sha256("\0".join(patterns).encode()).hexdigest()
    if key not in _KEPT:
        import ahocorasick

        a = ahocorasick.Automaton()
        at: dict[str, list[int]] = {}
        for n, p in enumerate(patterns):
            at.setdefault(lowered(p), []).append(n)
        for low, places in at.items():
            if low:
                a.add_word(low, (len(low), places))
        a.make_automaton()
        _KEPT.clear()
        _KEPT[key] = a
    return _KEPT[key]


def hits(text: str, a) -> Iterator[tuple[int, int, int]]:
    """(pattern, start, end) of every occurrence in a lower-case text, by end."""
    if len(a):
        for last, (n, places) in a.iter(text):
            for p in places:
                yield p, last + 1 - n, last + 1


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether a word begins or ends at both ends of a hit."""
    before = start > 0 and is_word(text[start - 1])
    after = end < len(text) and is_word(text[end])
    return before != is_word(text[start]) and after != is_word(text[end - 1])


def occurring(texts: DataFrame, patterns: list[str], id_col: str, text_col: str, keep: Callable[[str, int, int], bool] | None = None) -> DataFrame:
    """(id, pattern): the patterns that occur in a text, once each; keep says which hits count."""
    kind = texts.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(patterns)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                low, seen = lowered(text or ""), set()
                for p, start, end in hits(low, a):
                    if p not in seen and (keep is None or keep(low, start, end)):
                        seen.add(p)
                rows += [row] * len(seen)
                found += [patterns[p] for p in sorted(seen)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["id", "pattern"])

    return texts.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text").mapInArrow(find, f"id {kind}, pattern string")


def _boundary(text: str, at: int) -> bool:
    return not (0 <= at < len(text) and (text[at].isascii() and text[at].isalnum()))


def marked(text: str, markers: list[str], a, most: int) -> list[tuple[int, int, int]]:
    """(marker, start, end): hits bounded by no ASCII letter or digit, where a single word without a final s may take one; of a marker
    none that overlap; the first ``most`` in the order of the markers."""
    low, found = lowered(text), {}
    for p, start, end in hits(low, a):
        mine = found.setdefault(p, [])
        if len(mine) >= most or (mine and start < mine[-1][1]) or not _boundary(low, start - 1):
            continue
        if not _boundary(low, end):
            if " " in markers[p] or low[end - 1] == "s" or low[end] != "s" or not _boundary(low, end + 1):
                continue
            end += 1
        mine.append((start, end))
    return [(p, *span) for p in sorted(found) for span in found[p]][:most]


def evidence(docs: DataFrame, markers: list[str], id_col: str, text_col: str, context: int, most: int) -> DataFrame:
    """(id, marker, start, end, excerpt) of the first ``most`` marked hits of each text; the excerpt has ``context`` characters on both sides, trimmed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(markers)
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for row, text in enumerate(batch["text"].to_pylist()):
                for p, start, end in marked(text or "", markers, a, most):
                    rows.append(row)
                    for column, value in zip(out, (markers[p], start, end, text[max(0, start - context) : end + context].strip()), strict=True):
                        column.append(value)
            types = (pa.string(), pa.int32(), pa.int32(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows, pa.int64())), *columns], names=["id", "marker", "start", "end", "excerpt"])

    rows = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(find, f"id {kind}, marker string, start int, end int, excerpt string").withColumnRenamed("id", id_col)
