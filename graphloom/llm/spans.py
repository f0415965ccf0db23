"""Regex matches with positions, as column expressions.

Spark returns matches without positions.  The pieces between matches (``split``) and the matches
(``regexp_extract_all``) alternate, so a running sum of their lengths gives every position in code
points.  Both see the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,text:string,before:string>>"
#: Characters before a match that come with it.
CONTEXT = 30
#: Matches whose positions are added up together; an aggregate copies its state at every step, so it must stay small.
CHUNK = 256


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str, kind: str, needed: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (kind, start, end, text, before); needed: a cheap necessary condition.

    before: up to ``CONTEXT`` characters, as far back as the first of the ``CHUNK`` matches that are placed together.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.filter(F.zip_with(pieces, hits, lambda p, m: F.struct(p.alias("gap"), m.alias("m"))), lambda x: x["m"].isNotNull())
    none = F.expr(f"cast(array() as {SPAN})")
    last = lambda x: F.right(x, F.lit(CONTEXT))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        before = last(F.concat(s["tail"], last(x["gap"])))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("text"), before.alias("before"))
        return F.struct(end.alias("at"), last(F.concat(s["tail"], last(x["gap"]), last(x["m"]))).alias("tail"), F.concat(s["out"], F.array(span)).alias("out"))

    def placed(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.lit("").alias("tail"), none.alias("out")), step, lambda s: s["out"])

    def of_chunks(chunks: Column) -> Column:
        length = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["m"]))
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        starts = F.aggregate(chunks, begin, lambda s, c: F.struct((s["at"] + length(c)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(chunks, starts, placed))

    def of_pairs(p: Column) -> Column:
        cut = lambda k: F.slice(p, k, F.lit(CHUNK))
        few = placed(p, F.lit(0))
        return F.when(F.size(p) <= CHUNK, few).otherwise(_bound(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(CHUNK)), cut), of_chunks))

    spans = _bound(pairs, of_pairs)
    return spans if needed is None else F.when(needed, spans).otherwise(none)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """Sorted by (kind as listed, start) or by (start, kind as listed)."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]).cast("int")
    keyed = F.transform(spans, lambda s: F.struct(*((rank(s).alias("a"), s["start"].alias("b")) if by_kind else (s["start"].alias("a"), rank(s).alias("b"))), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _chunks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK)), lambda k: F.slice(values, k, F.lit(CHUNK)))


def free(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, in their order.

    Few are compared one by one.  Many are swept: the others by their start and the spans by their end stand in one order, and a span
    is free if no other that starts before its end has an end after its start; the largest end so far is carried from chunk to chunk.
    """

    def swept(events: Column) -> Column:
        end_of = lambda e: F.when(e["other"] == 1, e["edge"]).otherwise(F.lit(-1))
        most = lambda c: F.coalesce(F.array_max(F.transform(c, end_of)), F.lit(-1))

        def of_chunks(chunks: Column) -> Column:
            begin = F.struct(F.lit(-1).alias("m"), F.expr("cast(array() as array<int>)").alias("out"))
            before = F.aggregate(F.transform(chunks, most), begin, lambda s, m: F.struct(F.greatest(s["m"], m).alias("m"), F.concat(s["out"], F.array(s["m"])).alias("out")), lambda s: s["out"])

            def of_chunk(c: Column, m: Column) -> Column:
                told = F.transform(c, lambda e, j: F.struct(e["other"].alias("other"), e["edge"].alias("edge"), e["at"].alias("at"), F.greatest(m, most(F.slice(c, F.lit(1), j))).alias("m")))
                return F.transform(F.filter(told, lambda e: (e["other"] == 0) & (e["m"] <= e["edge"])), lambda e: e["at"])

            return F.flatten(F.zip_with(chunks, before, of_chunk))

        return F.transform(F.array_sort(_bound(_chunks(events), of_chunks)), lambda k: F.get(spans, k))

    event = lambda pos, other, edge, at: F.struct(pos.alias("pos"), F.lit(other).alias("other"), edge.alias("edge"), at.alias("at"))
    events = F.concat(F.transform(others, lambda o: event(o["start"], 1, o["end"], F.lit(0))), F.transform(spans, lambda s, k: event(s["end"], 0, s["start"], k)))
    few = F.size(spans).cast("bigint") * F.size(others) <= CHUNK * CHUNK
    return F.when(few, F.filter(spans, lambda s: ~overlaps(s, others))).otherwise(_bound(F.array_sort(events), swept))


def first_of_each(spans: Column) -> Column:
    """Of spans that overlap, the first by (start, kind) stays; the array that grows is copied once a chunk, not once a span."""
    none = F.expr(f"cast(array() as {SPAN})")

    def step(s: Column, x: Column) -> Column:
        return F.when(s["end"] > x["start"], s).otherwise(F.struct(x["s"]["end"].alias("end"), F.concat(s["out"], F.array(x["s"])).alias("out")))

    def of_chunk(s: Column, c: Column) -> Column:
        got = F.aggregate(c, F.struct(s["end"].alias("end"), none.alias("out")), step)
        return _bound(got, lambda g: F.struct(g["end"].alias("end"), F.concat(s["out"], g["out"]).alias("out")))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s.alias("s"))))
    return _bound(ordered, lambda o: F.aggregate(_chunks(o), F.struct(F.lit(-1).alias("end"), none.alias("out")), of_chunk, lambda s: s["out"]))
