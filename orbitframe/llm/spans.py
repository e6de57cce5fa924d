"""Regular-expression matches with their places, as Column expressions.

A span is ``struct<start: int, rank: int, end: int, kind: string, text: string>``:
code points, end exclusive; ``rank`` is the kind's place in its list, so that the natural
order of the struct is by start, then kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .runtime import let

SPAN = "struct<start:int,rank:int,end:int,kind:string,text:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


#: Items of a step of :func:`running`, and code points of a piece of :func:`pieces`.
STEP, PIECE = 128, 512


def running(values: Column, grow, first: Column) -> Column:
    """``first, grow(first, v1), grow(grow(first, v1), v2), ...`` for an associative ``grow`` of which ``first`` is neutral.

    Appending to an array copies it, so values are folded by steps of STEP, and the steps' last ones then are:
    nearly linear even for millions of values.
    """

    def fold(a: Column) -> Column:
        return F.aggregate(a, F.array(first), lambda acc, v: F.concat(acc, F.array(grow(F.element_at(acc, -1), v))))

    def joined_steps(inner: Column) -> Column:
        lasts = fold(F.transform(inner, lambda x: F.element_at(x, -1)))
        shifted = let(lasts, lambda last: F.transform(inner, lambda x, i: F.transform(F.slice(x, 2, F.size(x)), lambda v: grow(F.get(last, i), v))))
        return F.concat(F.array(first), F.flatten(shifted))

    steps = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STEP).cast("int")), lambda k: fold(F.slice(a, k * STEP + 1, STEP)))
    return let(values, lambda a: F.when(F.size(a) <= STEP, fold(a)).otherwise(let(steps(a), joined_steps)))


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, for :func:`part`."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text, from its :func:`pieces`: a substring of a long text would walk it from its begin."""
    low = F.floor(start / PIECE).cast("int")
    held = F.array_join(F.slice(cut, low + 1, F.floor(end / PIECE).cast("int") - low + 1), "")
    return F.when(end > start, F.substring(held, start % PIECE + 1, end - start)).otherwise(F.lit(""))


def matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """All leftmost non-overlapping matches of a Java pattern that never matches nothing.

    The texts between matches (``split``) and the matches alternate, so that
    running lengths give every start.
    """

    def placed(found: Column, between: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m))
        ends = running(lengths, lambda a, b: a + b, F.lit(0))
        spans = let(ends, lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i + 1) - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.get(e, i + 1).alias("end"), F.lit(kind).alias("kind"), m.alias("text"))))
        return F.when(F.size(found) > 0, spans.cast(f"array<{SPAN}>")).otherwise(no_spans())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda between: placed(found, between)))


def clear_of(spans: Column, others: Column) -> Column:
    """The ``spans``, by start, that overlap none of ``others``.

    In the order of starts, a span overlaps another if one before it ends after its start, or one after it starts before its end.
    """
    far = F.lit(2**31 - 1)

    def kept(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["other"], x["s"]["end"]).otherwise(0)), F.greatest, F.lit(0))
        starts = running(F.reverse(F.transform(both, lambda x: F.when(x["other"], x["s"]["start"]).otherwise(far))), F.least, far)
        clear = lambda x, i, e, f: ~x["other"] & (F.get(e, i) <= x["s"]["start"]) & (F.get(f, F.size(both) - 1 - i) >= x["s"]["end"])
        return let(ends, lambda e: let(starts, lambda f: F.transform(F.filter(both, lambda x, i: clear(x, i, e, f)), lambda x: x["s"])))

    marked = lambda a, other: F.transform(a, lambda s: F.struct(s.alias("s"), F.lit(other).alias("other")))
    both = F.array_sort(F.concat(marked(spans, False), marked(others, True)))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), F.array_sort(spans)).otherwise(let(both, kept))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, by start and then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first kind."""

    def done(a: Column, reach: Column, cut: Column) -> Column:
        # reach: for each span how far those before it go
        opening = lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(part(cut, F.get(reach, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(a, opening), ""), part(cut, F.element_at(reach, -1), F.length(text)))

    reach = lambda a: running(F.transform(a, lambda s: s["end"]), F.greatest, F.lit(0))
    return let(F.array_sort(spans), lambda a: let(reach(a), lambda r: let(pieces(text), lambda cut: done(a, r, cut))))
