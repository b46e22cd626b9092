"""Places of pattern matches in whole texts, and texts rewritten there, with SQL functions only.

Arrays are built in chunks of CHUNK, and texts are cut into chunks by a pattern, so that neither an array nor a text is copied
for each of its matches: the work is proportional to the text and, up to some million matches, to their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
PLACES = "array<struct<start:int,end:int>>"
CHUNK, PIECE = 256, 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """op of each element of an array and all before it; op is associative, with zero as its neutral element."""

    def within(chunk: Column) -> Column:
        start = F.struct(zero.alias("last"), F.slice(F.array(zero), 1, 0).alias("out"))

        def step(state: Column, x: Column) -> Column:
            return bound(op(state["last"], x), lambda y: F.struct(y.alias("last"), F.concat(state["out"], F.array(y)).alias("out")))

        return F.aggregate(chunk, start, step, lambda state: state["out"])

    def whole(v: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(v), F.lit(CHUNK))
        chunks = F.transform(firsts, lambda k: within(F.slice(v, k, CHUNK)))

        def joined(c: Column) -> Column:
            before = F.concat(F.array(zero), within(F.transform(c, lambda x: F.element_at(x, -1))))
            return F.flatten(F.zip_with(c, F.slice(before, 1, F.size(c)), lambda x, b: F.transform(x, lambda y: op(b, y))))

        return F.when(F.size(v) == 0, v).otherwise(bound(chunks, joined))

    return bound(values, whole)


def find(text: Column, pattern: str) -> Column:
    """(start, end, value) of the leftmost non-overlapping matches of a pattern that matches no empty string; code points, end exclusive."""

    def spans(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda p: F.length(p["gap"]) + F.length(p["value"])), lambda a, b: a + b, F.lit(0))
        return F.zip_with(pieces, ends, lambda p, e: F.struct((e - F.length(p["value"])).alias("start"), e.alias("end"), p["value"].alias("value")))

    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # the last gap follows no match
    pieces = bound(values, lambda v: F.arrays_zip(F.slice(gaps, 1, F.size(v)).alias("gap"), v.alias("value")))
    return F.when(text.rlike(pattern), bound(pieces, spans)).otherwise(F.array().cast(SPAN))


def merged(spans: Column) -> Column:
    """(start, end) of the places that spans (start, end, ...) cover, in order; spans that overlap are one place."""

    def places(own: Column) -> Column:
        ends = running(F.transform(own, lambda s: s["end"]), F.greatest, F.lit(0))

        def cut(e: Column) -> Column:
            fresh = lambda s, k: (k == 0) | (s["start"] >= F.get(e, k - 1))
            firsts = F.filter(F.transform(own, lambda s, k: F.when(fresh(s, k), k)), lambda k: k.isNotNull())
            return bound(firsts, lambda f: F.transform(f, lambda k, i: F.struct(own[k]["start"].alias("start"), F.get(e, F.coalesce(F.get(f, i + 1), F.size(own)) - 1).alias("end"))))

        return bound(ends, cut)

    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return bound(plain, lambda own: F.when(F.size(own) == 0, F.array().cast(PLACES)).otherwise(places(own)))


def _cutter(chunks: Column) -> Callable[[Column, Column], Column]:
    """Function of (start, end) that gives that part of a text from its chunks."""

    def part(start: Column, end: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(held, start - first * PIECE + 1, end - start)).otherwise("")

    return part


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def outside(text: Column, places: Column) -> Column:
    """(start, value) of the parts of a text between disjoint places (start, end) in order, empty ones too."""

    def parts(p: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(p, lambda s: s["end"]))
        ends = F.concat(F.transform(p, lambda s: s["start"]), F.array(F.length(text)))
        cut = lambda c: F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("start"), _cutter(c)(b, e).alias("value")))
        return bound(_chunks(text), cut)

    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("value")))
    return bound(places, lambda p: F.when(F.size(p) == 0, whole).otherwise(parts(p)))


def rewrite(text: Column, spans: Column) -> Column:
    """text with each of the disjoint spans (start, end, new), in order, replaced by its new value."""

    def said(own: Column) -> Column:
        news = F.concat(F.transform(own, lambda s: s["new"]), F.array(F.lit("")))
        return F.array_join(F.zip_with(outside(text, own), news, lambda gap, new: F.concat(gap["value"], new)), "")

    return bound(spans, lambda own: F.when(F.size(own) == 0, text).otherwise(said(own)))
