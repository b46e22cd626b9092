"""Terms, pairs and longer combinations of terms that stand close to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_terms
from .index import counted

JOIN = "|"


def _after(terms: Column, i: Column, window: int | None) -> Column:
    """Terms behind place i (from 0) within the window."""
    return F.slice(terms, i + 2, F.size(terms) if window is None else F.lit(window - 1))


def combinations(terms: Column, order: int = 2, window: int | None = 4) -> Column:
    """All units of a text as joined, sorted terms, with repeats: no shuffle, one array a row.

    A unit of several terms opens at a term and takes others, all different, from those within the window behind it.
    """

    def longer(chosen: list[Column], rest: Column, left: int) -> Column:
        """Units that go on from the chosen terms with up to ``left`` of the rest, in order."""
        here = F.transform(rest, lambda v: F.array_join(F.array_sort(F.array(*chosen, v)), JOIN))
        if left == 1:
            return here
        after = lambda v, j: F.filter(F.slice(rest, j + 2, F.size(rest)), lambda x: x != v)
        return F.concat(here, F.flatten(F.transform(rest, lambda v, j: longer([*chosen, v], after(v, j), left - 1))))

    if order < 2:
        return terms
    opened = lambda w, i: longer([w], F.filter(_after(terms, i, window), lambda v: v != w), order - 1)
    return F.concat(terms, F.flatten(F.transform(terms, opened)))


def unit_counts(texts: DataFrame, keys: list[str], order: int = 2, window: int | None = 4, sized: bool = False) -> DataFrame:
    """keys, u, tf, length (terms of the text, repeats included); a row of texts is one document, and nothing is shuffled.  sized: with units,
    how many different units the text has."""
    if order < 1 or (window is not None and window < 2):
        raise ValueError("order must be 1 or more, window 2 or more")
    rows = texts.select(*keys, content_terms(F.col("text")).alias("terms"))
    c = counted(combinations(F.col("terms"), order, window))
    if sized:
        # outer, as a filter of empty ones would make the units again
        rows = rows.select(*keys, F.size("terms").cast("long").alias("length"), c.alias("all")).select(*keys, "length", F.size("all").cast("long").alias("units"), F.explode_outer("all").alias("c"))
        return rows.where("c IS NOT NULL").select(*keys, "c.u", "c.tf", "length", "units")
    rows = rows.select(*keys, F.size("terms").cast("long").alias("length"), F.explode(c).alias("c"))
    return rows.select(*keys, "c.u", "c.tf", "length")


def unit_sets(texts: DataFrame, keys: list[str], order: int = 2, window: int | None = 4) -> DataFrame:
    """keys, units: the distinct units of each text."""
    # terms are a column of their own, so that they are made once and not for each place in them
    rows = texts.select(*keys, content_terms(F.col("text")).alias("terms"))
    return rows.select(*keys, F.array_distinct(combinations(F.col("terms"), order, window)).alias("units"))


def unit_rows(texts: DataFrame, keys: list[str], order: int = 2, window: int | None = 4) -> DataFrame:
    """keys, u: the distinct units of each text, a row each."""
    rows = texts.select(*keys, content_terms(F.col("text")).alias("terms"))
    # exploded where they are made: from a column of units a filter of empty ones would be inferred, which makes them, and terms, again
    return rows.select(*keys, F.explode(F.array_distinct(combinations(F.col("terms"), order, window))).alias("u"))
