"""Column functions of dense vectors, sparse codes and time context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def l2(v: Column) -> Column:
    """v of unit length."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


#: Slots of a session on the time axis, and the frequencies of its context.
SESSION_SCALE = 97
FREQUENCIES = tuple(1.0 / 8 ** (2 * i / 15) for i in range(16))


def theta(session: Column, position: Column, other_session: Column, other_position: Column) -> Column:
    """Similarity of two time contexts: the mean cosine of the phase differences, so that no context is stored."""
    apart = (SESSION_SCALE * session + position - SESSION_SCALE * other_session - other_position).cast("double")
    return sum((F.cos(apart * f) for f in FREQUENCIES), F.lit(0.0)) / len(FREQUENCIES)


def k_winners(v: Column, k: int) -> Column:
    """Places of the k largest values, ascending; ties go to the first place."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-x.cast("double")).alias("x"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda s: s["i"]))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two codes, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def match(a: Column, b: Column) -> Column:
    """Shared units over the geometric mean of the sizes, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b)))
