"""Normalising and fusing the scores of pathways, over a question's candidates.

Ranges, means and spreads are aggregates of partial sums, joined back to the candidates: only reciprocal ranks sort them.  A null
score counts as none of the range, and as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges and spreads that count as none.
FLAT, STEADY = 1e-6, 1e-9


def reciprocal(score: str, ties: list[str], by: Sequence[str] = ("qid",), k: float = 60.0) -> Column:
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.desc(F.round(score, 9)), *ties))
    return F.when(F.max(score).over(w) - F.min(score).over(w) < FLAT, 0.0).otherwise(1 / (k + rank))


def normalised(scores: DataFrame, parts: list[str], how: str, ties: list[str], k: float = 60.0, by: Sequence[str] = ("qid",)) -> DataFrame:
    """scores with <part>_n for each part: between 0 and 1, or standard scores, or reciprocal ranks; 0 where all are the same."""
    if how not in ("minmax", "zscore", "rrf"):
        raise ValueError(how)
    if how == "rrf":
        return scores.withColumns({f"{p}_n": F.coalesce(F.when(F.col(p).isNotNull(), reciprocal(p, ties, by, k)), F.lit(0.0)) for p in parts})
    low, high = (F.min, F.max) if how == "minmax" else (F.avg, F.stddev_pop)
    sums = scores.groupBy(*by).agg(*[x for p in parts for x in (low(p).alias(f"{p}_a"), high(p).alias(f"{p}_b"))])

    def value(p: str) -> Column:
        a, b = F.col(f"{p}_a"), F.col(f"{p}_b")
        out = F.when(b - a >= FLAT, (F.col(p) - a) / (b - a)) if how == "minmax" else F.when(b >= STEADY, (F.col(p) - a) / b)
        return F.coalesce(out, F.lit(0.0))

    return scores.join(sums, list(by)).withColumns({f"{p}_n": value(p) for p in parts}).drop(*sums.columns[len(by) :])


def fused(scores: DataFrame, parts: dict[str, float], how: str, ties: list[str], k: float = 60.0, by: Sequence[str] = ("qid",), always: Sequence[str] = ()) -> DataFrame:
    """scores with <part>_n for each part of a weight above 0 (or always) and their weighted sum, total; sums of standard scores are moved
    so that the least is 0."""
    used = {p: w for p, w in parts.items() if w > 0 or p in always}
    out = normalised(scores, list(used), how, ties, k, by).withColumn("total", sum((w * F.col(f"{p}_n") for p, w in used.items()), F.lit(0.0)))
    if how == "zscore":
        least = out.groupBy(*by).agg(F.min("total").alias("least"))
        out = out.join(least, list(by)).withColumn("total", F.col("total") - F.col("least")).drop("least")
    return out


def hybrid_rrf(ranked: list[DataFrame], keys: list[str], pool: int, k: float = 60.0) -> DataFrame:
    """(qid, keys, score): reciprocal ranks, summed over the first ``pool`` of each ranking."""
    parts = [r.where(F.col("rank") <= pool).select("qid", *keys, (1 / (k + F.col("rank"))).alias("s")) for r in ranked]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("qid", *keys).agg(F.sum("s").alias("score"))
