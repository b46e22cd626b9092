"""Many configurations of a read, judged in one pass over the candidates.

A configuration is a name and the weights of columns.  Candidates are made and normalised once; for each gold row one aggregate has a sum for
each configuration, of the candidates that stand before it, so candidates are neither multiplied by configurations nor sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluation


def grid(**axes: tuple[float, ...]) -> dict[str, dict[str, float]]:
    """Every combination of the axes' weights, by a name that tells them."""
    out: dict[str, dict[str, float]] = {"": {}}
    for column, values in axes.items():
        out = {f"{name} {column}={v}".strip(): weights | {column: v} for name, weights in out.items() for v in values}
    return out


def ranks(rows: DataFrame, gold: DataFrame, configs: dict[str, dict[str, float]], one: list[str], keys: list[str], factor: Column | None = None) -> DataFrame:
    """config, one, keys, rank of the gold rows (one, keys): by the weighted sum of columns times factor, rounded to 6 places, ties by keys."""
    total = lambda weights: reduce(lambda a, b: a + b, [w * F.col(c) for c, w in weights.items()])
    scores = [F.round(total(w) * (F.lit(1.0) if factor is None else factor), 6) for w in configs.values()]
    rows = rows.select(*one, *keys, F.array(*scores).alias("scores"))
    own = rows.join(gold.select(*one, *keys).distinct(), [*one, *keys], "left_semi").select(*one, *[F.col(c).alias(f"own_{c}") for c in keys], F.col("scores").alias("own"))
    not_after = F.struct(*keys) <= F.struct(*[f"own_{c}" for c in keys])
    before = [F.sum(((F.col("scores")[k] > F.col("own")[k]) | ((F.col("scores")[k] == F.col("own")[k]) & not_after)).cast("long")) for k in range(len(configs))]
    met = rows.join(own, one).groupBy(*one, *[f"own_{c}" for c in keys]).agg(F.array(*before).alias("ranks"))
    names = F.array(*[F.lit(n) for n in configs])
    return met.select(*one, *[F.col(f"own_{c}").alias(c) for c in keys], F.posexplode("ranks").alias("place", "rank")).select(names[F.col("place")].alias("config"), *one, *keys, "rank")


def judged(ranked: DataFrame, one: list[str], k: int, cut: int) -> DataFrame:
    """config, one, recall_all (at k), ndcg (at cut), objective (their mean): of all gold rows that are candidates."""
    rank = F.col("rank").cast("double")
    golds = F.count("*")
    got = ranked.groupBy("config", *one).agg(
        golds.alias("golds"), F.sum((rank <= k).cast("long")).alias("found"), F.sum(F.when(rank <= cut, evaluation.gain(rank, F.lit(1.0))).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("golds", F.lit(cut)).cast("int")), F.lit(0.0), lambda t, r: t + evaluation.gain(r.cast("double"), F.lit(1.0)))
    rows = got.select("config", *one, (F.col("found") == F.col("golds")).cast("double").alias("recall_all"), (F.col("dcg") / ideal).alias("ndcg"))
    return rows.withColumn("objective", (F.col("recall_all") + F.col("ndcg")) / 2)


def report(scores: DataFrame, split: Column) -> DataFrame:
    """config, dev, test (mean objectives), n_dev, n_test, chosen: the best on dev, of equals the first by name, is what test is read for."""
    part = lambda name: F.when(split == name, F.col("objective"))
    table = scores.groupBy("config").agg(F.avg(part("dev")).alias("dev"), F.avg(part("test")).alias("test"), F.count(part("dev")).alias("n_dev"), F.count(part("test")).alias("n_test"))
    best = table.agg(F.min(F.struct(-F.round(F.coalesce("dev", F.lit(-1.0)), 6), "config"))["config"].alias("best"))
    return table.join(F.broadcast(best)).withColumn("chosen", F.col("config") == F.col("best")).drop("best")


def ablations(scores: DataFrame, full: str, one: list[str]) -> DataFrame:
    """config, recall_all, ndcg, objective (means), less (mean of what it loses against the full one), worse and better (questions): paired by question."""
    base = scores.where(F.col("config") == full).select(*one, F.col("objective").alias("whole"))
    lost = F.col("whole") - F.col("objective")
    return scores.join(base, one).groupBy("config").agg(
        *[F.avg(c).alias(c) for c in ("recall_all", "ndcg", "objective")], F.avg(lost).alias("less"),
        F.sum((lost > 1e-9).cast("long")).alias("worse"), F.sum((lost < -1e-9).cast("long")).alias("better"))
