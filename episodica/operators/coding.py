"""Sparse codes of dense vectors: winners of a random projection, biased towards units that were used little.

Codes of one store depend on the order of its writes, so a store is a fold; stores are independent.  The product with the projection
does not depend on the order and is taken for all vectors of a block at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import StoreConfig
from . import dense
from .folds import per_store

#: Vectors whose activations are held at once.
BLOCK = 512


def projection(dim: int, out: int, seed: int) -> np.ndarray:
    """Weights of mean 0 and variance 1, two thirds of them 0."""
    return (np.random.default_rng(seed).choice([-1.0, 0.0, 0.0, 0.0, 0.0, 1.0], (dim, out)) * 3**0.5).astype(np.float32)


def bias(usage: np.ndarray, gain: float) -> np.ndarray:
    """Factors above 1 for units that were used less than the mean, below 1 for others."""
    mean = float(usage.mean())
    return 1 + gain * np.tanh((mean - usage) / (mean + 1e-6)) if gain > 0 and mean > 0 else np.ones(len(usage))


class Coder:
    """What the codes of a store need: weights, and how often each unit has won."""

    def __init__(self, dim: int, config: StoreConfig, inhibition: float = 0.0):
        self.out = dim * config.expansion
        self.winners = max(1, round(self.out * config.sparsity))
        self.weights, self.gain, self.inhibition = projection(dim, self.out, config.seed), config.neurogenesis, inhibition
        self.lengths = np.maximum(np.linalg.norm(self.weights, axis=0), 1e-6)
        self.usage = np.zeros(self.out)

    def _spread(self, act: np.ndarray) -> np.ndarray:
        """Winners one by one, each of which lowers units with similar weights; only the winners' similarities are computed."""
        left, code = act.astype(np.float64), []
        while len(code) < self.winners:
            code.append(int(np.argmax(left)))
            alike = (self.weights.T @ self.weights[:, code[-1]]) / (self.lengths * self.lengths[code[-1]])
            alike[code[-1]] = 0
            left -= self.inhibition * np.maximum(alike, 0)
            left[code] = -np.inf
        return np.array(code)

    def codes(self, vectors: np.ndarray, learn: bool) -> np.ndarray:
        """A row of ascending units for each vector, in order."""
        rows = np.empty((len(vectors), self.winners), np.int32)
        for start in range(0, len(vectors), BLOCK):
            for n, act in enumerate(np.asarray(vectors[start : start + BLOCK], np.float32) @ self.weights, start):
                act = act * bias(self.usage, self.gain)
                rows[n] = np.sort(self._spread(act) if self.inhibition else np.argpartition(-act, self.winners - 1)[: self.winners])
                if learn:
                    self.usage[rows[n]] += 1
        return rows


def codes(rows: DataFrame, config: StoreConfig, inhibition: float = 0.0) -> DataFrame:
    """(store_id, seq, v) to store_id, seq, code: each write's winners bias the next write's."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(frame["v"].to_numpy())
        return frame[["store_id", "seq"]].assign(code=list(Coder(v.shape[1], config, inhibition).codes(v, learn=True)))

    return per_store(rows, fold, "store_id long, seq long, code array<int>")


def overlaps(rows: DataFrame, questions: DataFrame, keys: list[str], units: int) -> DataFrame:
    """store_id, qid, keys, n: how many of so many units each question's code (store_id, qid, v) shares with a row's (store_id, keys, v), where
    any: products of blocks of zeros and ones, so that no unit gathers the codes that hold it."""

    def form(codes: pd.Series) -> np.ndarray:
        out = np.zeros((len(codes), units), np.float32)
        out[np.repeat(np.arange(len(codes)), codes.map(len)), np.concatenate(codes.to_numpy()).astype(np.int64)] = 1
        return out

    def run(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        q, r = np.nonzero(s)
        return a.iloc[r][["store_id", *keys]].reset_index(drop=True).assign(qid=b["qid_"].to_numpy()[q], n=s[q, r].astype(np.int64))

    kinds = dict(rows.dtypes)
    schema = "store_id long, qid long, " + ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n long"
    return dense.pairs(rows, questions, keys, run, schema, form, per=(dense.ROWS, dense.HELD))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Shared units over all units of two codes."""
    return len(np.intersect1d(a, b)) / max(len(np.union1d(a, b)), 1)


def separation(coder: Coder, a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Cosine of two vectors, overlap of their codes, and the one over the other (0 for a cosine of 0)."""
    cosine = float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    shared = overlap(*coder.codes(np.stack([a, b]), learn=False))
    return {"input_cosine": cosine, "output_overlap": shared, "ratio": shared / cosine if cosine > 1e-6 else 0.0}


def code_stats(coded: DataFrame, units: int) -> DataFrame:
    """used, coverage, gini of how often each of so many units stands in codes (column code), over all codes."""
    times = coded.select(F.explode(F.col("code").cast("array<int>")).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    every = coded.sparkSession.range(units).select(F.col("id").cast("int").alias("unit")).join(times, "unit", "left").select("unit", F.coalesce("n", F.lit(0)).alias("n"))
    upto = Window.orderBy("n", "unit").rowsBetween(Window.unboundedPreceding, 0)  # a row for each unit: as many as the store's settings say
    running = every.withColumn("c", F.sum("n").over(upto))
    used = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).cast("long")
    return running.agg(used.alias("used"), (used / units).alias("coverage"), ((units + 1 - 2 * F.sum("c") / F.sum("n")) / units).alias("gini"))
