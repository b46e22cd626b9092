"""Completion: stored codes as attractors of a softmax over overlaps.

A store's patterns are one matrix; cues settle in blocks, as products of a block of states with that matrix.  A store's cues are dealt over
tasks, and a task keeps no softmax beyond its block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import StoreConfig

#: Cues that settle together; rounds at most.
BLOCK, ROUNDS = 256, 8
#: Cues of a task; a multiple of BLOCK, so that cues settle with the same others however many there are.
CUES = 8 * BLOCK


@dataclass
class Completion:
    """Where a cue led: number of the pattern (-1: none is stored), rounds, share of the softmax, whether nothing changed any more, the
    softmax over all patterns, and the energy of each round."""

    index: int
    steps: int
    confidence: float
    converged: bool
    weights: np.ndarray
    energy: list[float]


class Patterns:
    """Codes of a store.  A pattern that is removed keeps its number and is empty."""

    def __init__(self, codes: list[np.ndarray], dim: int):
        self.codes, self.dim = [np.asarray(c, np.int64) for c in codes], dim
        self.matrix = self._states(self.codes)

    def _states(self, codes: list[np.ndarray]) -> np.ndarray:
        """Codes as rows of unit length."""
        out = np.zeros((len(codes), self.dim), np.float32)
        sizes = np.array([len(c) for c in codes], np.int64)
        if sizes.sum():
            out[np.repeat(np.arange(len(codes)), sizes), np.concatenate(codes)] = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
        return out

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def resident(self) -> int:
        return sum(len(c) > 0 for c in self.codes)

    def remove(self, index: int) -> None:
        self.codes[index] = self.codes[index][:0]
        self.matrix[index] = 0

    def similarity(self, cues: list[np.ndarray], prior: np.ndarray | float = 0.0) -> np.ndarray:
        """Overlap of each cue with each pattern, without settling."""
        return self._states([np.asarray(c, np.int64) for c in cues]) @ self.matrix.T + prior

    def settle(self, cues: list[np.ndarray], beta: float, k: list[int] | None = None, prior: np.ndarray | float = 0.0, weights: bool = True) -> list[Completion]:
        """The completion of each cue to codes of k units (as many as the cue has).  weights: keep the softmax of each, a number for a pattern."""
        sizes = k or [max(len(c), 1) for c in cues]
        if not len(self):
            return [Completion(-1, 0, 0.0, False, np.zeros(0), []) for _ in cues]
        out: list[Completion] = []
        for start in range(0, len(cues), BLOCK):
            out += self._block([np.asarray(c, np.int64) for c in cues[start : start + BLOCK]], sizes[start : start + BLOCK], beta, prior, weights)
        return out

    def _block(self, cues: list[np.ndarray], sizes: list[int], beta: float, prior: np.ndarray | float, weights: bool) -> list[Completion]:
        results: dict[int, Completion] = {}
        energies: list[list[float]] = [[] for _ in cues]
        moving, states, before = np.arange(len(cues)), self._states(cues), [None] * len(cues)
        for step in range(1, ROUNDS + 1):
            soft = states @ self.matrix.T
            soft *= beta
            soft = soft + prior if np.any(prior) else soft
            soft -= soft.max(axis=1, keepdims=True)
            np.exp(soft, out=soft)
            total = soft.sum(axis=1)
            soft /= total[:, None]
            energy = -np.log(total) / beta - 0.5 * (states * states).sum(axis=1)
            blend = soft @ self.matrix
            codes = []
            for row, i in zip(blend, moving, strict=True):
                first = np.argpartition(-row, sizes[i] - 1)[: sizes[i]] if sizes[i] < self.dim else np.arange(self.dim)
                codes.append(np.sort(first[row[first] > 0]))
            stay = []
            for n, i in enumerate(moving):
                energies[i].append(float(energy[n]))
                same = before[i] is not None and np.array_equal(before[i], codes[n])
                if same or step == ROUNDS:
                    results[i] = Completion(int(soft[n].argmax()), step, float(soft[n].max()), same, soft[n].copy() if weights else np.zeros(0), energies[i])
                else:
                    before[i] = codes[n]
                    stay.append(n)
            if not stay:
                break
            moving, states = moving[stay], self._states([codes[n] for n in stay])
        return [results[i] for i in range(len(cues))]


def part_of(code: np.ndarray, keep: float, seed: list[int]) -> np.ndarray:
    """A seeded part of a code, one unit at least."""
    return np.random.default_rng(seed).choice(code, max(1, round(keep * len(code))), replace=False)


def completion(coded: DataFrame, config: StoreConfig, units: int, keep: float = 0.15) -> DataFrame:
    """(store_id, seq, code of so many units) to the pattern that a seeded part of each code leads to, with its evidence."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("nth", kind="stable").reset_index(drop=True)
        patterns = Patterns(list(frame["code"]), units)
        own = np.nonzero(frame["own"] == frame["block"])[0]
        cues = [part_of(patterns.codes[n], keep, [config.seed, int(n)]) for n in own]
        got = patterns.settle(cues, config.beta, [max(len(patterns.codes[n]), 1) for n in own], weights=False)
        seq = frame["seq"].to_numpy()
        winner = seq[[x.index for x in got]]
        return pd.DataFrame({
            "store_id": frame["store_id"].iloc[own].to_numpy(), "seq": seq[own], "winner": winner, "correct": winner == seq[own], "steps": [x.steps for x in got], "confidence": [x.confidence for x in got],
            "converged": [x.converged for x in got], "energy": [x.energy[-1] for x in got], "units_kept": [len(c) for c in cues], "units_total": [len(patterns.codes[n]) for n in own],
        })

    schema = "store_id long, seq long, winner long, correct boolean, steps int, confidence double, converged boolean, energy double, units_kept int, units_total int"
    store = Window.partitionBy("store_id")
    rows = coded.where("size(code) > 0").select("store_id", "seq", "code", (F.row_number().over(store.orderBy("seq")) - 1).alias("nth"), F.count("*").over(store).alias("n"))
    rows = rows.withColumn("own", F.floor(F.col("nth") / CUES).cast("int"))
    # each block of cues meets all patterns of its store
    every = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CUES).cast("int")))).drop("n")
    return every.groupBy("store_id", "block").applyInPandas(settle, schema)


def capacity_probe(coded: DataFrame, config: StoreConfig, units: int, corruption: float = 0.5) -> DataFrame:
    """store_id, patterns, recovered: the share of a store's codes that come back after so many of their units are deleted."""
    got = completion(coded, config, units, keep=1 - corruption)
    return got.groupBy("store_id").agg(F.count("*").alias("patterns"), F.avg(F.col("correct").cast("double")).alias("recovered"))
