"""Exact dense top-k without scoring every vector: vectors in cells with radii, and cells that stay closed when a bound excludes them.

build() chooses up to CELLS centroids (a bounded sample by hash, then ROUNDS of k-means over all vectors) and writes vectors by cell, and for each
store and cell its radius and size.  A vector x of a cell with centroid c and radius r has q.x <= q.c + |q| r.  top() scores the
cells with the largest bounds until they hold k vectors; the k-th best score there is a threshold, and of the other cells only those whose
bound reaches it are opened.  The result is that of scoring all; how much is read depends on how well the vectors cluster (share()).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dense

#: Centroids at most (with PARTS, what a task's closure and the driver hold); rounds of k-means; folders that cells are dealt into.
CELLS, ROUNDS, PARTS = 1024, 2, 64
#: How far rounding can lift a score above its bound, or a rank.
SLACK = 2e-6


def _matrix(frame: pd.Series) -> np.ndarray:
    return np.stack(frame.to_numpy()).astype(np.float64) if len(frame) else np.zeros((0, 0))


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and its distance from the centroid."""
    near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


class Cells:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def build(self, rows: DataFrame, keys: list[str]) -> Cells:
        """Write the vectors (store_id, keys, v) in cells.  Rows without a vector are left out."""
        rows = rows.where("v IS NOT NULL").select("store_id", *keys, F.col("v").cast("array<double>").alias("v"))
        n = min(CELLS, max(1, math.isqrt(rows.count())))
        sample = rows.orderBy(F.xxhash64("store_id", *keys), "v").limit(n).collect()
        centroids = _matrix(pd.Series([r["v"] for r in sample], dtype=object))
        for _ in range(ROUNDS if len(centroids) else 0):
            centroids = self._moved(rows, centroids)
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>").write.parquet(f"{self.folder}/centroids")

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                if len(frame):
                    cell, apart = _nearest(_matrix(frame["v"]), centroids)
                    yield frame.assign(cell=cell.astype(np.int32), apart=apart)

        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", cell int, apart double"
        made = rows.mapInPandas(assign, schema).withColumn("part", F.col("cell") % PARTS)
        # a table of no rows is one file with a schema, which folders alone would not have
        write = made.hint("rebalance", "part").write
        (write.partitionBy("part") if len(centroids) else write).parquet(f"{self.folder}/vectors")
        self._read("vectors").groupBy("store_id", "cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).write.parquet(f"{self.folder}/cells")
        return self

    @staticmethod
    def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
        """A round of k-means: partial sums in each task, len(centroids) rows to the driver."""
        k, d = centroids.shape

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, count = np.zeros((k, d)), np.zeros(k, np.int64)
            for frame in batches:
                if len(frame):
                    x = _matrix(frame["v"])
                    cell = _nearest(x, centroids)[0]
                    np.add.at(total, cell, x)
                    count += np.bincount(cell, minlength=k)
            yield pd.DataFrame({"cell": np.arange(k), "n": count, "s": list(total)})

        made = rows.select("v").mapInPandas(sums, "cell int, n long, s array<double>").where("n > 0")
        added = made.select("cell", "n", F.posexplode("s").alias("i", "x")).groupBy("cell", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        out = centroids.copy()
        for r in added.collect():
            out[r["cell"], r["i"]] = r["x"] / r["n"]
        return out

    def bounds(self, questions: DataFrame) -> DataFrame:
        """store_id, qid, cell, n, bound: the most that a question (store_id, qid, v) can score in each cell of its store."""
        rows = sorted(self._read("centroids").collect(), key=lambda r: r["cell"])
        centroids = _matrix(pd.Series([r["centroid"] for r in rows], dtype=object))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for start in range(0, len(frame), 512):
                    part = frame.iloc[start : start + 512]
                    q = _matrix(part["v"])
                    near = q @ centroids.T
                    k = near.shape[1]
                    yield pd.DataFrame({"store_id": np.repeat(part["store_id"].to_numpy(), k), "qid": np.repeat(part["qid"].to_numpy(), k), "cell": np.tile(np.arange(k, dtype=np.int32), len(part)), "near": near.ravel(), "size": np.repeat(np.sqrt((q * q).sum(1)), k)})

        if not len(centroids):
            return self.spark.createDataFrame([], "store_id long, qid long, cell int, n long, bound double")
        near = questions.where("v IS NOT NULL").select("store_id", "qid", F.col("v").cast("array<double>").alias("v")).mapInPandas(run, "store_id long, qid long, cell int, near double, size double")
        bound = F.col("near") + F.col("size") * F.col("radius") + SLACK
        return near.join(self._read("cells"), ["store_id", "cell"]).select("store_id", "qid", "cell", "n", bound.alias("bound"))

    @staticmethod
    def _first(bounds: DataFrame, k: int) -> DataFrame:
        """The cells with the largest bounds of each question, until they hold k vectors."""
        w = Window.partitionBy("store_id", "qid").orderBy(F.desc("bound"), "cell")
        before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return bounds.withColumn("before", before).where(F.col("before") < k).drop("before")

    def _scored(self, questions: DataFrame, opened: DataFrame, keys: list[str], k: int) -> DataFrame:
        """store_id, qid, keys, score: of the opened cells' vectors, at least each question's k best."""
        place: Column = (F.col("store_id") * CELLS + F.col("cell")).alias("place")
        parts = [r[0] for r in opened.select((F.col("cell") % PARTS).alias("part")).distinct().collect()]
        rows = self._read("vectors").where(F.col("part").isin(parts)).select(place, "store_id", *keys, "v")
        asked = questions.select("store_id", "qid", "v").join(opened.select("store_id", "qid", "cell"), ["store_id", "qid"]).select(place, "qid", "v")
        got = dense.products(rows.drop("store_id").withColumnRenamed("place", "store_id"), asked.withColumnRenamed("place", "store_id"), keys, k)
        return got.withColumn("store_id", F.floor(F.col("store_id") / CELLS))

    def top(self, questions: DataFrame, keys: list[str], k: int) -> DataFrame:
        """store_id, qid, keys, score, rank: the k best vectors of each question's (store_id, qid, v) store; ties by keys."""
        bounds = self.bounds(questions)
        first = self._ranked(self._scored(questions, self._first(bounds, k), keys, k), keys, k)
        return self._ranked(self._scored(questions, self._able(bounds, first, k), keys, k), keys, k)

    @staticmethod
    def _able(bounds: DataFrame, first: DataFrame, k: int) -> DataFrame:
        """The cells that can hold one of a question's k best, given k candidates."""
        least = first.groupBy("store_id", "qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        return bounds.join(least, ["store_id", "qid"], "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).drop("least")

    @staticmethod
    def _ranked(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("store_id", "qid").orderBy(F.desc(F.round("score", 6)), *keys))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)

    def share(self, questions: DataFrame, keys: list[str], k: int) -> float:
        """Of the products of questions and vectors of their stores, the share that top() takes."""
        bounds = self.bounds(questions)
        first = self._ranked(self._scored(questions, self._first(bounds, k), keys, k), keys, k)
        able = self._able(bounds, first, k)
        opened, every = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (able, bounds))
        return opened / max(every, 1)
