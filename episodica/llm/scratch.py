"""Tables between the steps of an operator, in the folder that the cluster shares, and joins with facts about keys that may be hot."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shared_folder

#: A key is hot if it has more than this share of the rows: fewer than its inverse are.
HOT = 1 / 1000


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting, put back when the block ends."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables of one run of an operator: written tables cut lineage, outlive executors, and go when the run says so."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = os.path.join(shared_folder(spark), f"scratch-{uuid.uuid4().hex}")
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of df, written and read again.  The write's shuffle files go when it ends, not when the driver collects garbage."""
        path = f"{self.folder}/{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete what keep() wrote for these frames; others are left alone."""
        for frame in frames:
            if frame is not None and id(frame) in self._paths:
                remove(self.spark, self._paths[id(frame)][1])
                self._paths[id(frame)] = (frame, "")

    def only(self, *frames: DataFrame) -> None:
        """Delete all but these frames."""
        kept = {id(f) for f in frames}
        for key, (_, path) in self._paths.items():
            if path and key not in kept:
                remove(self.spark, path)
                self._paths[key] = (self._paths[key][0], "")


def beside(rows: DataFrame, facts: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows with what facts (key, n and others; a row a key; n: the rows of the key) tell of their key; null where it tells nothing.
    Keys are whole numbers.

    A key of more than HOT of all ``total`` rows is one of fewer than 1 / HOT, so these facts go to all tasks; the other rows meet
    theirs by a shuffle in which no key is large.  A null key has no facts."""
    others = [c for c in facts.columns if c != key]
    packed = facts.select(F.col(key).alias("_key"), F.struct(*others).alias("_fact"), (F.col(n) > total * HOT).alias("_is_hot"))
    hot = F.broadcast(packed.where("_is_hot").select(F.col("_key").alias(key), F.col("_fact").alias("_hot")))
    cold = packed.where("NOT _is_hot").select(F.col("_key").alias("_at"), "_fact")
    met = rows.join(hot, key, "left")
    met = met.withColumn("_at", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])))
    fact: Callable[[str], Column] = lambda c: F.coalesce(F.col("_hot"), F.when(F.col(key).isNotNull(), F.col("_fact")))[c].alias(c)
    return met.join(cold, "_at", "left").select(*[F.col(f"`{c}`") for c in rows.columns], *[fact(c) for c in others])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of some nodes as stars: (node, least node of its component), without the least themselves."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        # a node's label is a node of its component: what that one knows, the node takes over
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[moved], nodes[least[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(*[c.to_numpy(zero_copy_only=False) for c in batch.columns])], ["u", "v"])


def _is_stars(edges: DataFrame) -> bool:
    """Does each node have one edge, to a node that has none?"""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the nodes of the links (a, b) that are not the least of their component, which root is; a table of scratch.

    Each task makes stars of what links it holds; then large-star and small-star steps, each a table that replaces the one before, until
    there are only stars."""
    edges = scratch.keep(links.select("a", "b").where("a <> b").mapInArrow(_contract, "u long, v long").distinct())
    while not _is_stars(edges):
        total = 2 * edges.count()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # the least node of a large component has many edges, so it is met as a hot key
        large = beside(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = beside(large, low, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        scratch.drop(edges)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
