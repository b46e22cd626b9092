"""Centroid clustering (13): k-means with Yinyang grouping, on exact whole numbers.

Vectors become integers floor(SCALE * x); centroids start as the k vectors whose ids hash least.  The centroids are put into groups once,
by a few rounds of k-means among themselves.  Each vector keeps, beside its cluster, an upper bound of the distance to its own centroid
and one lower bound for each group, of the distance to that group's other centroids.  When centroids have moved, bounds move by what
their centroids moved:

* global filter: if the upper bound is below all lower bounds, the vector stays where it is, and no distance is taken;
* group filter: of the others, after the upper bound is made exact, only groups whose lower bound it does not stay below are looked at;
* in those, centroids whose own bound (the group's bound before the largest move, less the centroid's move) excludes them are skipped,
  and the surviving ones are scanned exactly.

Filters hold with a margin above the rounding of square roots, and scans compare whole numbers, so ties go to the smaller number and each round equals
that of plain k-means.  A round is one pass over the vectors: it writes vectors, clusters and bounds as a table, with each task's partial
sums in the same files, and the table before is deleted.  Only k x dims sums reach the driver.

Defined results: vectors with another number of components, or with a null or non-finite one, are left out; so are null vectors; rows that share
an id are vectors of their own (a null id hashes as no digits); of equal hashes the vector that is first in order goes first; fewer than k
vectors give fewer centroids; components beyond 2**27 after scaling count as 2**27, so that distances fit 64 bits; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

DIMS, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Centroids to a group, about; rounds of the grouping; largest component.
IN_GROUP, GROUPING, MOST = 3, 5, 1 << 27
#: What bounds give way, beyond any rounding of a square root or of a sum of them.
MARGIN = 1e-9
#: Vectors that are worked on at a time.
CHUNK = 8192


def _kept(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, v: whole components of the vectors that have all of theirs."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where((F.size("embedding") == dims) & finite)
    whole = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(-float(MOST)))), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return rows.select("vec_id", whole.alias("v"))


def _first(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids hash least."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    top = rows.withColumn("digest", digest).orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in sorted(top, key=lambda r: (r["digest"], r["v"]))], np.int64)


def groups(centroids: np.ndarray, n: int) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means among them, from the first n."""
    x = centroids.astype(float)
    mean = x[:n].copy()
    of = np.zeros(len(x), np.int64)
    for _ in range(GROUPING):
        of = ((x[:, None] - mean[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (of == g).any():
                mean[g] = x[of == g].mean(0)
    return of


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def _low(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 - MARGIN)


def _high(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 + MARGIN)


class Round:
    """One assignment of vectors to centroids, given what the last one knew.  before: the centroids of that one, or none."""

    def __init__(self, centroids: np.ndarray, of: np.ndarray, before: np.ndarray | None):
        self.centroids, self.of, self.n_groups = centroids, of, int(of.max()) + 1
        if before is not None:
            self.moved = _high(((centroids - before) ** 2).sum(1))
            self.most = np.array([self.moved[of == g].max(initial=0.0) for g in range(self.n_groups)])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper, lower and the number of distances taken, from all distances."""
        d = np.stack([_square(x, c) for c in self.centroids], 1)
        cluster = d.argmin(1)
        rows = np.arange(len(x))
        upper = _high(d[rows, cluster])
        low = _low(d)
        low[rows, cluster] = np.inf
        lower = np.stack([low[:, self.of == g].min(1, initial=np.inf) for g in range(self.n_groups)], 1)
        return cluster, upper, lower, d.size

    def next(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the last assignment's, by the filters."""
        cluster, upper = cluster.copy(), (upper + self.moved[cluster]) * (1 + MARGIN)
        before = lower
        lower = (before - self.most) * (1 - MARGIN * np.sign(before - self.most))
        taken = 0
        rows = np.flatnonzero(upper >= lower.min(1))
        if len(rows):
            own = _square(x[rows], self.centroids[cluster[rows]])
            taken += len(rows)
            upper[rows] = _high(own)
            on = upper[rows] >= lower[rows].min(1)
            rows, own = rows[on], own[on]
        if not len(rows):
            return cluster, upper, lower, taken
        x = x[rows]
        old, best, squared = cluster[rows].copy(), cluster[rows].copy(), own.copy()
        #: lower bounds or distances of every centroid that was looked at, by vector
        known = np.full((len(rows), len(self.centroids)), np.inf)
        known[np.arange(len(rows)), old] = _low(own)
        looked = upper[rows, None] >= lower[rows]
        for j in range(len(self.centroids)):
            here = np.flatnonzero(looked[:, self.of[j]] & (old != j))
            bound = before[rows[here], self.of[j]] - self.moved[j]
            bound *= 1 - MARGIN * np.sign(bound)
            known[here, j] = bound
            scan = here[bound <= _high(squared[here])]
            d = _square(x[scan], self.centroids[j])
            taken += len(scan)
            known[scan, j] = _low(d)
            better = (d < squared[scan]) | ((d == squared[scan]) & (j < best[scan]))
            best[scan[better]], squared[scan[better]] = j, d[better]
        others = known.copy()
        others[np.arange(len(rows)), best] = np.inf
        for g in range(self.n_groups):
            least = others[:, self.of == g].min(1, initial=np.inf)
            # a group that was not looked at keeps its bound, but for the centroid that the vector leaves
            lower[rows, g] = np.where(looked[:, g], least, np.minimum(lower[rows, g], least))
        cluster[rows], upper[rows] = best, _high(squared)
        return cluster, upper, lower, taken


_STATE = "vec_id long, v binary, cluster int, upper double, lower array<double>, part int, n long, taken long, sums array<long>"


def _assigned(rows: DataFrame, step: Round, dims: int) -> DataFrame:
    """State rows, and for each task and cluster a row of partial sums (part: the cluster)."""
    fresh = "upper" not in rows.columns
    k, names = len(step.centroids), [c.split()[0] for c in _STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, taken = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                if fresh:
                    x = batch.column("v").flatten().to_numpy().astype(np.int32).reshape(-1, dims)
                    held = pa.array([r.tobytes() for r in x], pa.binary())
                    cluster, upper, lower, done = step.first(x)
                else:
                    held = batch.column("v")
                    x = np.frombuffer(b"".join(held.to_pylist()), np.int32).reshape(-1, dims)
                    state = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper")]
                    lower = batch.column("lower").flatten().to_numpy().reshape(len(x), -1)
                    cluster, upper, lower, done = step.next(x, *state, lower)
                taken += done
                counts += np.bincount(cluster, minlength=k)
                for j in np.unique(cluster):
                    sums[j] += x[cluster == j].sum(0, dtype=np.int64)
                none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
                bounds = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * step.n_groups, lower.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), held, pa.array(cluster.astype(np.int32)), pa.array(upper), bounds, *none], names)
        none = [pa.nulls(k, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.list_(pa.float64()))]
        partial = [pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), pa.array([taken, *[0] * (k - 1)]), pa.array(sums.tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, *partial], names)

    return rows.mapInArrow(run, _STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Floors of the exact means (a centroid of no vector stays), and how many distances were taken."""
    cells = state.where("part IS NOT NULL").select("part", "n", "taken", F.posexplode("sums").alias("place", "s"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out, taken = centroids.copy(), 0
    for r in cells.groupBy("part", "place").agg(F.sum("n").alias("n"), wide("s").alias("s"), F.sum("taken").alias("taken")).collect():
        if r["n"]:
            out[r["part"], r["place"]] = int(r["s"]) // r["n"]
        taken += r["taken"] if r["place"] == 0 else 0
    return out, taken


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, told: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: one row per kept vector.

    told: takes the number of distances that each assignment took."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = _kept(vectors, dims, scale)
    centroids = _first(rows, k, seed)
    if not len(centroids):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    of, before, state = groups(centroids, -(-len(centroids) // IN_GROUP)), None, None
    for _ in range(rounds):
        now = scratch.keep(_assigned(rows if state is None else state.where("part IS NULL"), Round(centroids, of, before), dims))
        scratch.drop(state)
        state, before = now, centroids
        centroids, taken = _means(state, centroids)
        if told is not None:
            told.append(taken)
    last = _assigned(rows if state is None else state.where("part IS NULL"), Round(centroids, of, before), dims).where("part IS NULL")
    final = centroids

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(-1, dims)
            own = batch.column("cluster").to_numpy(zero_copy_only=False)
            distance = np.concatenate([np.zeros(0, np.int64), *[_square(x[s : s + CHUNK], final[own[s : s + CHUNK]]) for s in range(0, len(x), CHUNK)]])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = scratch.keep(last.select("vec_id", "v", "cluster").mapInArrow(measured, "vec_id long, cluster int, distance long"))
    scratch.only(out)
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, final[j].tolist())).encode()).hexdigest()) for j, s in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
