"""Consolidation: bursts of replay move what traces have in common into schemas, and make room in the store.

A store's traces are one table of columns.  A burst is three selections from it (urgent traces, those that followed them, and some old
ones), whose union with repeats is replayed: counts and strengths are updated for the whole set, and the schemas take the rows in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import StoreConfig
from .folds import per_store

#: Exemplars of a schema, what a replay adds to a trace's strength, power of the priorities.
EXEMPLARS, REFRESH, SHARPNESS = 8, 0.15, 0.7


@dataclass
class Schemas:
    """Clusters of unit vectors: a vector joins the nearest centroid at or above the threshold, or founds a cluster."""

    threshold: float
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    mass: list[float] = field(default_factory=list)
    support: list[list[int]] = field(default_factory=list)
    exemplars: list[list[str]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.mass)

    def absorb(self, v: np.ndarray, key: int, text: str, weight: float) -> bool:
        """Take a vector in; True if it founded a cluster."""
        alike = self.centroids @ v if len(self) else np.array([-np.inf])
        j, new = int(alike.argmax()), bool(alike.max() < self.threshold)
        if new:
            j = len(self)
            self.centroids = np.vstack([self.centroids.reshape(j, len(v)), v])
            self.mass.append(0.0)
            self.support.append([])
            self.exemplars.append([])
        moved = self.centroids[j] * self.mass[j] + v * weight
        self.centroids[j] = moved / max(np.linalg.norm(moved), 1e-12)
        self.mass[j] += weight
        self.support[j].append(int(key))
        if len(self.exemplars[j]) < EXEMPLARS and text not in self.exemplars[j]:
            self.exemplars[j].append(text)
        return new


class Replay:
    """The traces of a store (seq, session, idx, text, v, ts, salience, surprise) while it sleeps."""

    def __init__(self, frame: pd.DataFrame, config: StoreConfig, now: float):
        self.config, self.rng = config, np.random.default_rng(config.seed)
        self.traces = frame.assign(replays=frame.get("replays", 0), strength=frame.get("strength", 1.0), consolidated=frame.get("consolidated", False), resident=True)
        recent = 1 / (1 + np.maximum(0, now - frame["ts"].astype(float)) / 3600)
        self.urge = (0.15 + 0.5 * frame["surprise"] + 0.5 * frame["salience"]) * (0.35 + 0.65 * recent)
        self.schemas = Schemas(config.schema_merge_threshold)
        self.place = pd.Series(np.arange(len(frame)), pd.MultiIndex.from_frame(frame[["session", "idx"]]))

    def _drawn(self, rows: np.ndarray, share: float, weight: np.ndarray | None = None) -> np.ndarray:
        size = min(len(rows), max(1, round(self.config.replay_batch * share)))
        return self.rng.choice(rows, size, replace=False, p=None if weight is None else weight / weight.sum())

    def _following(self, rows: np.ndarray) -> np.ndarray:
        """Residents up to sequence_span - 1 places behind rows and not among them, once for each row they follow."""
        own = self.traces.loc[rows, ["session", "idx"]]
        ahead = pd.concat([own.assign(idx=own["idx"] + d, d=d, n=range(len(own))) for d in range(1, self.config.sequence_span)] or [own.iloc[:0].assign(d=0, n=0)]).sort_values(["n", "d"])
        found = self.place.reindex(pd.MultiIndex.from_frame(ahead[["session", "idx"]])).dropna().astype(int).to_numpy()
        return found[self.traces["resident"].to_numpy()[found] & ~np.isin(found, rows)]

    def burst(self) -> dict | None:
        """One burst; None when nothing is left to consolidate."""
        t = self.traces
        fresh, old = (np.flatnonzero(t["resident"] & x) for x in (~t["consolidated"], t["consolidated"]))
        if not len(fresh):
            return None
        priority = np.maximum(1e-6, self.urge.to_numpy()[fresh] / (1 + t["replays"].to_numpy()[fresh])) ** SHARPNESS
        urgent = self._drawn(fresh, 1 - self.config.interleave, priority)
        mixed = self._drawn(old, self.config.interleave) if self.config.interleave > 0 and len(old) else old[:0]
        rows = np.concatenate([urgent, self._following(urgent), mixed])
        created = sum(self.schemas.absorb(v, seq, text, 1.0 + s) for v, seq, text, s in t.loc[rows, ["v", "seq", "text", "surprise"]].itertuples(index=False))
        times = np.bincount(rows, minlength=len(t))
        t["replays"] += times
        t["strength"] = np.where(times > 0, np.minimum(1.0, t["strength"] + REFRESH * times), t["strength"])
        promoted = (times > 0) & ~t["consolidated"] & (t["replays"] >= self.config.promote_after)
        t["consolidated"] |= promoted
        self._make_room()
        keys = t["seq"].to_numpy()
        return {"replayed": keys[rows].tolist(), "promoted": keys[promoted].tolist(), "created": created, "updated": len(rows) - created, "resident": int(t["resident"].sum()), "schemas": len(self.schemas)}

    def _make_room(self) -> None:
        """Over capacity, consolidated traces leave, those of least utility first; others never do."""
        t, room = self.traces, self.config.capacity
        extra = 0 if room is None else int(t["resident"].sum()) - room
        if extra > 0:
            utility = (t["strength"] * (1 + t["salience"]) * (1 + 0.25 * t["replays"]))[t["resident"] & t["consolidated"]]
            t.loc[utility.sort_values(kind="stable").index[:extra], "resident"] = False


def _asleep(frame: pd.DataFrame, config: StoreConfig, cycles: int, now: float) -> tuple[Replay, list[dict]]:
    frame = frame.assign(v=[np.asarray(v, np.float64) for v in frame["v"]])
    replay = Replay(frame, config, now)
    events = []
    while len(events) < cycles and (event := replay.burst()):
        events.append(event)
    return replay, events


def sleep(traces: DataFrame, config: StoreConfig, cycles: int = 10, now: float = 0.0) -> DataFrame:
    """(store_id, seq, session, idx, text, v, ts, salience, surprise) to the schemas of each store after some bursts."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        replay, _ = _asleep(frame, config, cycles, now)
        s = replay.schemas
        return pd.DataFrame({"store_id": frame["store_id"].iloc[0], "schema": range(len(s)), "centroid": list(s.centroids), "mass": s.mass, "support": s.support, "exemplars": s.exemplars, "resident": int(replay.traces["resident"].sum())})

    return per_store(traces, fold, "store_id long, schema long, centroid array<double>, mass double, support array<long>, exemplars array<string>, resident long")


def slept(traces: DataFrame, config: StoreConfig, cycles: int = 10, now: float = 0.0) -> DataFrame:
    """The traces of each store after some bursts: store_id, seq, replays, strength, consolidated, resident."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        return _asleep(frame, config, cycles, now)[0].traces[["store_id", "seq", "replays", "strength", "consolidated", "resident"]]

    return per_store(traces, fold, "store_id long, seq long, replays long, strength double, consolidated boolean, resident boolean")


def consolidation_log(traces: DataFrame, config: StoreConfig, cycles: int = 10, now: float = 0.0) -> DataFrame:
    """A row for each burst of each store: step, keys replayed and promoted, schemas created and updated, sizes after it."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        _, events = _asleep(frame, config, cycles, now)
        columns = ["replayed", "promoted", "created", "updated", "resident", "schemas"]
        return pd.DataFrame(events, columns=columns).assign(store_id=frame["store_id"].iloc[0], step=range(1, len(events) + 1))[["store_id", "step", *columns]]

    return per_store(traces, fold, "store_id long, step long, replayed array<long>, promoted array<long>, created long, updated long, resident long, schemas long")


def schema_stats(schemas: DataFrame) -> DataFrame:
    """schemas, mean_support, max_support, compression (supporting traces once each, for each schema) of each store."""
    n = F.size(F.array_distinct("support")).cast("double")
    return schemas.groupBy("store_id").agg(F.count("*").cast("double").alias("schemas"), F.avg(n).alias("mean_support"), F.max(n).alias("max_support"), (F.sum(n) / F.count("*")).alias("compression"))


def store_stats(written: DataFrame, traces: DataFrame) -> DataFrame:
    """store_id, written, resident, retention: what was written, and what a store still holds of it."""
    held = traces.where("resident").groupBy("store_id").agg(F.count("*").alias("resident"))
    rows = written.groupBy("store_id").agg(F.count("*").alias("written")).join(held, "store_id", "left")
    return rows.select("store_id", "written", F.coalesce("resident", F.lit(0)).alias("resident"), (F.coalesce("resident", F.lit(0)) / F.col("written")).alias("retention"))
