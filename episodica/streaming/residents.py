"""The write path as a stream with state: what comes is put in order of event time, written store by store, and expires.

Events of a store (store_id, ts, event, session, idx, text, v, gain), in any order within the watermark's delay:

    write        a text of a session, with its vector: gets the next position of the session, a number and its novelty
    gain         what a recall has rehearsed of the trace (session, idx)
    consolidated the trace (session, idx) is held by schemas now: once it is weak it expires, as after the next write

Rows wait in state until the watermark has passed their time, so an order of arrival makes no difference, and state holds no more than
the delay's rows and the residents.  Rows that come after the watermark has passed their time are dropped, by Spark: they have no position.  Rows of one
time go by event (write first), session, idx and text.  A timer for each slot of time writes what the slot holds.

Out comes a row for each write (store_id, kind = write, session, idx, seq, ts, surprise) and for each trace that expires (kind = expired,
seq: the write that it expired after).  The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import StoreConfig

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "store_id long, kind string, session long, idx long, seq long, ts timestamp, surprise double"
#: Milliseconds of event time that are written together.
SLOT = 1000
_ORDER = {"write": 0, "gain": 1, "consolidated": 2}
_EVENT = "ts timestamp, event string, session long, idx long, text string, v array<double>, gain double"


class _Residents(StatefulProcessor):
    def __init__(self, config: StoreConfig, slot: int):
        self._rate, self._floor, self._slot = config.decay_rate, config.decay_floor, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "slot long", f"rows array<struct<{', '.join(c.replace(' ', ':', 1) for c in _EVENT.split(', '))}>>")
        self._given = handle.getMapState("given", "session long", "given long")
        self._written = handle.getValueState("written", "n long")
        self._traces = handle.getMapState("traces", "session long, idx long", "seq long, v array<double>, strength double, as_of long, consolidated boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [c.split()[0] for c in _EVENT.split(", ")]
        fresh: dict[int, list[tuple]] = {}
        for r in rows:
            due = (int(r["ts"].timestamp() * 1000) // self._slot + 1) * self._slot
            fresh.setdefault(due, []).append(tuple(r[c] for c in names))
        for due, more in fresh.items():
            old = [tuple(x) for x in self._waiting.getValue((due,))[0]] if self._waiting.containsKey((due,)) else []
            self._waiting.updateValue((due,), (old + more,))
            self._handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if not self._waiting.containsKey((due,)):
            return
        rows = [tuple(x) for x in self._waiting.getValue((due,))[0]]
        self._waiting.removeKey((due,))
        yield from self._write(key[0], sorted(rows, key=lambda r: (r[0], _ORDER.get(r[1], 3), r[2], -1 if r[3] is None else r[3], r[4] or "")))

    def _last(self, t: dict) -> float:
        """The write after which a trace is gone."""
        if not t["consolidated"]:
            return math.inf
        step = max(1, math.ceil(math.log(self._floor / t["strength"]) / math.log(self._rate)))
        while step > 1 and t["strength"] * self._rate ** (step - 1) < self._floor:
            step -= 1
        while t["strength"] * self._rate**step >= self._floor:
            step += 1
        return t["as_of"] + step

    def _write(self, store: int, rows: list[tuple]) -> Iterator[Row]:
        """A slot's events in order; the residents are read once and what has changed is put back."""
        names = ["seq", "v", "strength", "as_of", "consolidated"]
        held = {tuple(k): dict(zip(names, v, strict=True)) for k, v in self._traces.iterator()}
        n = self._written.get()[0] if self._written.exists() else 0
        last = {k: self._last(t) for k, t in held.items()}
        given: dict[int, int] = {}
        changed, gone = set(), set()
        for ts, event, session, idx, _text, v, gain in rows:
            trace = held.get((session, idx))
            if event == "write":
                if session not in given:
                    given[session] = self._given.getValue((session,))[0] if self._given.containsKey((session,)) else 0
                place, given[session] = given[session], given[session] + 1
                others = [t["v"] for t in held.values() if t["v"] is not None]
                most = float((np.array(others) @ np.array(v)).max()) if others and v is not None else None
                n += 1
                yield Row(store_id=store, kind="write", session=session, idx=place, seq=n, ts=ts, surprise=1.0 if most is None else min(1.0, max(0.0, 1 - most)))
                held[session, place] = {"seq": n, "v": v, "strength": 1.0, "as_of": n - 1, "consolidated": False}
                last[session, place] = math.inf
                changed.add((session, place))
                for k in [k for k, x in last.items() if x <= n]:
                    yield Row(store_id=store, kind="expired", session=k[0], idx=k[1], seq=n, ts=ts, surprise=None)
                    del held[k], last[k]
                    gone.add(k)
            elif trace is not None:
                if event == "gain":
                    trace["strength"], trace["as_of"] = min(1.0, trace["strength"] * self._rate ** (n - trace["as_of"]) + gain), n
                elif event == "consolidated":
                    trace["consolidated"] = True
                changed.add((session, idx))
                last[session, idx] = max(self._last(trace), n + 1)
        for k in changed & held.keys():
            self._traces.updateValue(k, tuple(held[k][c] for c in names))
        for k in gone:
            self._traces.removeKey(k)
        for session, count in given.items():
            self._given.updateValue((session,), (count,))
        self._written.update((n,))

    def close(self) -> None:
        pass


def residents(stream: DataFrame, config: StoreConfig | None = None, delay: str = "10 seconds", slot: int = SLOT) -> DataFrame:
    """What each write of the stream gives, and what expires, in append mode."""
    columns = [F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in _EVENT.split(", ")]
    rows = stream.select(F.col("store_id").cast("long").alias("store_id"), *columns).withWatermark("ts", delay)
    return rows.groupBy("store_id").transformWithState(statefulProcessor=_Residents(config or StoreConfig(), slot), outputStructType=OUT, outputMode="append", timeMode="eventTime")
