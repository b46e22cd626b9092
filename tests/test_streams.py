"""Streams with state: any order within the delay, micro-batches of any size and a restart give what writing one at a time gives."""

import math
import random
from datetime import datetime, timedelta, timezone

import pyspark.sql.functions as F

from episodica.config import StoreConfig
from episodica.streaming import ingest, residents

SCHEMA = "store_id long, ts timestamp, event string, session long, idx long, text string, v array<double>, gain double"
START = datetime(2024, 5, 1, tzinfo=timezone.utc)
CONFIG = StoreConfig(decay_rate=0.9, decay_floor=0.35)


def one_at_a_time(events):
    """(kind, session, idx, seq, surprise) in order of time, for one store."""
    traces, given, n, out = {}, {}, 0, []
    for r in sorted(events, key=lambda r: (r["ts"], ["write", "gain", "consolidated"].index(r["event"]), r["session"], -1 if r["idx"] is None else r["idx"], r["text"] or "")):
        if r["event"] == "write":
            key = (r["session"], given.get(r["session"], 0))
            given[r["session"]], n = key[1] + 1, n + 1
            most = max((sum(a * b for a, b in zip(r["v"], t[0], strict=True)) for t in traces.values()), default=None)
            out.append(("write", *key, n, 1.0 if most is None else round(min(1, max(0, 1 - most)), 9)))
            traces[key] = [r["v"], 1.0, False]
            for k in list(traces):
                traces[k][1] *= CONFIG.decay_rate
                if traces[k][1] < CONFIG.decay_floor and traces[k][2]:
                    del traces[k]
                    out.append(("expired", *k, n, None))
        elif (r["session"], r["idx"]) in traces:
            t = traces[r["session"], r["idx"]]
            if r["event"] == "gain":
                t[1] = min(1.0, t[1] + r["gain"])
            else:
                t[2] = True
    return out


def made(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(70):
        event = "write" if k < 6 else rng.choice(["write", "write", "gain", "consolidated"])
        v = [rng.gauss(0, 1) for _ in range(4)]
        size = math.sqrt(sum(x * x for x in v))
        row = {"store_id": k % 2, "ts": START + timedelta(milliseconds=400 * k + rng.randrange(300)), "event": event, "session": rng.randrange(2), "idx": None, "text": None, "v": None, "gain": None}
        row |= {"text": f"text {k}", "v": [x / size for x in v]} if event == "write" else {"idx": rng.randrange(4)} | ({"gain": rng.random() / 3} if event == "gain" else {})
        rows.append(row)
    return rows


def test_stream_equals_one_at_a_time(spark, tmp_path):
    rows = made(6)
    rng = random.Random(1)
    # each row comes up to four seconds after others of its time
    arriving = sorted(rows, key=lambda r: r["ts"] + timedelta(seconds=rng.random() * 4))
    batches = [arriving[a:b] for a, b in ((0, 9), (9, 10), (10, 38), (38, 55), (55, 70))]
    late = {**rows[0], "text": "too late"}
    flush = lambda s: {"store_id": s, "ts": START + timedelta(hours=1), "event": "none", "session": 0, "idx": None, "text": None, "v": None, "gain": None}
    batches += [[flush(0), flush(1)], [late]]
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, residents.PROVIDER)
    try:
        done = 0
        for n in (3, len(batches)):  # a restart from the checkpoint in between
            for batch in batches[done:n]:
                spark.createDataFrame([tuple(r.values()) for r in batch], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            done = n
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            q = residents.residents(stream, CONFIG, "5 seconds").writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = spark.read.parquet(sink).collect()
    for store in (0, 1):
        mine = sorted((r["kind"], r["session"], r["idx"], r["seq"], r["surprise"] if r["surprise"] is None else round(r["surprise"], 9)) for r in got if r["store_id"] == store)
        expected = one_at_a_time([r for r in rows if r["store_id"] == store])
        assert any(k == "expired" for k, *_ in expected)
        assert mine == sorted(expected)


def test_positions_follow_arrival(spark, tmp_path):
    rows = [(k % 3, f"text {k}") for k in range(30)]
    for a, b in ((0, 7), (7, 8), (8, 30)):
        spark.createDataFrame(rows[a:b], "session long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.positions(stream).writeStream.format("memory").queryName("places").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("places").groupBy("session").agg(F.sort_array(F.collect_list("idx")).alias("places")).collect()
    assert {r["session"]: r["places"] for r in got} == {s: list(range(10)) for s in range(3)}
