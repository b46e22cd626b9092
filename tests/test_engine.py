"""The engine's queries against their SQL, and its properties against definitions in numpy and Python."""

import itertools
import json
import math
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.config import StoreConfig
from episodica.functions import text as T
from episodica.functions import vectors as V
from episodica.operators import attractor, coding, consolidation, dense, evaluation, index, recall, units
from episodica.plans import catalog, reads  # noqa: F401  registers queries
from episodica.sources import corpora
from episodica.sources.versions import Versions
from episodica.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    rows = [tuple(None if v is None or v != v else float(v) if isinstance(v, int | float) else str(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_terms_and_pairs(spark):
    def terms(t):
        return spark.createDataFrame([(t,)], "text string").select(T.content_terms(F.col("text"))).first()[0]

    assert terms("In week 7 on Monday") == ["week", "7", "monday"]
    assert terms("Priya's notes") == ["priya's", "notes"] and terms("Priya s notes") == ["priya", "notes"]
    rows = spark.createDataFrame([(1, "rain rain snow rain")], "k long, text string")
    assert {(r.u, r.tf, r.length) for r in units.unit_counts(rows, ["k"], window=3).collect()} == {("rain", 3, 4), ("snow", 1, 4), ("rain|snow", 3, 4)}
    with pytest.raises(ValueError):
        units.unit_counts(rows, ["k"], window=1)


def test_time_context(spark):
    one = spark.range(1).select(*[V.theta(F.lit(a), F.lit(b), F.lit(c), F.lit(d)) for a, b, c, d in ((0, 0, 0, 1), (0, 0, 0, 40), (0, 3, 1, 3), (0, 3, 0, 4), (0, 97, 1, 0))]).first()
    assert one[0] > one[1] and one[2] < one[3] and math.isclose(one[4], 1)


def test_configuration():
    assert StoreConfig().reconfigured(fusion="rrf").fusion == "rrf"
    for wrong in ({"fusion": "x"}, {"conj_window": 1}, {"sparsity": 1.5}, {"conj_weighting": "x"}):
        with pytest.raises(ValueError):
            StoreConfig(**wrong)
    with pytest.raises(ValueError):
        StoreConfig().reconfigured(conj_window=8)


def test_units_of_any_order(spark):
    terms = "rain snow ice rain hail fog ice".split()
    want = Counter()
    for i in range(len(terms)):
        for n in range(4):
            for rest in itertools.combinations(terms[i + 1 : i + 5], n):
                if len({terms[i], *rest}) == n + 1:
                    want["|".join(sorted([terms[i], *rest]))] += 1
    rows = spark.createDataFrame([(1, " ".join(terms)), (2, ""), (3, None)], "k long, text string")
    assert {(r.u, r.tf) for r in units.unit_counts(rows, ["k"], order=4, window=5).collect()} == set(want.items())
    assert {r.u for r in units.unit_rows(rows, ["k"], order=4, window=5).collect()} == set(want)


def test_usage_bias_spreads_codes():
    rng = np.random.default_rng(0)
    mean = rng.normal(size=64)
    rows = np.stack([mean + 0.3 * rng.normal(size=64) for _ in range(300)])
    used = [len(np.unique(coding.Coder(64, StoreConfig(neurogenesis=gain)).codes(rows, learn=True))) for gain in (0.0, 0.7)]
    assert used[1] > 1.5 * used[0]


def test_inhibition_and_separation():
    rng = np.random.default_rng(1)
    a = rng.normal(size=64)
    b = a + 0.5 * rng.normal(size=64)
    plain, spread = coding.Coder(64, StoreConfig()), coding.Coder(64, StoreConfig(), inhibition=0.25)
    for coder in (plain, spread):
        code = coder.codes(a[None], learn=False)[0]
        assert len(set(code.tolist())) == coder.winners and (np.diff(code) > 0).all()
    got = coding.separation(plain, a, b)
    assert 0 < got["output_overlap"] < got["input_cosine"] and math.isclose(got["ratio"], got["output_overlap"] / got["input_cosine"])


def test_completion_from_a_tenth_of_a_code():
    rng = np.random.default_rng(0)
    codes = [np.sort(rng.choice(3072, 61, replace=False)) for _ in range(500)]
    patterns = attractor.Patterns(codes, 3072)
    got = patterns.settle([rng.choice(codes[i], 6, replace=False) for i in range(300)], 22.0, [61] * 300)
    assert sum(x.index == i for i, x in enumerate(got)) >= 285
    (exact,) = patterns.settle([codes[17]], 22.0)
    assert exact.index == 17 and exact.converged and exact.steps == len(exact.energy) and exact.energy[-1] <= exact.energy[0] + 1e-6 and math.isclose(exact.weights.sum(), 1, rel_tol=1e-4)
    assert attractor.Patterns([], 10).settle([codes[0]], 22.0)[0].index == -1
    alone = [patterns.settle([codes[i][:9]], 22.0, [61])[0].index for i in range(5)]  # a block settles as its cues do alone
    assert alone == [x.index for x in patterns.settle([c[:9] for c in codes[:5]], 22.0, [61] * 5)] == list(range(5))
    patterns.remove(17)
    assert len(patterns) == 500 and patterns.resident == 499 and patterns.similarity([codes[17]])[0, 17] == 0


def sleepers(n, spark, stores=1, **extra):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = []
    for k in range(n):
        v = base + 0.2 * rng.normal(size=16)
        rows.append((k % stores, k, k // 8, k % 8, f"event {k}", (v / np.linalg.norm(v)).tolist(), 60.0 * k, 0.3, 0.5))
    return spark.createDataFrame(rows, "store_id long, seq long, session long, idx long, text string, v array<double>, ts double, salience double, surprise double")


def test_sleep_gathers_schemas_and_makes_room(spark):
    rows = sleepers(80, spark)
    config = StoreConfig(capacity=30)
    schemas = consolidation.sleep(rows, config, cycles=25, now=4800.0).collect()
    assert schemas and all(abs(np.linalg.norm(r.centroid) - 1) < 1e-9 and len(r.exemplars) <= 8 for r in schemas)
    left = consolidation.slept(rows, config, cycles=25, now=4800.0).collect()
    assert len(left) == 80 and all(r.consolidated for r in left if not r.resident) and all(r.replays >= 3 for r in left if r.consolidated)
    log = consolidation.consolidation_log(rows, config, cycles=25, now=4800.0).collect()
    assert [r.step for r in log] == list(range(1, len(log) + 1)) and log[-1].resident == sum(r.resident for r in left) and log[-1].schemas == len(schemas)
    assert sum(r.created for r in log) == len(schemas) and sum(len(r.replayed) for r in log) == sum(r.replays for r in left)
    assert consolidation.sleep(rows, config, cycles=25, now=4800.0).collect() == schemas
    stats = consolidation.schema_stats(spark.createDataFrame(schemas)).first()
    assert stats.schemas == len(schemas) and stats.max_support <= 80


def test_heavier_schemas_rank_first_and_empty_ones_not_at_all(spark):
    v = [1.0] + [0.0] * 7
    schemas = spark.createDataFrame([(0, 1, v, 20.0, ["often"]), (0, 2, v, 1.0, ["once"]), (0, 3, v, 90.0, [])], "store_id long, schema long, centroid array<double>, mass double, exemplars array<string>")
    asked = spark.createDataFrame([(0, 7, "q", v)], "store_id long, qid long, text string, v array<double>")
    assert [r.text for r in recall.schema_hits(schemas, asked, 5).orderBy("nth").collect()] == ["often", "once"]


def test_recall_reinstates_neighbours_and_counts_rehearsals(spark):
    v = lambda i: [float(i == j) for j in range(4)]
    said = ["Alice met the gardener", "Then rain fell", "Bob sold his boat", "Alice met the gardener"]
    rows = [(0, 0, k, t, v(k % 3), 1.0) for k, t in enumerate(said)] + [(1, 0, 0, "Alice met the gardener elsewhere", v(0), 1.0)]
    e = spark.createDataFrame(rows, "store_id long, session long, idx long, text string, v array<double>, strength double")
    q = spark.createDataFrame([(0, 1, "What happened right after Alice met the gardener?", v(0), None, None)], "store_id long, qid long, text string, v array<double>, session long, position long")
    best = recall.recall(e, q, None, StoreConfig(), k=3)
    got = best.orderBy("rank").collect()
    assert (got[0].idx, got[0].reinstated, got[0].anchor) == (1, 1, False) and len(got) == 3 and {r.store_id for r in got} == {0}
    assert len(recall.recall(e, q, None, StoreConfig(), k=None, dedup=False).collect()) == 4
    gains = recall.rehearsals(best)
    after = {(r.store_id, r.idx): r.strength for r in recall.rehearsed(e.withColumn("strength", F.lit(0.9)), gains).collect()}
    assert math.isclose(after[0, 1], 0.95) and after[1, 0] == 0.9 and e.columns == recall.rehearsed(e, gains).columns


def test_novelty_over_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k % 2, k, v[k].tolist()) for k in range(60)], "store_id long, seq long, v array<double>")
    for r in dense.novelty(rows, block=7).collect():
        earlier = [v[r.seq] @ v[j] for j in range(r.seq % 2, r.seq, 2)]
        assert math.isclose(r.novelty, min(1, max(0, 1 - max(earlier))) if earlier else 1.0, abs_tol=1e-9)


def test_index_tables_give_the_same_scores(spark, sf, tmp_path):
    p, q, documents = catalog._postings(spark, sf)
    index.build(p, documents, str(tmp_path))
    keys = ["session", "idx"]
    canon = lambda df: sorted((r.qid, r.session, r.idx, round(r.score, 9)) for r in df.collect())
    got = canon(index.search(str(tmp_path), q, keys))
    assert got and got == canon(index.cosine(p, q, documents, keys))


def test_haystack_ids_and_gold(spark, tmp_path):
    turn = lambda role, text, **kw: {"role": role, "content": text, **kw}
    entry = {
        "question_id": "q1", "question_type": "single", "question": "where?", "haystack_session_ids": ["s_a", "answer_b", "noans_c"], "haystack_dates": ["2023/05/20 (Sat) 02:21"] * 3,
        "haystack_sessions": [[turn("user", "one"), turn("assistant", "x"), turn("user", "two")], [turn("user", "yes", has_answer=True), turn("assistant", "x"), turn("user", "no")], [turn("user", "other")]],
    }
    (tmp_path / "h.json").write_text(json.dumps([entry]))
    rows = corpora.haystack(spark, str(tmp_path / "h.json")).orderBy("session", "position").collect()
    assert [r.turn_id for r in rows] == ["s_a_1", "s_a_3", "answer_b_1", "noans_b_3", "noans_c_1"]
    assert [r.turn_id for r in rows if r.gold] == ["answer_b_1"] and [r.session for r in rows] == [0, 0, 1, 1, 2] and [r.position for r in rows] == [0, 1, 0, 1, 0]
    assert all(r.ts == rows[0].ts > 0 for r in rows)


def test_dialogue_files(spark, tmp_path):
    entry = {
        "sample_id": "c1", "conversation": {"speaker_a": "Ann", "session_1": [{"speaker": "Ann", "text": "hi", "dia_id": "D1:1"}, {"speaker": "Bo", "text": "look", "dia_id": "D1:2", "blip_caption": "a cat"}], "session_1_date_time": "1:56 pm on 8 May, 2023"},
        "qa": [{"question": "what?", "category": 2, "evidence": ["D1:2"]}, {"question": "none", "category": 5, "evidence": ["D1:1"]}, {"question": "lost", "category": 1, "evidence": ["D9:9"]}],
    }
    entry["conversation"]["session_1"] = json.dumps(entry["conversation"]["session_1"])
    (tmp_path / "d.json").write_text(json.dumps([entry]))
    turns, asked = corpora.dialogues(spark, str(tmp_path / "d.json"))
    rows = turns.orderBy("position").collect()
    assert [r.turn_id for r in rows] == ["D1:1", "D1:2"] and rows[1].text.endswith("[shares a cat]") and rows[0].text == '(1:56 pm on 8 May, 2023) Ann said, "hi"' and rows[0].ts > 0
    assert [(r.question, r.gold) for r in asked.collect()] == [("what?", ["D1:2"])]


def test_small_text_functions(spark):
    one = lambda f, *x: spark.range(1).select(f(*[F.lit(v) for v in x]).alias("r")).first().r
    assert one(T.label, "one two three four five six seven") == "one two three four five six..." and one(T.label, "one two") == "one two"
    assert one(T.stripped, "answer_b_1") == "answer_b"
    assert one(T.hit, "The Red boat.", "red") and not one(T.hit, "The redder boat", "red") and not one(T.hit, "x", "") and one(T.hit, "a.b c", "a.b")


def test_discounted_gain(spark):
    ranked = spark.createDataFrame([(1, k, k) for k in range(1, 8)], "qid long, id long, rank int")
    got = evaluation.at_k(ranked, spark.createDataFrame([(1, 2), (1, 4)], "qid long, id long"), 5, ["id"]).first()
    assert math.isclose(got.ndcg, 0.75) and got.recall_all == 1 and got.rr == 0.5


def test_statistics():
    a, b = np.full(50, 0.7), np.full(50, 0.5)
    assert np.allclose(evaluation.bootstrap(a, b, n=500), 0.2)
    assert evaluation.permutation(np.ones(40), np.zeros(40), n=2000) == 1 / 2001 and evaluation.permutation(a, a) == 1.0
    with pytest.raises(ValueError):
        evaluation.bootstrap(a, b[:3])
    mean, low, high = evaluation.bootstrap(np.array([0.0, 1.0] * 40), np.zeros(80), n=1000)
    assert mean == 0.5 and low < 0.5 < high


def test_streamed_counts_equal_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("session"), "text")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.running_df(stream).writeStream.outputMode("complete").format("memory").queryName("df").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    p = units.unit_counts(rows.withColumn("k", F.monotonically_increasing_id()), ["k"])
    want = {r.u: r.df for r in index.document_frequency(p).collect()}
    assert {r.u: r.df for r in spark.table("df").collect()} == want


def test_encoders(spark, tmp_path):
    import hashlib

    from episodica.functions import encoders

    def plain(text, dim=384):
        words, v = [w for w in "".join(c if c.isascii() and (c.isalnum() or c == "'") else " " for c in text.lower()).split()], np.zeros(dim)
        for n in (1, 2):
            for k in range(len(words) - n + 1):
                h = int.from_bytes(hashlib.blake2b(f"0:{' '.join(words[k : k + n])}".encode(), digest_size=8).digest(), "little")
                v[h % dim] += (1 if h >> 63 else -1) / math.sqrt(n)
        return v / max(np.linalg.norm(v), 1e-12)

    texts = ["The valve failed at Priya's plant", "the valve failed at priya's plant", "", None, "é x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    own = encoders.REGISTRY["hashing"]
    got = {r.k: r.v for r in rows.select("k", own.documents(F.col("text")).alias("v")).collect()}
    assert all(np.allclose(got[k], plain(t or ""), atol=1e-6) for k, t in enumerate(texts))
    path = str(tmp_path / "cache")
    stored = lambda: Versions(spark, path).read("vectors", Versions(spark, path).version(), encoders.VECTORS)
    for _ in range(2):
        held = {r.k: r.v for r in encoders.cached(rows, own, path).collect()}
        assert held == {**got, 3: None} and stored().count() == 4 and Versions(spark, path).version() == 1
    # writers at the same time, of texts that overlap: one row a key, and nobody's vectors are lost
    more = [spark.createDataFrame([(k, f"text {k}") for k in range(n, n + 6)], "k long, text string") for n in (0, 3, 4)]
    with ThreadPoolExecutor(3) as pool:
        assert [x.where("v IS NOT NULL").count() for x in pool.map(lambda df: encoders.cached(df, own, path), more)] == [6, 6, 6]
    assert stored().count() == stored().select("key").distinct().count() == 14
    table = stored().select("key", "v")
    served = {r.k: r.v for r in encoders.from_tables(rows, table.limit(0), table).collect()}
    assert served == held
    with pytest.raises(ValueError):
        encoders.register("hashing", own)
