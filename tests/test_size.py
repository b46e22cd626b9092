"""Steps whose work must not grow faster than their input, held to plain results on small rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.config import StoreConfig
from episodica.operators import attractor, blend, coding, dense, index, units


def test_ranks_of_the_best_wanted_rows(spark):
    """Copies of a gold text are as many as the documents: no row of the ranking meets more than k of them."""
    rng = random.Random(3)
    rows = [(q, d, rng.randint(0, 30) / 7) for q in range(3) for d in range(60) if rng.random() < 0.9]
    gold = {(q, d) for q, d, _ in rows if d % 3 != q} | {(1, 999)}
    order = {q: sorted((-round(s, 6), d) for p, d, s in rows if p == q) for q in range(3)}
    place = {(q, d): n + 1 for q in order for n, (_, d) in enumerate(order[q])}
    want = {(q, *x) for q in order for x in sorted((place[q, d], d) for p, d in gold if p == q and (q, d) in place)[:4]}
    scored = spark.createDataFrame(rows, "qid long, doc_id long, score double")
    wanted = spark.createDataFrame(sorted(gold), "qid long, doc_id long")
    own = scored.join(wanted, ["qid", "doc_id"], "left_semi")
    for got in (index.ranks(scored, wanted, ["doc_id"], 4), index.ranks(scored, wanted, ["doc_id"], 4, own)):
        assert {(r["qid"], r["rank"], r["doc_id"]) for r in got.collect()} == want


def test_scores_of_some_documents_are_those_of_all(spark):
    texts = spark.createDataFrame([(n, " ".join(random.Random(n).choices("abcdef", k=5 + n))) for n in range(9)], "doc_id long, text string")
    asked = index.token_counts(spark.createDataFrame([(1, "a b z"), (2, "c a")], "qid long, text string"), ["qid"], F.split("text", " "))
    p, d = index.token_counts(texts, ["doc_id"], F.split("text", " ")), texts.select("doc_id", F.size(F.split("text", " ")).cast("long").alias("length"))
    of = index.token_counts(texts.where("doc_id < 4"), ["doc_id"], F.split("text", " "), asked.select("u").distinct())
    canon = lambda df: sorted((r["qid"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    every = canon(index.bm25(p, asked, d, ["doc_id"]))
    assert canon(index.bm25(p, asked, d, ["doc_id"], of=of)) == [x for x in every if x[1] < 4]


def dense_rows(spark, n=90):
    """Rows of a store with copies, and its questions; blocks of a few rows."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(n, 6))
    v[n // 2 :: 3] = v[1]
    rows = [(0, k, v[k].tolist(), float(k * 7 % 11)) for k in range(n)] + [(0, 999, None, 99.0)]
    df = spark.createDataFrame(rows, "store_id long, id long, v array<double>, own double")
    q = range(0, n, 9)
    return df, df.where("id % 9 = 0 AND v IS NOT NULL").select("store_id", F.col("id").alias("qid"), "v"), {k: v @ v[k] for k in q}, np.arange(n) * 7 % 11


def ranking(total, k):
    near = np.round(total, 6)
    return [int(x) for x in np.lexsort((np.arange(len(near)), -near))[:k]]


def ids(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


@pytest.fixture
def small(monkeypatch):
    for name, n in {"ROWS": 16, "QUESTIONS": 4, "HELD": 3}.items():
        monkeypatch.setattr(dense, name, n)
    monkeypatch.setattr(dense.pairs, "__defaults__", (dense.matrix, (16, 4)))


def test_fused_in_blocks(spark, small):
    rows, asked, s, own = dense_rows(spark)
    z = lambda x: (x - x.mean()) / x.std()
    unit = lambda x: (x - x.min()) / (x.max() - x.min())
    assert ids(blend.fused(rows, asked, ["id"], (1.0, 0.9), "minmax", 10)) == {q: ranking(unit(x) + 0.9 * unit(own), 10) for q, x in s.items()}
    want = {q: z(x) + 0.9 * z(own) for q, x in s.items()}
    assert ids(blend.fused(rows, asked, ["id"], (1.0, 0.9), "zscore", 10, least=True)) == {q: ranking(t - t.min(), 10) for q, t in want.items()}


@pytest.mark.parametrize("k, flat", [(10, False), (2, False), (3, True)])
def test_reciprocal_ranks_from_the_first_places_and_counts(spark, small, k, flat):
    rows, asked, s, own = dense_rows(spark, 200)
    if flat:
        rows, own = rows.withColumn("own", F.lit(1.0)), np.ones(200)
    place = lambda x: np.argsort(np.lexsort((np.arange(len(x)), -np.round(x, 9)))) + 1
    got = ids(blend.fused_rrf(rows, asked, "id", (1.0, 0.9), k))
    assert got == {q: ranking(1 / (60 + place(x)) + (0 if flat else 0.9 / (60 + place(own))), k) for q, x in s.items()}


def test_percentile_in_blocks(spark, small):
    rows, asked, s, _ = dense_rows(spark)
    for p in (0.0, 0.5, 0.95, 1.0):
        for r in dense.percentile(rows, asked, ["id"], dense.spreads(rows, asked, ["id"], others=True), p, others=True).collect():
            assert math.isclose(r["value"], np.quantile(np.delete(s[r["qid"]], r["qid"]), p), abs_tol=1e-9)


def test_spreads_of_equal_scores(spark, small):
    rows = spark.createDataFrame([(0, k, [0.9, 0.1]) for k in range(80)], "store_id long, id long, v array<double>")
    (r,) = dense.spreads(rows, rows.limit(1).select("store_id", F.lit(5).cast("long").alias("qid"), "v"), ["id"], 22.0).collect()
    assert r["n"] == 80 and r["spread"] < 1e-12 and math.isclose(r["whole"], 80, rel_tol=1e-9)


def test_overlaps_and_novelty_in_blocks(spark, small):
    rng = np.random.default_rng(1)
    codes = [sorted(int(x) for x in rng.choice(16, 3, replace=False)) for _ in range(70)]
    rows = spark.createDataFrame([(0, k, c) for k, c in enumerate(codes)], "store_id long, id long, v array<int>")
    got = {(r["qid"], r["id"], r["n"]) for r in coding.overlaps(rows, rows.where("id % 7 = 0").withColumnRenamed("id", "qid"), ["id"], 16).collect()}
    assert got == {(q, k, n) for q in range(0, 70, 7) for k in range(70) if (n := len(set(codes[q]) & set(codes[k])))}
    # numbers with gaps: blocks by number would hold a row each
    v = rng.normal(size=(60, 4)) / 4
    far = spark.createDataFrame([(0, 1000 * k, v[k].tolist()) for k in range(60)], "store_id long, seq long, v array<double>")
    for r in dense.novelty(far, 7).collect():
        k = r["seq"] // 1000
        assert math.isclose(r["novelty"], min(1, max(0, 1 - max(v[:k] @ v[k]))) if k else 1.0, abs_tol=1e-9)


def test_completion_in_tasks_of_a_store(spark, monkeypatch):
    """A store's cues lie in several groups, and none keeps a number for each cue and pattern."""
    rng = np.random.default_rng(4)
    codes = [sorted(int(x) for x in rng.choice(64, 6, replace=False)) for _ in range(60)]
    rows = spark.createDataFrame([(0, 5 * k, c) for k, c in enumerate(codes)] + [(1, 3, codes[0]), (1, 4, [])], "store_id long, seq long, code array<int>")
    monkeypatch.setattr(attractor, "CUES", 8)
    got = attractor.completion(rows, StoreConfig(), 64, keep=0.5)
    assert len({(r["store_id"], r["block"]) for r in got.selectExpr("store_id", "floor(seq / 40) AS block").collect()}) == 9
    patterns = attractor.Patterns(codes, 64)
    want = patterns.settle([attractor.part_of(np.array(c), 0.5, [0, n]) for n, c in enumerate(codes)], StoreConfig.beta, [6] * 60)
    rows = sorted((r for r in got.collect() if r["store_id"] == 0), key=lambda r: r["seq"])
    assert [(r["winner"], r["steps"], r["converged"]) for r in rows] == [(5 * x.index, x.steps, x.converged) for x in want]
    assert all(math.isclose(r["confidence"], x.confidence, rel_tol=1e-5) for r, x in zip(rows, want, strict=True))
    assert all(not len(x.weights) for x in patterns.settle([codes[0]], 22.0, weights=False))


def test_units_of_a_text_are_counted_where_they_are_made(spark):
    rows = spark.createDataFrame([(1, "rain rain snow hail"), (2, "the"), (3, None), (4, "rain")], "k long, text string")
    got = units.unit_counts(rows, ["k"], sized=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    plain = {(r["k"], r["u"]): (r["tf"], r["length"]) for r in units.unit_counts(rows, ["k"]).collect()}
    assert {(r["k"], r["u"]): (r["tf"], r["length"]) for r in got.collect()} == plain
    assert {(r["k"], r["units"]) for r in got.collect()} == {(k, sum(x == k for x, _ in plain)) for k in (1, 4)}
