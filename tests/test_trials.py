import itertools
import random

import pytest
from pyspark.sql import functions as F

from episodica.functions import paraphrase as P
from episodica.functions.text import split_of
from episodica.operators import tuning


def test_spelled_numbers(spark):
    got = {r["n"]: (r["c"], r["o"]) for r in spark.range(-1, 102).select(F.col("id").alias("n"), P.cardinal(F.col("id")).alias("c"), P.ordinal(F.col("id")).alias("o")).collect()}
    assert [got[n] for n in (0, 1, 12, 19, 20, 21, 40, 99)] == [
        ("zero", "zeroth"), ("one", "first"), ("twelve", "twelfth"), ("nineteen", "nineteenth"), ("twenty", "twentieth"), ("twenty-one", "twenty-first"), ("forty", "fortieth"), ("ninety-nine", "ninety-ninth")]
    assert got[100] == ("100", "100") and got[-1] == ("-1", "-1")
    assert len({c for c, _ in got.values()}) == len(got) == len({o for _, o in got.values()})


def test_rules_in_order(spark):
    rows = [
        ("episodic", "Which project did Ada work on in week 3 on Monday?", ("the Monday of their third week?",)),
        ("interference", "In week 21 on Friday, which project did Ada signed off on?", ("On the Friday of their twenty-first week, what did Ada approved?",)),
        ("interference", "so: In week 7 on Friday, which project did Ada paint? yes", ("so: On the Friday of their seventh week, what did Ada paint? yes",)),
        ("abstraction", "Which project does Ada usually work on?", ("What does Ada spend most of their time on, generally speaking?",)),
        ("temporal", "What did Ada work on right after they drafted the atlas load test in week 40?", ("Ada wrote up that atlas stress test in their fortieth week, what came next for them?",)),
        ("abstraction", "Which project did Ada work on in week 3 on Monday?", ("Which project did Ada work on in week 3 on Monday?",)),
        ("episodic", "nothing fits", ("nothing fits",)),
    ]
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "id long, task string, text string")
    for r in df.select("id", P.paraphrased(F.col("text"), F.col("task"), F.col("id")).alias("text")).collect():
        assert all(x in r["text"] for x in rows[r["id"]][2]), r
    assert df.select(P.paraphrased(F.lit(None).cast("string"), F.col("task"), F.col("id")).alias("x")).where("x IS NOT NULL").count() == 0


def test_grid_is_ranked_as_one_by_one(spark):
    rng = random.Random(9)
    rows = [(s, q, a, i, *[rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(2)], rng.random()) for s in (0, 1) for q in range(6) for a in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "store_id long, qid long, session long, idx long, a double, b double, f double")
    gold = [(s, q, rng.randrange(3), rng.randrange(6)) for s in (0, 1) for q in range(6) for _ in range(2)]
    configs = tuning.grid(a=(0.0, 1.0), b=(0.5, 2.0))
    assert list(configs) == ["a=0.0 b=0.5", "a=0.0 b=2.0", "a=1.0 b=0.5", "a=1.0 b=2.0"]
    one, keys = ["store_id", "qid"], ["session", "idx"]
    got = tuning.ranks(df, spark.createDataFrame(gold, "store_id long, qid long, session long, idx long"), configs, one, keys, F.col("f"))
    expected = set()
    for (name, w), s, q in itertools.product(configs.items(), (0, 1), range(6)):
        mine = sorted((-round((w["a"] * r[4] + w["b"] * r[5]) * r[6], 6), r[2], r[3]) for r in rows if r[:2] == (s, q))
        expected |= {(name, s, q, x, i, n + 1) for n, (_, x, i) in enumerate(mine) if (s, q, x, i) in set(gold)}
    assert {tuple(r) for r in got.collect()} == expected
    scores = tuning.judged(got, one, 5, 10)
    table = {r["config"]: r for r in tuning.report(scores, split_of(F.col("qid"))).collect()}
    assert sum(r["chosen"] for r in table.values()) == 1
    best = next(c for c, r in table.items() if r["chosen"])
    assert table[best]["dev"] == pytest.approx(max(r["dev"] or -1 for r in table.values()))
    lost = {r["config"]: r for r in tuning.ablations(scores, "a=1.0 b=0.5", one).collect()}
    assert lost["a=1.0 b=0.5"]["less"] == 0 == lost["a=1.0 b=0.5"]["worse"] == lost["a=1.0 b=0.5"]["better"]
