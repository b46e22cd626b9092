import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import dense
from episodica.operators.cells import Cells

SCHEMA = "store_id long, id long, v array<double>"


def brute(rows, asked, k):
    out = []
    for s, q, v in asked:
        scored = sorted((-round(sum(a * b for a, b in zip(v, x, strict=True)), 6), i) for t, i, x in rows if t == s and x is not None and v is not None)
        out += [(s, q, i, r + 1) for r, (_, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread, k", [(0.05, 3), (1.0, 7), (0.05, 500)])
def test_equal_to_scoring_all(spark, tmp_path, spread, k):
    rng = random.Random(5)
    heart = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(s, i, [x + rng.gauss(0, spread) for x in rng.choice(heart)]) for s in (0, 3) for i in range(200)]
    rows += [(3, 200 + i, rows[-1][2]) for i in range(30)] + [(0, 900, None), (4, 1, [0.0] * 8)]  # ties, no vector, a store of one
    asked = [(s, 10 * s + n, [x + rng.gauss(0, spread) for x in rng.choice(heart)]) for s in (0, 3, 4, 5) for n in range(4)] + [(0, 99, None)]
    cells = Cells(spark, str(tmp_path / "c")).build(spark.createDataFrame(rows, SCHEMA), ["id"])
    q = spark.createDataFrame(asked, SCHEMA.replace(" id", " qid"))
    got = sorted((r["store_id"], r["qid"], r["id"], r["rank"]) for r in cells.top(q, ["id"], k).collect())
    assert got == brute(rows, asked, k)
    if spread < 0.1 and k < 10:
        assert cells.share(q, ["id"], k) < 0.5


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    cells = Cells(spark, str(tmp_path / "c")).build(none, ["id"])
    assert cells.top(none.withColumnRenamed("id", "qid"), ["id"], 3).count() == 0


def test_surprise_skips_what_has_gone(spark):
    held = spark.createDataFrame([(0, 1, 2, [1.0, 0.0]), (0, 2, 9, [0.0, 1.0])], "store_id long, seq long, last long, v array<double>")
    fresh = spark.createDataFrame([(0, 3, [1.0, 0.0]), (0, 4, [1.0, 0.0]), (1, 1, [1.0, 0.0])], "store_id long, seq long, v array<double>")
    got = {(r["store_id"], r["seq"]): r["surprise"] for r in dense.surprise(held, fresh).select("store_id", "seq", F.round("surprise", 9).alias("surprise")).collect()}
    assert got == {(0, 3): 1.0, (0, 4): 0.0}
