"""Dense scoring: blocks of questions against blocks of rows, as matrix products.

Rows and questions of a store are dealt into blocks by hash, and each pair of blocks is one group of bounded size: nothing is
collected, nothing is sent to all tasks, and a store that holds most rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and questions of a block, on average; questions whose products are held at once.
ROWS, QUESTIONS, HELD = 4096, 4096, 512
#: Blocks of a store whose blocks are smaller; bins of a histogram.
FEW, BINS = 16, 48
#: Rows and questions of a block where little but the greatest product is kept: vectors are copied for each block of the other side.
LARGE = 32768


def _blocks(rows: DataFrame, questions: DataFrame, keys: list[str], per: tuple[int, int] = (ROWS, QUESTIONS), usual: tuple[int, int] = (ROWS, QUESTIONS)) -> tuple[DataFrame, DataFrame]:
    """Both sides with rb and qb: each row once for each block of its store's questions, and the reverse."""
    # a smaller block than usual is for small stores: a large one has FEW blocks, or as many as with usual ones
    blocks = lambda n, of, usual: F.when(n <= of * FEW, F.ceil(n / of)).otherwise(F.greatest(F.lit(FEW), F.ceil(n / usual))) if of < usual else F.ceil(n / of)
    size = lambda df, of, usual, name: df.groupBy("store_id").agg(blocks(F.count("*"), of, usual).cast("int").alias(name))
    sizes = size(rows, per[0], usual[0], "row_blocks").join(size(questions, per[1], usual[1], "question_blocks"), "store_id")
    own = lambda n, *k: F.pmod(F.xxhash64(*k), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, "store_id").withColumn("rb", own("row_blocks", *keys)).withColumn("qb", every("question_blocks")).drop("row_blocks", "question_blocks")
    right = questions.join(sizes, "store_id").withColumn("qb", own("question_blocks", "qid")).withColumn("rb", every("row_blocks")).drop("row_blocks", "question_blocks")
    return left, right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])  # both may come from one table


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def pairs(rows: DataFrame, questions: DataFrame, keys: list[str], run: Callable, schema: str, form: Callable = matrix, per: tuple[int, int] = (ROWS, QUESTIONS)) -> DataFrame:
    """run(a, b, s) of each block of rows a (store_id, keys, v and more) and questions b (store_id, qid, v and more; their names end with _),
    in order of their keys, with s, the products of at most HELD questions and the rows.  Rows and questions without a vector are left out.

    form: makes the matrices of v."""
    left, right = _blocks(rows.where("v IS NOT NULL"), questions.where("v IS NOT NULL"), keys, per)
    names = [c.split()[0] for c in schema.split(", ")]

    def block(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(a) and len(b):
            a = a.sort_values(keys, kind="stable").reset_index(drop=True)
            b = b.sort_values("qid_", kind="stable").reset_index(drop=True)
            x = form(a["v"]).T
            for start in range(0, len(b), HELD):
                part = b.iloc[start : start + HELD].reset_index(drop=True)
                yield run(a, part, form(part["v_"]) @ x)[names]

    def every(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = list(block(a, b))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    by = ["store_id", "rb", "qb"]
    return left.groupBy(*by).cogroup(right.groupBy(*[f"{c}_" for c in by])).applyInPandas(every, schema)


def best(s: np.ndarray, k: int, places: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Question and row numbers of the k best scores of each question, ties (of so many places) in order of the rows."""
    if k >= s.shape[1]:
        return np.repeat(np.arange(len(s)), s.shape[1]), np.tile(np.arange(s.shape[1]), len(s))
    near = np.round(s, places)
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1]  # the k-th best, and what ties with it
    q, r = np.nonzero(near >= least[:, None])
    order = np.lexsort((r, -near[q, r], q))
    q, r = q[order], r[order]
    top = np.arange(len(q)) - np.searchsorted(q, np.arange(len(s)))[q] < k
    return q[top], r[top]


def products(rows: DataFrame, questions: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """store_id, qid, keys, score: the dot products of the questions (store_id, qid, v) and rows (store_id, keys, v) of each store.

    k: a block keeps the k best rows of each question, ties by keys.  Rows without a vector have no score.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in ("store_id", "qid", *keys)) + ", score double"

    def run(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        q, r = best(s, len(a) if k is None else k)
        return a.iloc[r][["store_id", *keys]].reset_index(drop=True).assign(qid=b["qid_"].to_numpy()[q], score=s[q, r])

    return pairs(rows.select("store_id", *keys, "v"), questions.select("store_id", "qid", "v"), keys, run, schema, per=(ROWS, QUESTIONS if k else HELD))


def top(rows: DataFrame, questions: DataFrame, keys: list[str], k: int, score: Callable, places: int = 6) -> DataFrame:
    """store_id, qid, keys, score, rank: the k best of each question by score(a, b, s), a matrix for each block; ties by keys."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in ("store_id", "qid", *keys)) + ", score double"

    def run(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s = score(a, b, s)
        q, r = best(s, k, places)
        return a.iloc[r][["store_id", *keys]].reset_index(drop=True).assign(qid=b["qid_"].to_numpy()[q], score=s[q, r])

    rank = F.row_number().over(Window.partitionBy("store_id", "qid").orderBy(F.desc(F.round("score", places)), *keys))
    return pairs(rows, questions, keys, run, schema).withColumn("rank", rank).where(F.col("rank") <= k)


def spreads(rows: DataFrame, questions: DataFrame, keys: list[str], beta: float = 0.0, others: bool = False) -> DataFrame:
    """store_id, qid, n, low, high, mean, spread, whole (the sum of exp(beta * (score - high))) of each question's scores; a row for each block
    and question is moved, none for a score.  others: without the row of the question's own key (of one column)."""

    def run(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        on = np.ones(s.shape, bool) if not others else a[keys[0]].to_numpy()[None, :] != b["qid_"].to_numpy()[:, None]
        n, total = on.sum(axis=1), s.sum(axis=1, where=on)
        mean, high = total / np.maximum(n, 1), s.max(axis=1, where=on, initial=-np.inf)
        out = pd.DataFrame({"store_id": b["store_id_"], "qid": b["qid_"], "n": n, "low": s.min(axis=1, where=on, initial=np.inf), "high": high, "total": total})
        whole = np.exp(beta * (s - high[:, None])).sum(axis=1, where=on) if beta else 0.0
        return out.assign(squares=((s - mean[:, None]) ** 2).sum(axis=1, where=on), whole=whole)[n > 0]

    parts = pairs(rows, questions, keys, run, "store_id long, qid long, n long, low double, high double, total double, squares double, whole double")
    sums = parts.groupBy("store_id", "qid").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", "high", "total", "squares", "whole")).alias("parts"))
    square = F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["squares"] + p["n"] * F.pow(p["total"] / p["n"] - F.col("mean"), F.lit(2.0)))
    whole = F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["whole"] * F.exp(F.lit(float(beta)) * (p["high"] - F.col("high"))))
    return sums.select("store_id", "qid", "n", "low", "high", "mean", F.sqrt(square / F.col("n")).alias("spread"), whole.alias("whole"))


def percentile(rows: DataFrame, questions: DataFrame, keys: list[str], known: DataFrame, p: float, others: bool = False, rounds: int = 2) -> DataFrame:
    """store_id, qid, value: the percentile of each question's scores, between the two next to it, exactly.  known: spreads() of the same.

    Histograms of blocks narrow down where the two are; then only the scores there are moved, equal ones of a block as one."""
    at = known.select("store_id", "qid", "n", F.col("low").alias("lo"), F.col("high").alias("hi"))
    counts = ", ".join(f"h{i} int" for i in range(BINS + 1))

    def on(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> np.ndarray:
        return np.where(a[keys[0]].to_numpy()[None, :] == b["qid_"].to_numpy()[:, None], np.inf, s) if others else s

    def histogram(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s, lo, hi = on(a, b, s), b["lo_"].to_numpy()[:, None], b["hi_"].to_numpy()[:, None]
        bins = np.where(s < lo, 0, np.where(s <= hi, 1 + np.minimum(np.where(s <= hi, s - lo, 0.0) / np.maximum(hi - lo, 1e-300) * BINS, BINS - 1).astype(np.int64), BINS + 1))
        flat = np.bincount((bins + np.arange(len(b))[:, None] * (BINS + 2)).ravel(), minlength=len(b) * (BINS + 2)).reshape(len(b), -1)[:, :-1]
        return pd.concat([b[["store_id_", "qid_", "n_", "lo_", "hi_"]].set_axis(["store_id", "qid", "n", "lo", "hi"], axis=1), pd.DataFrame(flat, columns=[f"h{i}" for i in range(BINS + 1)])], axis=1)

    def narrowed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            upto = np.cumsum(f[[f"h{i}" for i in range(BINS + 1)]].to_numpy(), axis=1)
            place = p * (f["n"].to_numpy() - 1)
            lo, hi, step = f["lo"].to_numpy(), f["hi"].to_numpy(), (f["hi"] - f["lo"]).to_numpy() / BINS
            first, last = ((upto <= np.minimum(x, f["n"].to_numpy() - 1)[:, None]).sum(axis=1) - 1 for x in (np.floor(place), np.floor(place) + 1))
            # a little wider, for the rounding of edges
            yield f[["store_id", "qid", "n"]].assign(lo=np.maximum(lo, lo + step * (first - 1e-6)), hi=np.minimum(hi, lo + step * (last + 1 + 1e-6)))

    for _ in range(rounds):
        held = pairs(rows, questions.join(at, ["store_id", "qid"]), keys, histogram, f"store_id long, qid long, n long, lo double, hi double, {counts}")
        sums = held.groupBy("store_id", "qid", "n", "lo", "hi").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(BINS + 1)])
        at = sums.mapInPandas(narrowed, "store_id long, qid long, n long, lo double, hi double")

    def inside(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s, lo, hi = on(a, b, s), b["lo_"].to_numpy()[:, None], b["hi_"].to_numpy()[:, None]
        q, r = np.nonzero((s >= lo) & (s <= hi))
        some = pd.DataFrame({"q": q, "value": s[q, r]}).groupby(["q", "value"], as_index=False).size()
        some = pd.concat([some.rename(columns={"size": "times"}), pd.DataFrame({"q": np.arange(len(b)), "value": -np.inf, "times": (s < lo).sum(axis=1)})])
        return pd.DataFrame({"store_id": b["store_id_"].to_numpy()[some["q"]], "qid": b["qid_"].to_numpy()[some["q"]], "n": b["n_"].to_numpy()[some["q"]], "value": some["value"].to_numpy(), "times": some["times"].to_numpy()})

    got = pairs(rows, questions.join(at, ["store_id", "qid"]), keys, inside, "store_id long, qid long, n long, value double, times long")
    got = got.groupBy("store_id", "qid", "n", "value").agg(F.sum("times").alias("times"))
    upto = F.sum("times").over(Window.partitionBy("store_id", "qid").orderBy("value"))
    got = got.withColumn("upto", upto).withColumn("place", p * (F.col("n") - 1))
    nth = lambda x: F.min(F.when((F.col("value") > float("-inf")) & (F.col("upto") > x), F.col("value")))
    got = got.groupBy("store_id", "qid").agg(nth(F.floor("place")).alias("a"), nth(F.least(F.floor("place") + 1, F.col("n") - 1)).alias("b"), F.first("place").alias("place"))
    return got.select("store_id", "qid", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("value"))


def scores(rows: DataFrame, questions: DataFrame, k: int | None) -> DataFrame:
    """qid, id, score of questions (qid, v) and rows (id, v) of a single store; k: the best of each question, with their rank."""
    one = F.lit(0).cast("long").alias("store_id")
    out = products(rows.select(one, "id", "v"), questions.select(one, "qid", "v"), ["id"], k).drop("store_id")
    if k is None:
        return out
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def novelty(rows: DataFrame, block: int = 1024) -> DataFrame:
    """store_id, seq, novelty: 1 - the greatest dot product with an earlier row of the store, between 0 and 1; 1 for the first.

    A store is dealt into blocks of about so many rows, or more where it is large, by hash: numbers may have gaps.
    """
    rows = rows.select("store_id", "seq", "v")

    def run(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s[a["seq"].to_numpy()[None, :] >= b["qid_"].to_numpy()[:, None]] = -np.inf
        return pd.DataFrame({"store_id": b["store_id_"], "seq": b["qid_"], "most": s.max(axis=1)})

    most = pairs(rows, rows.withColumnRenamed("seq", "qid"), ["seq"], run, "store_id long, seq long, most double", per=(block, block))
    most = most.groupBy("store_id", "seq").agg(F.max("most").alias("most"))
    return most.select("store_id", "seq", F.when(F.col("most") == float("-inf"), 1.0).otherwise(F.least(F.greatest(1 - F.col("most"), F.lit(0.0)), F.lit(1.0))).alias("novelty"))


def surprise(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """store_id, seq, surprise of the fresh rows (store_id, seq, v): 1 - the greatest dot product with a row of the store that was written
    before (held: store_id, seq, last, v; or fresh) and that write number seq still finds (last), between 0 and 1.  Without such a
    row there is no result."""
    fresh = fresh.where("v IS NOT NULL")
    rows = held.where("v IS NOT NULL").unionByName(fresh.withColumn("last", F.lit(2**62)))
    left, right = _blocks(rows, fresh.select("store_id", F.col("seq").alias("qid"), "v"), ["seq"], usual=(LARGE, LARGE))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["store_id", "seq", "most"])
        x, seq, last, now = matrix(a["v"]).T, a["seq"].to_numpy()[None], a["last"].to_numpy()[None], b["qid_"].to_numpy()
        most = np.empty(len(b))
        for start in range(0, len(b), HELD):
            part = slice(start, start + HELD)
            s = matrix(b["v_"].iloc[part]) @ x
            s[(seq >= now[part, None]) | (last < now[part, None])] = -np.inf
            most[part] = s.max(axis=1)
        return pd.DataFrame({"store_id": b["store_id_"].to_numpy(), "seq": now, "most": most})

    by = ["store_id", "rb", "qb"]
    most = left.groupBy(*by).cogroup(right.groupBy(*[f"{c}_" for c in by])).applyInPandas(run, "store_id long, seq long, most double")
    most = most.groupBy("store_id", "seq").agg(F.max("most").alias("most")).where(F.col("most") > float("-inf"))
    return most.select("store_id", "seq", F.least(F.greatest(1 - F.col("most"), F.lit(0.0)), F.lit(1.0)).alias("surprise"))
