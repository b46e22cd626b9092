"""Quality rules (6): counts over whole texts, then a hashed word and character n-gram logistic regression.

The model is trained on a bounded sample of labelled rows (SAMPLE of each class, those with the smallest keyed hash of
doc_id), its scores are calibrated on held-out rows of that sample by a logistic curve, and documents are scored in Arrow
batches against one fixed threshold.  Features: word 1- and 2-grams and character 3-grams, each hashed into 4,096 places,
log counts, unit length.

Defined results: a null or empty text has no words, fails the base rule and is not kept; without labels of both classes
there is no model and the base rule alone decides; labels of one document that differ count as the lowest; extra columns
are not read; repeated rows each get their own result row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, NOT_SPACE, Words, by_batch, chunks, mix, small_batches

DIMS = 4096
#: Labelled rows of each class that the fit may read.
SAMPLE = 1000
#: Documents with a lower calibrated probability of good quality are rejected.
THRESHOLD = 0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(words: Words, texts: list[bytes]) -> dict[str, np.ndarray]:
    n = len(texts)
    doc_of = np.repeat(np.arange(n), words.sizes + 1)
    lead = (words.buf & 0xC0) != 0x80  # first bytes of code points
    hashes, docs, at = words.windows(5)
    order = np.lexsort((hashes, docs))
    same = (hashes[order][1:] == hashes[order][:-1]) & (docs[order][1:] == docs[order][:-1])
    twice = np.zeros(len(at) + 1, bool)
    twice[1:-1] = same
    twice = twice[:-1] | np.append(same, False)[: len(at)] if len(at) else np.zeros(0, bool)
    begin = np.zeros(len(words.hash) + 1, np.int64)
    hit = at[order][twice]
    np.add.at(begin, hit, 1)
    np.add.at(begin, np.minimum(hit + 5, len(words.hash)), -1)
    covered = np.cumsum(begin)[:-1] > 0
    lines = []
    for t in texts:
        own = [x for x in t.split(b"\n") if x.strip(b" \t\r\x0b\x0c")] if b"\n" in t else ()
        lines.append(len(own) - len(set(own)))
    return {
        "n_words": words.count,
        "word_chars": np.bincount(doc_of[words.mask & lead], minlength=n),
        "n_symbols": np.bincount(doc_of[_SYMBOL[words.buf]], minlength=n),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": np.bincount(words.doc[covered], minlength=n),
    }


def features(words: Words) -> np.ndarray:
    """One row of 2 x DIMS per document: word n-grams, then character n-grams."""
    n = len(words.sizes)
    pair, pair_doc, _ = words.windows(2)
    place = np.concatenate((words.hash, pair)) % np.uint64(DIMS)
    tokens = np.bincount(np.concatenate((words.doc, pair_doc)) * DIMS + place.astype(np.int64), minlength=n * DIMS)
    b = words.buf.astype(np.uint32)
    grams = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
    doc_of = np.repeat(np.arange(n, dtype=np.int64), words.sizes + 1)[:-2]
    chars = np.bincount(doc_of * DIMS + grams, minlength=n * DIMS)
    out = np.empty((n, 2 * DIMS), np.float32)
    for k, x in enumerate((tokens, chars)):
        x = np.log1p(x.reshape(n, DIMS).astype(np.float32))
        out[:, k * DIMS : (k + 1) * DIMS] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # of the calibration
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias) + self.shift, -30, 30)))


def _descend(x: np.ndarray, y: np.ndarray, used: np.ndarray, penalty: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Nesterov's accelerated descent, classes weighted alike; rows not used weigh nothing, which spares a copy."""
    weight = used * np.where(y > 0, 0.5 / max(y[used].sum(), 1), 0.5 / max((1 - y[used]).sum(), 1))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c = w.copy(), b
    for k in range(steps):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y)
        w2, b2 = v - rate * (x.T @ g.astype(np.float32) + penalty * v), c - rate * float(g.sum())
        v, c = w2 + k / (k + 3) * (w2 - w), b2 + k / (k + 3) * (b2 - b)
        w, b = w2, b2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
    """held: rows that only the calibration reads."""
    if not 0 < y[~held].sum() < (~held).sum():
        held = np.zeros(len(y), bool)
    w, b = _descend(x, y, ~held, 1e-4, 300, 1.0)
    at = held if 0 < y[held].sum() < held.sum() else ~held
    score = (x @ w + b)[:, None]
    scale = max(float(np.abs(score[at]).mean()), 1e-6)
    slope, shift = _descend((score / scale).astype(np.float32), y, at, 1e-3, 500, 1.0)
    return Model(w, b, max(float(slope[0]) / scale, 1e-6), shift)


def _sample_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for start, texts in chunks(frame["text"], rows=128):
            x = features(Words([t.encode() for t in texts], NOT_SPACE))
            rows = frame.iloc[start : start + len(texts)]
            at = [np.flatnonzero(r) for r in x]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "label": rows["label"], "at": [k.astype("<u2").tobytes() for k in at], "x": [r[k].astype("<f4").tobytes() for r, k in zip(x, at, strict=True)]})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model, from at most ``sample`` rows of each class; None if a class has no row."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample) for k in (0, 1)]
    picked = chosen[0].union(chosen[1])  # at most 2 x sample rows of 12 bytes: small enough to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # an id may have many rows: of its texts the one that hashes least is fitted, so the driver gets a row an id
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("doc_id", "label", F.col("first.text").alias("text"))
    got = rows.mapInPandas(_sample_features, "doc_id long, label int, at binary, x binary").toPandas().sort_values("doc_id")
    if got["label"].nunique() < 2:
        return None
    x = np.zeros((len(got), 2 * DIMS), np.float32)
    for row, at, values in zip(x, got["at"], got["x"], strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(values, "<f4")
    held = mix(got["doc_id"].to_numpy(np.int64).view(np.uint64) + GOLD) % np.uint64(5) == 0
    return fit(x, got["label"].to_numpy(np.float32), held)


def _judge(model: Model | None, threshold: float, texts: list[str]) -> dict[str, np.ndarray]:
    encoded = [t.encode() for t in texts]
    words = Words(encoded, NOT_SPACE)
    out = base_counts(words, encoded)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["quality"] = model.probability(features(words)).astype(np.float64) if model else np.ones(len(texts))
    out["kept"] = ~out["base_failed"] & (out["quality"] >= threshold)
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: the counts, base_failed, the calibrated probability of good quality, and the verdict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start, texts in chunks(frame["text"], rows=256):
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[start : start + len(texts)].array} | _judge(model, threshold, texts))

    return by_batch(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, SCHEMA)


def verdict(model: Model | None, threshold: float = THRESHOLD) -> Callable:
    """A column function of the text: is it kept?"""

    def run(texts: pd.Series) -> pd.Series:
        parts = [_judge(model, threshold, held)["kept"] for _, held in chunks(texts, rows=256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules and the model keep."""
    model = train(docs, labels)
    return docs.where(verdict(model)(F.col("text").cast("string")))
