"""Texts to vectors: a registry of encoders, hashed word n-grams, tables of known vectors, and a cache in files.

An encoder is a function of a batch of texts (a pandas Series) that gives their vectors, with its dimension and what goes before a
document's or a question's text.  All work on a column of a DataFrame, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Conflict, Versions
from .text import ENCODER_TOKEN

#: Model, what goes before a question, what goes before a document.
PREFIXES = {
    "minilm": ("sentence-transformers/all-MiniLM-L6-v2", "", ""),
    "bge-small": ("BAAI/bge-small-en-v1.5", "Represent this sentence for searching relevant passages: ", ""),
    "e5-small": ("intfloat/e5-small-v2", "query: ", "passage: "),
    "gte-small": ("thenlper/gte-small", "", ""),
}


@dataclass(frozen=True)
class Encoder:
    dim: int
    run: Callable[[pd.Series], list[np.ndarray]]
    before_question: str = ""
    before_document: str = ""

    def _vectors(self, text: Column, before: str) -> Column:
        work = self.run

        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(work(texts.fillna("")))

        apply.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(apply, "array<float>")(F.concat(F.lit(before), F.coalesce(text, F.lit(""))))

    def documents(self, text: Column) -> Column:
        """The vectors of documents (null: the empty text)."""
        return self._vectors(text, self.before_document)

    def questions(self, text: Column) -> Column:
        return self._vectors(text, self.before_question)


@lru_cache(1 << 16)
def _place(gram: str, dim: int, seed: int) -> tuple[int, float]:
    number = int.from_bytes(hashlib.blake2b(f"{seed}:{gram}".encode(), digest_size=8).digest(), "little")
    return number % dim, 1.0 if number >= 1 << 63 else -1.0


def hashing(dim: int = 384, shortest: int = 1, longest: int = 2, seed: int = 0) -> Encoder:
    """Sums of signed places of word n-grams, of unit length.  An n-gram's BLAKE2b hash of 8 bytes, with the seed before it, gives its
    place and, by its highest bit, its sign; it weighs 1 / sqrt(n).  A text without words is the zero vector."""

    def run(texts: pd.Series) -> list[np.ndarray]:
        rows = []
        for text in texts:
            words, v = re.findall(ENCODER_TOKEN, text.lower()), np.zeros(dim)
            for n in range(shortest, longest + 1):
                spots = [_place(" ".join(words[k : k + n]), dim, seed) for k in range(len(words) - n + 1)]
                if spots:
                    at, sign = zip(*spots, strict=True)
                    v += np.bincount(at, np.array(sign) / n**0.5, dim)
            rows.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32))
        return rows

    return Encoder(dim, run)


REGISTRY: dict[str, Encoder] = {"hashing": hashing()}


def register(name: str, encoder: Encoder) -> None:
    if name in REGISTRY:
        raise ValueError(f"there is an encoder {name} already")
    REGISTRY[name] = encoder


def key_of(text: Column) -> Column:
    """What names a text in tables of vectors."""
    return F.sha2(text, 256)


def from_tables(rows: DataFrame, documents: DataFrame, questions: DataFrame, text: str = "text") -> DataFrame:
    """rows with v from the table of documents' vectors (key, v), or else of questions' (key, v); null if neither has the text."""
    known = rows.withColumn("key", key_of(F.col(text)))
    known = known.join(documents.select("key", F.col("v").alias("v1")), "key", "left").join(questions.select("key", F.col("v").alias("v2")), "key", "left")
    return known.withColumn("v", F.coalesce("v1", "v2")).select(*rows.columns, "v")


VECTORS = "key string, v array<float>, bucket int"


def cached(rows: DataFrame, encoder: Encoder, path: str, text: str = "text", buckets: int = 16, tries: int = 20) -> DataFrame:
    """rows with v.  Vectors of texts that the cache at path lacks are made once each and added to it; null texts get none.

    The cache is a table in versions: a commit adds to the newest version only, and what another writer has added meanwhile is
    left out before the next try, so a key has one row whoever writes, and a job that is killed adds all or nothing."""
    tables = Versions(rows.sparkSession, path)
    keyed = rows.withColumn("key", key_of(F.concat(F.lit(encoder.before_document), F.col(text))))
    read = lambda version, only=None: tables.read("vectors", version, VECTORS, only)
    missing = keyed.where("key IS NOT NULL").groupBy("key").agg(F.first(text).alias("said")).join(read(tables.version()).select("key"), "key", "left_anti")
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    made = tables.stage(missing.select("key", encoder.documents(F.col("said")).cast("array<float>").alias("v"), bucket), "made")
    touched = [r[0] for r in made.select("bucket").distinct().collect()]
    for _ in range(tries if touched else 0):
        version = tables.version()
        held = read(version, touched)
        fresh = made.join(held.select("key"), "key", "left_anti")
        if fresh.isEmpty():
            break
        try:
            tables.commit(version, {"vectors": (held.unionByName(fresh), touched)})
            break
        except Conflict:
            continue
    else:
        if touched:
            raise Conflict(f"{tries} commits to {path} came too late")
    return keyed.join(read(tables.version()).select("key", "v"), "key", "left").drop("key")
