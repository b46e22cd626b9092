"""What the operators share: tables, checkpoints, and words hashed in numpy, many documents at once."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, upper case taken in: digits, letters and all of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share (spark.checkpoint.dir).  Only a local session may have one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="shared")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems hold it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shared(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the shared folder of the cluster.

    spark.cleaner.referenceTracking.cleanCheckpoints, set when a session starts, lets Spark delete those that are not used any more."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    cut = df.checkpoint()._jdf
    # a checkpoint keeps its plan's size estimate; a join multiplies those, and over loops they grow to numbers of many
    # thousand digits.  The same rows as a new frame have none, and adaptive execution goes by what it measures.
    return DataFrame(cut.sparkSession().internalCreateDataFrame(cut.queryExecution().toRdd(), cut.schema(), False), df.sparkSession)


def small_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch holds: some documents are a hundred thousand characters long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def by_batch(df: DataFrame, run: Callable, schema: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """mapInPandas with bounded batches; ids cross as text, for pandas has no whole numbers beside nulls."""
    small_batches(df.sparkSession)
    for c in ids:
        schema = schema.replace(f"{c} long", f"{c} string")
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("long").cast("string"))
    out = df.mapInPandas(run, schema)
    return out.select(*[F.col(c).cast("long").alias(c) if c in ids else F.col(c) for c in out.columns])


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result hangs on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLD = np.uint64(0x9E3779B97F4A7C15)


def gold(k: int) -> np.uint64:
    """The k-th multiple of GOLD."""
    return np.uint64(int(GOLD) * k & 0xFFFFFFFFFFFFFFFF)


_BASE = np.uint64(0x100000001B3)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Words:
    """The words of some texts, in order: 64-bit hashes, document numbers, and starts of documents.

    texts: bytes of UTF-8.  A word is a run of bytes that ``kind`` allows.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]
        self.mask = kind[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], self.mask.view(np.int8), [0]))))
        self.starts, self.ends = edge[::2], edge[1::2]
        lengths = self.ends - self.starts
        first = np.cumsum(lengths) - lengths
        self.doc = np.searchsorted(self.at, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count
        if len(lengths):
            b = self.buf[self.mask].astype(np.uint64) + np.uint64(1)
            b *= powers(int(lengths.max()))[np.arange(len(b)) - np.repeat(first, lengths)]
            self.hash = mix(np.add.reduceat(b, first) + lengths.astype(np.uint64) * GOLD)
        else:
            self.hash = np.zeros(0, np.uint64)

    def windows(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and first word of each run of n words; short: a document of fewer words has one run of them all."""
        total = len(self.hash)
        out = np.zeros(max(total - n + 1, 0), np.uint64)
        for k in range(n):
            out = mix(out * GOLD + self.hash[k : k + len(out)] + np.uint64(k + 1))
        inside = self.doc[: len(out)] == self.doc[n - 1 :] if len(out) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        hashes, docs = out[at], self.doc[at]
        if short and len(few := np.flatnonzero((self.count > 0) & (self.count < n))):
            more = np.zeros(len(few), np.uint64)
            for k in range(n - 1):
                here = self.count[few] > k
                more[here] = mix(more[here] * GOLD + self.hash[self.first[few][here] + k] + np.uint64(k + 101))
            hashes, docs, at = np.concatenate((hashes, more)), np.concatenate((docs, few)), np.concatenate((at, self.first[few]))
        return hashes, docs, at


def word_hash(word: str) -> np.uint64:
    return Words([word.encode()], np.ones(256, bool) & (np.arange(256) != 10)).hash[0]


def chunks(texts: Iterable[str | None], limit: int = 1 << 20, rows: int = 512) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``limit`` characters (null: empty), with the number of the first; a longer text is a run of its own."""
    held: list[str] = []
    size = start = 0
    for k, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if held and (size + len(text) > limit or len(held) >= rows):
            yield start, held
            held, size, start = [], 0, k
        held.append(text)
        size += len(text)
    if held:
        yield start, held
