"""Fill-in-middle transformation (12): prefix, middle and suffix of each text, cut between lines and put into another order.

One numpy kernel cuts all texts of an Arrow batch together, on the batch's UTF-8 bytes: a table gives each byte's class, a mask marks the
bytes that follow a line feed or open a text, cumulative sums that start anew with each text count lines and characters, and searchsorted
finds the byte at which a text's k-th line ends.  The cuts and the form come from the SHA-256 of seed and doc_id, so a task that is
run again gives the same rows.

Defined results: a null text is empty; empty texts, and those that hold one of the three marks, are plain; rows that share an id share
its hash, each with its own text; a null id hashes as no digits; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of texts that the kernel takes at a time (a longer text is taken alone).
SLICE = 4 << 20

#: Classes of bytes: a line feed, the first byte of a character.
FEED, FIRST = 1, 2
_CLASS = np.full(256, FIRST, np.uint8)
_CLASS[0x80:0xC0] = 0
_CLASS[10] |= FEED


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and the places between its texts."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to ``limit`` bytes, of one text at least."""
    start = 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


class Lines:
    """The lines of some texts (a line ends behind its line feed), and places between them."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.at = at
        kind = _CLASS[data]
        opens = np.zeros(len(data), bool)
        opens[1:] = kind[:-1] & FEED
        opens[at[:-1][at[:-1] < at[1:]]] = True
        self._lines = np.concatenate(([0], np.cumsum(opens)))
        self._characters = np.concatenate(([0], np.cumsum(kind >> 1)))
        self.count = self._lines[at[1:]] - self._lines[at[:-1]]

    def end(self, k: np.ndarray) -> np.ndarray:
        """The byte behind each text's first k lines."""
        place = np.searchsorted(self._lines, self._lines[self.at[:-1]] + k + 1) - 1
        return np.where(k >= self.count, self.at[1:], np.maximum(place, self.at[:-1]))

    def characters(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self._characters[stop] - self._characters[start]


def _strings(parts: list[bytes], sizes: np.ndarray) -> pa.Array:
    """An array of strings whose bytes stand in parts."""
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(b"".join(parts)))


def _hashes(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers of each id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _marked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and letters of the marks."""
    place = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62) & np.isin(data[1:-1], np.frombuffer(b"PSM", np.uint8))) if len(data) > 2 else np.zeros(0, np.int64)
    return place, data[place + 1]


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _transform(ids: list, data: np.ndarray, at: np.ndarray, seed: int, rate: int, spm: int) -> pa.RecordBatch:
    lines, h = Lines(data, at), _hashes(ids, seed)
    one, two = h[:, 0] % (lines.count + 1), h[:, 1] % (lines.count + 1)
    start, a, b, stop = at[:-1], lines.end(np.minimum(one, two)), lines.end(np.maximum(one, two)), at[1:]
    # a mark of a text lies inside it: the text that holds its first byte holds its last
    place, _ = _marked(data)
    text = np.searchsorted(at, place, "right") - 1
    plain = (start == stop) | (h[:, 2] % 100 >= rate)
    plain[text[place + 3 <= at[text + 1]]] = True
    last = h[:, 3] % 100 < spm
    raw = memoryview(data)
    parts: list = []
    for s, x, y, e, is_plain, is_spm in zip(start.tolist(), a.tolist(), b.tolist(), stop.tolist(), plain.tolist(), last.tolist(), strict=True):
        if is_plain:
            parts.append(raw[s:e])
        elif is_spm:
            parts += (SUFFIX, raw[y:e], PREFIX, raw[s:x], MIDDLE, raw[x:y])
        else:
            parts += (PREFIX, raw[s:x], SUFFIX, raw[y:e], MIDDLE, raw[x:y])
    form = np.where(plain, "plain", np.where(last, "spm", "psm"))
    output = _strings(parts, stop - start + np.where(plain, 0, len(PREFIX + SUFFIX + MIDDLE)))
    counts = [pa.array(lines.characters(*x), mask=plain) for x in ((start, a), (a, b))]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines.count), pa.array(form.tolist(), pa.string()), *counts, output], schema=_OUT)


def _restored(forms: np.ndarray, data: np.ndarray, at: np.ndarray) -> pa.Array:
    place, letter = _marked(data)
    order = {mark: place[letter == mark[1]] for mark in (PREFIX, SUFFIX, MIDDLE)}
    raw = memoryview(data)
    parts: list = []
    nth = {mark: np.searchsorted(order[mark], at[:-1]).tolist() for mark in order}
    size = at[1:] - at[:-1] - np.where(forms == "plain", 0, len(PREFIX + SUFFIX + MIDDLE))
    for k, (s, e, form) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), forms, strict=True)):
        if form == "plain":
            parts.append(raw[s:e])
            continue
        p, x, m = (int(order[mark][nth[mark][k]]) for mark in (PREFIX, SUFFIX, MIDDLE))
        prefix, suffix = (raw[p + 3 : m], raw[x + 3 : p]) if form == "spm" else (raw[p + 3 : x], raw[x + 3 : m])
        parts += (prefix, raw[m + 3 : e], suffix)
    return _strings(parts, size)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output: one row per document.

    rate, spm: how many in a hundred are cut, and how many of those have their suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(pc.fill_null(batch.column(1), ""))
            ids = batch.column(0).to_pylist()
            for i, j in slices(at):
                yield _transform(ids[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i], seed, rate, spm)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """rows of transform() with restored, the text rebuilt from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("output"))
            forms = np.array(batch.column("form").to_pylist(), object)
            for i, j in slices(at):
                restored = _restored(forms[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns], restored], [*batch.schema.names, "restored"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("restored", StringType())]))


def digests(docs: DataFrame) -> DataFrame:
    """transform() with the SHA-256 of output and of the restored text in place of the texts."""
    rows = restore(transform(docs))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
