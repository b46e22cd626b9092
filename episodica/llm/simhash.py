"""SimHash near-dedup (11): generalised pigeonhole search of fingerprints that differ in few bits, and their components.

A fingerprint has 64 bits: bit k is 1 if more than half of the XXH64 hashes (seed 42) of a text's three-word shingles have it, repeats
counted (words: runs without white space, A-Z lower-cased; fewer words are one shingle; no words: fingerprint zero, linked like any other).

* Equal fingerprints are one node, so copies meet nobody.
* Correlated bits are grouped: from the 64 x 64 counts of bits that are set together, eight blocks of eight bits are grown, each
  from its most correlated pair; partitions are runs of blocks.  Skew then gathers in few partitions, and the others stay selective.
* Generalised pigeonhole: with m partitions and thresholds t_i >= -1 that sum to 3 - m + 1, two fingerprints within 3 bits differ in
  some partition i by t_i or less (-1: the partition is not looked at).  Each fingerprint has thresholds of its own: dynamic programming
  takes those with the fewest estimated candidates and probes; estimates come from the 256 counts of each block.  m is the
  number of partitions with the least expected cost: more rows take fewer, longer partitions.
* All fingerprints are indexed by the value of every partition; a fingerprint probes all values within its thresholds.  Members of a
  bucket of up to SMALL meet each other inside a task, which gives stars, not pairs.  In a larger bucket all meet one pivot; where members
  of different components are left, the bucket is split by the pigeonhole again, on its free bits, until buckets are small or of one
  component.  So no group of near copies is written in pairs, and no link between components is lost.

Defined results: a null text has no words; rows that share a doc_id are rows of their own, each with its text's fingerprint; a
null doc_id takes part in its component, whose least doc_id it gets (null if there is none); other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gold, mix
from .scratch import Scratch, beside, components, spanning

BITS, SHINGLE, SEED, DISTANCE = 64, 3, 42, 3
#: Bits of a block; what a probe costs beside a candidate, in the choice of thresholds.
BLOCK, PROBE = 8, 4.0
#: Members of a bucket that all meet each other; free bits of a bucket that is not split any more.
SMALL, LAST = 1024, 12
_BLOCKS = BITS // BLOCK
_DIFFER = np.array([[(u ^ v).bit_count() for v in range(1 << BLOCK)] for u in range(1 << BLOCK)])


# ---- fingerprints
def _hashes(text: str) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < SHINGLE:
        return [h(join(words), SEED)]
    return [h(join(w), SEED) for w in zip(words, words[1:], words[2:], strict=False)]


def bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each value, bit 0 first."""
    return np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(text: str, chunk: int = 1 << 16) -> int:
    h = np.array(_hashes(text), np.uint64)
    total = sum((bits(h[k : k + chunk]).sum(0, dtype=np.int64) for k in range(0, len(h), chunk)), np.zeros(BITS, np.int64))
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.fromiter((fingerprint(t.as_py() or "") for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number): one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


# ---- partitions and thresholds
def _values(batch: pa.RecordBatch, name: str = "fp") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def together(nodes: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits set.  4,096 partial sums a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = bits(_values(batch)).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    out = np.zeros(BITS * BITS)
    for r in nodes.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(BITS, BITS)


def blocks(both: np.ndarray, n: int) -> list[list[int]]:
    """Eight blocks of eight correlated bits, each grown from the most correlated pair that is left."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(mean * (1 - mean))
    with np.errstate(all="ignore"):
        tie = np.nan_to_num(np.abs(both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread), posinf=0.0)
    np.fill_diagonal(tie, 0)
    left, out = list(range(BITS)), []
    while left:
        near = tie[np.ix_(left, left)]
        i, j = divmod(int(near.argmax()), len(left))
        block = [left[i], left[j]] if i != j else left[:2]
        while len(block) < BLOCK:
            rest = [b for b in left if b not in block]
            block.append(max(rest, key=lambda b: (tie[b, block].mean(), -b)))
        out.append(sorted(block))
        left = [b for b in left if b not in block]
    return out


def _block_values(fps: np.ndarray, grouped: list[list[int]]) -> np.ndarray:
    """n x 8: the value of each block."""
    x = bits(fps)
    weight = (1 << np.arange(BLOCK)).astype(np.int64)
    return np.stack([x[:, b] @ weight for b in grouped], 1) if len(fps) else np.zeros((0, _BLOCKS), np.int64)


def histograms(nodes: DataFrame, grouped: list[list[int]]) -> np.ndarray:
    """8 x 256: how many fingerprints have each value of each block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_BLOCKS, 1 << BLOCK), np.int64)
        for batch in batches:
            for k, v in enumerate(_block_values(_values(batch), grouped).T):
                total[k] += np.bincount(v, minlength=1 << BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "n"])

    out = np.zeros(_BLOCKS << BLOCK)
    for r in nodes.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(_BLOCKS, 1 << BLOCK)


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """n x m: numbers c >= 0 of sum ``total`` with the least sum of costs[:, i, c]: dynamic programming over the partitions."""
    n, m, most = costs.shape
    best = np.full((n, total + 1), np.inf)
    best[:, 0] = 0
    taken = []
    for i in range(m):
        options = np.full((n, total + 1, most), np.inf)
        for c in range(min(most, total + 1)):
            options[:, c:, c] = best[:, : total + 1 - c] + costs[:, i, c][:, None]
        taken.append(options.argmin(2))
        best = options.min(2)
    out = np.zeros((n, m), np.int64)
    left = np.full(n, total)
    for i in reversed(range(m)):
        out[:, i] = taken[i][np.arange(n), left]
        left = left - out[:, i]
    return out


class Scheme:
    """Partitions of the 64 bits, and estimates of what a threshold costs in each.  A closure of some 100 KB, whatever the table."""

    def __init__(self, grouped: list[list[int]], counts: np.ndarray, n: int, m: int):
        self.grouped, self.n, self.m = grouped, n, m
        self.runs = [list(r) for r in np.array_split(np.arange(_BLOCKS), m)]
        self.parts = [[b for k in run for b in grouped[k]] for run in self.runs]
        share = counts / max(n, 1)
        #: of all fingerprints, those that differ from a value of a block in 0, 1, 2, 3 bits
        self.apart = np.stack([np.stack([(share[k] * (_DIFFER == d)).sum(1) for d in range(DISTANCE + 1)], 1) for k in range(_BLOCKS)])
        self.expected = np.stack([(share[k][:, None] * self.apart[k]).sum(0) for k in range(_BLOCKS)])
        self.flips = [self._flips(part) for part in self.parts]

    @staticmethod
    def _flips(part: list[int]) -> list[np.ndarray]:
        """Masks of the part's bits, by how many are flipped."""
        one = [np.uint64(1 << b) for b in part]
        return [np.array([np.bitwise_or.reduce(np.array(c, np.uint64)) if c else np.uint64(0) for c in combinations(one, d)], np.uint64) for d in range(DISTANCE + 1)]

    def _costs(self, by_block: np.ndarray) -> np.ndarray:
        """n x m x 5: the cost of thresholds -1, 0, 1, 2, 3, from n x 8 x 4 shares by distance (blocks taken as independent)."""
        out = np.zeros((len(by_block), self.m, DISTANCE + 2))
        for i, run in enumerate(self.runs):
            near = by_block[:, run[0]]
            for k in run[1:]:
                near = np.stack([sum(near[:, a] * by_block[:, k, d - a] for a in range(d + 1)) for d in range(DISTANCE + 1)], 1)
            probes = np.cumsum([len(f) for f in self.flips[i]])
            out[:, i, 1:] = self.n * np.cumsum(near, 1) + PROBE * probes
        return out

    def cost(self) -> float:
        """What a fingerprint is expected to cost: rows of the index, probes and candidates."""
        costs = self._costs(self.expected[None])
        chosen = allocate(costs, DISTANCE + 1)[0]
        return self.m * PROBE + float(costs[0, np.arange(self.m), chosen].sum())

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """n x m: the thresholds of each fingerprint; a row sums to 3 - m + 1."""
        values = _block_values(fps, self.grouped)
        return allocate(self._costs(np.stack([self.apart[k][values[:, k]] for k in range(_BLOCKS)], 1)), DISTANCE + 1) - 1

    def probe(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bucket, fp, copies, ask, held, free: all buckets that hold a fingerprint or that it probes."""
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                fps, copies = _values(part), part.column("copies").to_numpy(zero_copy_only=False)
                chosen = self.thresholds(fps)
                for i, bits_of in enumerate(self.parts):
                    mask = np.uint64(sum(1 << b for b in bits_of))
                    free = np.int64(np.uint64(~mask).astype(np.int64))
                    for d in range(DISTANCE + 1):
                        own = np.flatnonzero(chosen[:, i] >= d) if d else np.arange(len(fps))
                        if len(own):
                            yield _members((fps[own, None] & mask) ^ self.flips[i][d], i, fps[own], copies[own], chosen[own, i] >= d, d == 0, free)


_MEMBERS = "bucket long, fp long, copies long, ask boolean, held boolean, free long"


def _members(values: np.ndarray, salt: int, fps: np.ndarray, copies: np.ndarray, ask: np.ndarray, held: bool, free: np.int64) -> pa.RecordBatch:
    """A row for each value (n x k) of each fingerprint.  Buckets whose hashes clash are one: that adds candidates, and loses none."""
    k = values.shape[1]
    bucket = mix(mix(values + gold(1)) + gold(salt + 2)).ravel().view(np.int64)
    columns = [bucket, np.repeat(fps.view(np.int64), k), np.repeat(copies, k), np.repeat(ask, k), np.full(len(bucket), held), np.full(len(bucket), free)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _MEMBERS.split(", ")])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets, in the buckets that four equal parts of the free bits make of each: two that are within 3 bits on the free bits
    are equal in one of the four."""
    for batch in batches:
        fps, buckets, free = _values(batch), _values(batch, "bucket"), _values(batch, "free")
        for f in np.unique(free):
            rows = np.flatnonzero(free == f)
            places = [b for b in range(BITS) if int(f) >> b & 1]
            for i, part in enumerate(np.array_split(places, DISTANCE + 1)):
                mask = np.uint64(sum(1 << int(b) for b in part))
                values = mix(buckets[rows] + gold(i + 3)) ^ mix((fps[rows] & mask) + gold(i + 11))
                columns = [pa.array(values.view(np.int64)), *[batch.column(c).take(pa.array(rows)) for c in ("fp", "copies", "ask", "held")], pa.array(np.full(len(rows), (f & ~mask).astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _MEMBERS.split(", ")])


# ---- links
def _near(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the members (bucket, fp) of small buckets, which follow each other: members meet those one place behind, then two, ...
    Of the links of a batch only stars are given."""
    empty = np.zeros(0, np.uint64)
    held = (empty, empty)
    for batch in chain(batches, [None]):
        if batch is None:
            bucket, fp, whole = *held, len(held[0])
        else:
            bucket, fp = (np.concatenate((h, _values(batch, c))) for h, c in zip(held, ("bucket", "fp"), strict=True))
            # the last bucket may go on in the next batch
            whole = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if len(bucket) and (bucket != bucket[-1]).any() else 0
        held = (bucket[whole:], fp[whole:])
        bucket, fp = bucket[:whole], fp[:whole]
        found: list[np.ndarray] = []
        first = np.arange(len(fp))
        for k in range(1, len(fp)):
            first = first[first + k < len(fp)]
            first = first[bucket[first] == bucket[first + k]]
            if not len(first):
                break
            near = first[np.bitwise_count(fp[first] ^ fp[first + k]) <= DISTANCE]
            if len(near):
                found.append(np.stack((fp[near], fp[near + k])))
        if found:
            links = np.concatenate(found, 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(*links)], ["a", "b"])


def linked(nodes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, root) of the fingerprints (fp, copies) that are not the least of their component; null if there are fewer than two."""
    n = nodes.count()
    if n < 2:
        return None
    grouped = blocks(together(nodes), n)
    counts = histograms(nodes, grouped)
    scheme = min((Scheme(grouped, counts, n, m) for m in (2, 3, 4, 5, 6, 8)), key=Scheme.cost)
    names = [c.split()[0] for c in _MEMBERS.split(", ")]
    members = scratch.keep(nodes.select("fp", "copies").mapInArrow(scheme.probe, _MEMBERS))
    roots, level = None, 0
    while True:
        central = F.struct(F.col("copies") if level == 0 else F.lit(0), F.xxhash64("fp", F.lit(level)), "fp")
        facts = members.groupBy("bucket").agg(F.count("*").alias("n"), F.max(central)["fp"].alias("pivot"), F.max("ask").alias("asks"), F.max("held").alias("holds"))
        facts = facts.where("n > 1 AND asks AND holds").drop("asks", "holds")
        active = scratch.keep(beside(members, facts, "bucket", members.count()).where("pivot IS NOT NULL"))
        small = (F.col("n") <= SMALL) | (F.bit_count("free") <= LAST)
        met = active.where(small).select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a long, b long")
        star = active.where(~small & (F.col("fp") != F.col("pivot")) & _near("fp", "pivot")).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
        links = met.union(star)
        if roots is not None:
            links = links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(links, scratch)
        large = active.where(~small).select(names)
        if large.isEmpty():
            return roots
        again = scratch.keep(_mixed(large, roots).mapInArrow(_split, _MEMBERS).distinct())
        scratch.drop(members, active)
        members, level = again, level + 1


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    # a fingerprint is in as many buckets as partitions and probes, not more
    rows = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    return members.join(mixed, "bucket", "left_semi")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id that links reach): one row per row of docs."""
    scratch, side = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprints(docs))
    total = rows.count()
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = linked(nodes, side)
    if roots is None:
        facts = nodes.select("fp", "copies", F.col("least").alias("component_id"))
    else:
        facts = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = facts.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
        facts = scratch.keep(beside(facts, least, "root", total).select("fp", "copies", "component_id"))
        side.only()
        scratch.drop(nodes)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return beside(rows, facts, "fp", total, "copies").select("doc_id", digits, "component_id")
