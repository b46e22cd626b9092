"""Best-fit packing (7): bound-certified repacking of token runs into sequences of a fixed capacity.

Documents are tokenised once (ids, then an end id); one longer than the capacity is cut into pieces of the capacity, the
first piece taking what is left over.  Full pieces are sequences of their own.  The others are dealt into groups of about
GROUP pieces and each group is packed best-fit decreasing.  Dual feasible functions give a lower bound for each group's bins; a group
above it is packed again with pairs as candidates for best fit, too.  A group that meets its bound is certified and gives up only its emptiest bin; a group with a gap gives up all bins that
are not full.  What was given up is dealt anew, into as many groups as its number asks for, and packed again.  A round is the
last when one group takes all that is left, or when the round before gave up nearly all it got, for then an exchange
gains no more: its groups keep all their bins.  So no group grows with the input, and each leaves one poor bin at most
besides what best-fit decreasing itself leaves open; certificate() compares all bins with the bound of all pieces.

Defined results: a null or empty text is one piece that holds the end id; repeated rows and repeated ids are packed each;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, shared

CAPACITY, END = 2048, 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that one group packs at a time, on average, and the share of a round's pieces beyond which the next round is the last.
GROUP, STALE = 8_000, 0.8
#: Texts whose token digests a worker remembers, for copies.
MEMORY = 50_000


@cache
def _encoder(vocabulary: str):
    """Text to ids.  The rank file of the same vocabulary gives the same ids faster; texts with special tokens go the slow way."""
    import base64
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    ranks = public_tokenizers.path(vocabulary.replace(".json", ".tiktoken"))
    if not os.path.exists(ranks):
        return plain
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda text: plain(text) if "<|" in text else fast(text)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece."""
    head = (len(ids) - 1) % capacity + 1
    edges = [0, *range(head, len(ids) + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, known = _encoder(vocabulary), OrderedDict()
        for frame in batches:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = text if isinstance(text, str) else ""
                key = hashlib.blake2b(text.encode(), digest_size=16).digest()
                if (found := known.get(key)) is None:
                    found = known[key] = cut(np.array([*encode(text), END], "<u4"), capacity)
                    if len(known) > MEMORY:
                        known.popitem(last=False)
                else:
                    known.move_to_end(key)
                out += [(doc, k, *x) for k, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return by_batch(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual feasible functions u(k) and f(threshold)."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 21):  # u(k): x where (k + 1) x is whole, else floor((k + 1) x) / k
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    large, mass = np.cumsum(count[::-1])[::-1], np.concatenate(([0], np.cumsum(count * size)))
    for t in range(capacity // 2 + 1):  # f(t): 1 above capacity - t, 0 below t, else x
        whole = int(large[capacity - t + 1]) if t else 0
        best = max(best, whole - (-int(mass[capacity - t + 1] - mass[t]) // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and how full each bin is."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms: list[int] = []  # the rooms that have bins, ascending
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_at[room].pop()
            if not open_at[room]:
                del rooms[at]
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            if not open_at[room]:
                insort(rooms, room)
            open_at[room].append(b)
    return bins, offsets, np.array(fill, np.int64)


def best_fit_pairs(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_fit_decreasing, but a bin's rest is filled by the best fit among single sizes and pairs of them.  Of pairs that fit
    equally, an arbitrary one is taken, which leaves the mixture of sizes as it is; taking the extremes first wastes the end."""
    order = np.argsort(-sizes, kind="stable")
    count = np.bincount(sizes, minlength=capacity + 1)
    place = np.cumsum(count[::-1])[::-1] - count  # in order: the next one of each size
    span = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(count > 0, span, 0))  # the greatest size left that is no more than this
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []

    def take(size: int) -> None:
        i = order[place[size]]
        bins[i], offsets[i] = len(fill) - 1, fill[-1]
        fill[-1] += size
        place[size] += 1
        count[size] -= 1
        if not count[size]:
            below[size:][below[size:] == size] = below[size - 1]

    while size := int(below[capacity]):
        fill.append(0)
        take(size)
        while (room := capacity - fill[-1]) and (size := int(below[room])):
            small = span[1 : room // 2 + 1]
            small = small[count[small] > 0]
            if size < room and len(small):
                other = below[room - small]
                other = np.where((other == small) & (count[small] < 2), below[small - 1], other)
                both = np.where(other > 0, small + other, 0)
                most = int(both.max())
                if most > size and not below[room - most]:  # nothing else fits beside the pair
                    equal = np.flatnonzero(both == most)
                    k = equal[int(len(equal) * (len(fill) * 0.6180339887498949 % 1))]
                    take(int(other[k]))
                    size = int(small[k])
            take(size)
    return bins, offsets, np.array(fill, np.int64)


def _pack_group(frame: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """Place the rows; open rows (sequence -1) are those that the group gives up for another round."""
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    sizes = frame["length"].to_numpy(np.int64)
    bins, offsets, fill = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(fill) > bound:
        other = best_fit_pairs(sizes, capacity)
        if len(other[2]) < len(fill):
            bins, offsets, fill = other
    if not last:
        if len(fill) == bound:
            given = np.arange(len(fill)) == int(np.argmin(fill))
        else:
            given = fill < capacity
        bins[given[bins]] = -1
    return frame.assign(bin=bins, offset=offsets)


def _packer(capacity: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda frame: _pack_group(frame, capacity, last)


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """parts with sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    parts = shared(parts.select(F.col("doc_id").cast("string").alias("doc_id"), *columns[1:]))
    whole = parts.where(F.col("length") == capacity).withColumn("place", F.struct(F.lit(0).alias("turn"), F.monotonically_increasing_id().alias("group"), F.lit(0).cast("long").alias("bin"))).withColumn("offset", F.lit(0).cast("long"))
    done = shared(whole.select(*columns, "place", "offset"))
    left = parts.where(F.col("length") < capacity)
    n = left.count()
    turn, last = 0, False
    while n:
        turn += 1
        groups = -(-n // group)
        last = last or groups == 1
        dealt = left.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length", F.rand(turn), F.lit(turn)), F.lit(groups)))
        schema = "doc_id string, piece int, start long, length long, ids_crc32 long, group long, bin long, offset long"
        dealt = shared(dealt.select(*columns, "group"))
        packed = shared(dealt.groupBy("group").applyInPandas(_packer(capacity, last), schema))
        place = F.struct(F.lit(turn).alias("turn"), "group", "bin").alias("place")
        done = done.union(packed.where("bin >= 0").select(*columns, place, "offset"))
        left = packed.where("bin < 0").select(columns)
        given = 0 if last else left.count()
        last = given > STALE * n
        n = given
    # numbers: a turn's groups and bins fit 8, 27 and 28 bits; full pieces (turn 0) have their own number
    number = F.when(F.col("place.turn") == 0, F.col("place.group")).otherwise(
        -(F.shiftleft(F.col("place.turn").cast("long"), 55) + F.shiftleft(F.col("place.group"), 28) + F.col("place.bin"))
    )
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), *columns[1:], number.alias("sequence_id"), "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences that a packing has, and how many any packing needs at least."""
    bins = packed.select("sequence_id").distinct().count()
    count = packed.groupBy("length").count().collect()  # a row per length up to the capacity
    return bins, lower_bound(np.repeat([r[0] for r in count], [r[1] for r in count]).astype(np.int64), capacity) if count else 0


def best_fit(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(pieces(docs, capacity, vocabulary), capacity)
