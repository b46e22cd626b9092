"""Benchmark decontamination (8): a BM25 index of the test items, block-max WAND over every training passage, overlap checks.

Items are cut into segments of at most SEGMENT words.  An index holds the segments of one shard of the items, in blocks;
the impact of a word on a segment is its BM25 weight as a share of the segment's score against itself, so one threshold
serves short and long items.  Every document is cut into overlapping passages (PASSAGE words, half shared), so each span
of SEGMENT words lies whole in one.  A passage is a query of its distinct words:

* block maxima, summed over the words of a passage for all blocks at once, bound the score of every segment in a block;
* passages with a bound above the threshold in some block are run through document-at-a-time WAND with those block maxima,
  which returns every segment whose score reaches the threshold;
* hits of one item in passages that follow each other closely (no further apart than the item's segments may lie) are one run; it
  counts when the words of its passages, and no others of the document, hold enough of the item's question and of its
  answer (the last sentence; of a single sentence, its last third).  A word of a part is held if it stands there in order with a
  neighbour: with one of the two words before or after it in the part, and at most one word between.  So an edited word costs
  itself and not its neighbours; the word of a part of one word needs none.

The index is built on the driver from a shard of the items of bounded size (SHARD items); more items make more
shards, each run against all documents.

Defined results: null, empty or wordless items and texts match nothing; an item of one word has no answer, and is held where its word
is; an item's overlaps are those of its best run; of items that share an id each counts; repeated rows
give the same result rows each; ids may be null and are carried as such; extra columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, GOLD, Words, by_batch, chunks, mix, small_batches

SEGMENT, PASSAGE, BLOCKS, SHARD = 48, 96, 32, 4096
K1, B = 1.2, 0.75
#: Share of a segment's own BM25 score that a passage must reach, and of the words of question and answer that must be held.
THRESHOLD, OVERLAP = 0.6, 0.6


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    parts = [x for x in re.split(r"(?<=[.?!])\s+", text.strip()) if re.search(r"\w", x)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    at = max(1, 2 * len(words) // 3)
    return " ".join(words[:at]), " ".join(words[at:])


def _words(texts: list[str]) -> Words:
    return Words([t.lower().encode() for t in texts], ALNUM)


def near_pairs(hashes: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of each word with the one ``apart`` places behind it."""
    return mix(hashes[:-apart] * GOLD + hashes[apart:]) if len(hashes) > apart else np.zeros(0, np.uint64)


def grams(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of words, and of two words that follow each other or have one between."""
    return np.unique(np.concatenate((mix(hashes + GOLD), near_pairs(hashes, 1), near_pairs(hashes, 2))))


class Part:
    """The question or the answer of an item."""

    def __init__(self, text: str):
        own = _words([text]).hash
        self.n = len(own)
        self.one = mix(own + GOLD) if len(own) == 1 else None
        self.pairs = [near_pairs(own, k) for k in (1, 2)]

    def share(self, held: np.ndarray) -> float:
        """Share of the part's words that these grams hold; an empty part is held everywhere."""
        if self.one is not None:
            return float(np.isin(self.one, held)[0])
        if not self.n:
            return 1.0
        covered = np.zeros(self.n, bool)
        for k, pairs in enumerate(self.pairs):
            at = np.flatnonzero(np.isin(pairs, held))
            covered[at] = covered[at + k + 1] = True
        return float(covered.mean())


def runs(found: list[tuple[int, float]], gap: int) -> Iterator[list[tuple[int, float]]]:
    """Cut ascending (passage, score) where the next passage is more than gap further on."""
    cuts = [k for k in range(1, len(found)) if found[k][0] - found[k - 1][0] > gap]
    for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True):
        yield found[a:b]


class Index:
    """Postings with impacts and block maxima of the segments of some items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items: list[tuple[int | None, int, Part, Part]] = []  # id, segments, question, answer
        self.item_of: list[int] = []
        bags: list[Counter] = []
        for item, text in items:
            own = _words([text]).hash
            if not len(own):
                continue
            n = -(-len(own) // SEGMENT)
            for part in np.array_split(own, n):
                bags.append(Counter(part.tolist()))
                self.item_of.append(len(self.items))
            self.items.append((item, n, *map(Part, split_item(text))))
        n = len(bags)
        frequency = Counter(t for bag in bags for t in bag)
        mean = sum(sum(b.values()) for b in bags) / max(n, 1)
        idf = {t: math.log1p((n - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}
        self.postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for s, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / mean)
            weight = {t: idf[t] * tf * (K1 + 1) / (tf + norm) for t, tf in bag.items()}
            total = sum(weight.values())
            for t, w in weight.items():
                self.postings[t].append((s, w / total))
        self.size = max(1, -(-n // BLOCKS))  # segments in a block
        self.terms = np.array(sorted(self.postings), np.uint64)
        self.block_max = np.zeros((len(self.terms) + 1, BLOCKS), np.float32)
        self.runs: list[dict[int, list[tuple[int, float]]]] = []  # of each term: its postings by block
        for k, t in enumerate(self.terms.tolist()):
            own: dict[int, list[tuple[int, float]]] = defaultdict(list)
            for s, w in self.postings[t]:
                own[s // self.size].append((s, w))
            self.runs.append(dict(own))
            for b, run in own.items():
                self.block_max[k, b] = max(w for _, w in run)

    def term_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the terms, len(terms) for others."""
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == hashes, at, len(self.terms)) if len(self.terms) else np.zeros(len(hashes), np.int64)

    def search(self, numbers: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all segments whose score against these distinct terms reaches the threshold."""
        maxima = self.block_max[numbers]
        blocks = np.flatnonzero(maxima.sum(axis=0) >= threshold - 1e-4).tolist()  # no segment of another block can do
        lists = []
        for k, own in zip(numbers.tolist() if blocks else (), maxima, strict=False):
            held = [self.runs[k][b] for b in blocks if b in self.runs[k]]
            if held:
                lists.append([0, [s for run in held for s, _ in run], [w for run in held for _, w in run], float(own[blocks].max()), own])
        found, goal = [], threshold - 1e-6
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= goal:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == doc:
                pivot += 1
            block = doc // self.size
            if sum(float(x[4][block]) for x in lists[: pivot + 1]) < goal:  # no segment up to the next border can do
                border = (block + 1) * self.size
                if pivot + 1 < len(lists):
                    border = min(border, lists[pivot + 1][1][lists[pivot + 1][0]])
                for x in lists[: pivot + 1]:
                    x[0] = bisect_left(x[1], max(border, doc + 1), x[0])
            elif lists[0][1][lists[0][0]] == doc:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += x[2][x[0]]
                    x[0] += 1
                if score >= goal:
                    found.append((doc, score))
            else:
                for x in lists[:pivot]:
                    x[0] = bisect_left(x[1], doc, x[0])
            lists = [x for x in lists if x[0] < len(x[1])]
        return found

    def matches(self, texts: list[str]) -> list[tuple[int, int | None, float, float, float]]:
        """(number of the text, item id, score, question and answer overlap) of each text and item that match."""
        if not self.items:
            return []
        words = _words(texts)
        if not len(words.hash):
            return []
        terms = self.term_numbers(words.hash)
        known = np.flatnonzero(terms < len(self.terms))
        if not len(known):
            return []
        # passages start at each half passage of a document: a passage is two halves, or a document's only one
        half, width = PASSAGE // 2, len(self.terms)
        halves = -(-words.count // half)
        base = np.cumsum(halves) - halves
        number = base[words.doc[known]] + (known - words.first[words.doc[known]]) // half
        distinct = np.unique(number * width + terms[known])
        number, term = distinct // width, distinct % width
        edges = np.searchsorted(number, np.arange(halves.sum() + 1))
        some = np.flatnonzero(np.diff(edges))
        sums = np.zeros((len(edges), BLOCKS))
        sums[some] = np.add.reduceat(self.block_max[term], edges[some], axis=0)
        n = np.maximum(halves - 1, 1) * (halves > 0)
        doc = np.repeat(np.arange(len(texts)), n)
        lo = base[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        hi = np.minimum(lo + 2, (base + halves)[doc])
        bound = (sums[lo] + np.where((hi - lo == 2)[:, None], sums[lo + 1], 0)).max(axis=1)
        hits: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)  # of a text and item: passage, score
        for p in np.flatnonzero(bound >= THRESHOLD - 1e-4).tolist():
            own = np.unique(term[edges[lo[p]] : edges[hi[p]]])
            for s, score in self.search(own, THRESHOLD):
                hits[int(doc[p]), self.item_of[s]].append((int(lo[p] - base[doc[p]]), score))
        out = []
        for (d, i), found in sorted(hits.items()):
            item, n_segments, *parts = self.items[i]
            best = None
            for run in runs(sorted(found), n_segments + 1):
                begin, end = words.first[d] + run[0][0] * half, words.first[d] + min((run[-1][0] + 2) * half, words.count[d])
                own = words.hash[begin:end]
                held = grams(own)
                shares = [x.share(held) for x in parts]
                if min(shares) >= OVERLAP:
                    best = max(best or (), (min(max(x for _, x in run), 1.0), *shares))
            if best:
                out.append((d, item, *best))
        return out


def _shards(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items, in runs of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(1, -(-items.count() // SHARD))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each row and item that match."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for items in _shards(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for frame in batches:
                found = []
                for start, texts in chunks(frame["text"]):
                    found += [(frame["doc_id"].iloc[start + d], None if item is None else str(item), *x) for d, item, *x in index.value.matches(texts)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
        part = by_batch(rows, run, schema, ("doc_id", "item_id"))
        out = part if out is None else out.union(part)
    return out


def _matchless(index: Broadcast) -> Callable[[pd.Series], pd.Series]:
    def run(texts: pd.Series) -> pd.Series:
        bad = np.zeros(len(texts), bool)
        for start, held in chunks(texts):
            for d, *_ in index.value.matches(held):
                bad[start + d] = True
        return pd.Series(~bad)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text matches no item."""
    small_batches(docs.sparkSession)
    for items in _shards(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))
        docs = docs.where(F.pandas_udf(_matchless(index), "boolean")(F.col("text").cast("string")))
    return docs
