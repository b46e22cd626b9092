"""MinHash near-dedup (4): BagMinHash signatures, banding, exact verification, components.

A document is the multiset of its lower-cased five-word shingles (words: runs without white space; a text of one to four
words is one shingle).  Documents are alike when the weighted Jaccard similarity of the multisets is 0.8 or more; a class
is a connected component of that relation.

* BagMinHash: the weight axis of each shingle is cut into the dyadic ranges (0,1], (1,2], (2,4], ...  Each range carries a
  Poisson process whose points, in ascending order, name a component of the signature and a place on the weight axis;
  places above the shingle's weight are thinned out.  A process ends when its next point exceeds all components, so the
  work is near n + m log m.  Two signatures agree in a component with probability equal to the weighted Jaccard similarity.
* Bands of five components (24 of them) give buckets; 0.007 % of pairs at 0.8 share none, fewer above.
* Within a bucket not all are paired with all.  The member that meets most others in all its buckets is the pivot p, and all
  members are verified against it; in buckets that still hold members of different classes, up to two more pivots, of classes
  that gave none yet, join further classes.
* The pairs left are found exactly by what members differ in from the bucket's first pivot.  With A, R the elements that x has
  more and less than p, and h = 4|A| + 5|R|, x is alike to p when h <= |p|; x and y are alike only when they share at least
  (h(x) + h(y) - |p|) / 9 of their differences.  Two members alike to p are of one class, so for the others this is 1 or more:
  members meet by equal elements in the first few of their differences (rare before frequent) and are verified
  if their places there allow for enough in common.  Texts of a group that are alike to p but little to each other never meet.

Defined results: a null or wordless text is a class of its own; equal word sequences are one class, whatever their number;
rows that share a doc_id are one document, which links the classes of its texts, but dedupe() goes by each row's own text; rows with a null doc_id have a null class and are never dropped by dedupe();
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GOLD, NOT_SPACE, Words, chunks, gold, mix, shared, small_batches

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 24, 5, 0.8
#: Pivots that a bucket has at most before its members meet by their differences.
PIVOTS = 3
#: Ids of 8 bytes that a broadcast may hold.
SENT = 1 << 20


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(docs: np.ndarray, items: np.ndarray, weights: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m, points of time) of multisets given as distinct (document, item) with whole weights."""
    least = np.full(n_docs * m, np.inf)
    parts = []
    low, width = 0, 1
    doc, item, weight = docs, items, weights
    while len(doc):
        parts.append((doc, mix(item + gold(2 * low + 1)), weight, np.full(len(doc), low), np.full(len(doc), width)))
        low, width = low + width, low + width
        more = weight > low
        doc, item, weight = doc[more], item[more], weight[more]
    if not parts:
        return least.reshape(n_docs, m)
    doc, seed, weight, lows, widths = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        a = mix(seed + gold(step))
        b = mix(a ^ GOLD)
        time = time - np.log(_uniform(a)) / (m * widths)
        component = (b % np.uint64(m)).astype(np.int64)
        place = lows + ((b >> np.uint64(20)) % widths.astype(np.uint64)).astype(np.int64) + 1
        ok = place <= weight
        np.minimum.at(least, doc[ok] * m + component[ok], time[ok])
        most = least.reshape(n_docs, m).max(1)
        on = time < most[doc]
        doc, seed, weight, lows, widths, time = doc[on], seed[on], weight[on], lows[on], widths[on], time[on]
    return least.reshape(n_docs, m)


def multisets(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the distinct (document, shingle) with their weights, by document."""
    words = Words([t.lower().encode() for t in texts], NOT_SPACE)
    hashes, docs, _ = words.windows(SHINGLE, short=True)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, bool))
    return words, docs[new], hashes[new], np.diff(np.append(new, len(docs)))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    m = BANDS * ROWS
    for frame in batches:
        ids = frame["doc_id"].to_numpy()
        for start, texts in chunks(frame["text"]):
            words, docs, items, weights = multisets(texts)
            points = bag_minhash(docs, items, weights, len(texts), m).view(np.uint64).reshape(len(texts), BANDS, ROWS)
            bands = np.zeros((len(texts), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                bands = mix(bands * GOLD + points[:, :, r])
            some = words.count > 0
            yield pd.DataFrame({
                "doc_id": ids[start : start + len(texts)],
                "key": _keys(texts),
                "n": np.maximum(words.count - SHINGLE + 1, 1).astype(np.int32),
                "bands": [x if s else None for x, s in zip(bands.view(np.int64), some, strict=True)],
            })


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The multiset as a set: a shingle's k-th occurrence is an element, so that set Jaccard is the weighted one."""
    for frame in batches:
        ids = frame["doc_id"].to_numpy()
        for start, texts in chunks(frame["text"]):
            _, docs, items, weights = multisets(texts)
            first = np.cumsum(weights) - weights
            nth = np.arange(weights.sum()) - np.repeat(first, weights)
            elements = mix(np.repeat(items, weights) + GOLD * nth.astype(np.uint64)).view(np.int64)
            cut = np.searchsorted(np.repeat(docs, weights), np.arange(len(texts) + 1))
            yield pd.DataFrame({"doc_id": ids[start : start + len(texts)], "elements": [elements[cut[k] : cut[k + 1]] for k in range(len(texts))]})


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with these ids; texts only move where the ids are too many to send to all."""
    ids = shared(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= SENT else ids, "doc_id", "left_semi")


def _contents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, elements) of these documents."""
    return _of(docs, ids.distinct()).mapInPandas(_elements, "doc_id long, elements array<long>")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def _verified(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets have a weighted Jaccard similarity of at least the threshold."""
    both = pairs.join(elements.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a").join(elements.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= THRESHOLD * (F.size("x") + F.size("y") - common)).select("a", "b")


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are gone: it learns of them by the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component.  Large-star and small-star steps until nothing changes."""
    edges = shared(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = shared(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        _release(edges.sparkSession)


def _grown(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """roots after more links: their ends stand for the components they are in."""
    if roots is None:
        return components(links)
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    more = components(links.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return shared(moved.select("node", F.coalesce("to", "root").alias("root")).union(more))


def _pairs(left: DataFrame, right: DataFrame, ok: Column) -> DataFrame:
    """(a, b) of members of a bucket that may be alike and are not known to be of one class."""
    other = right.select("bucket", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    near = (F.col("root") != F.col("root2")) & (F.least("n", "n2") >= THRESHOLD * F.greatest("n", "n2"))
    return left.join(other, "bucket").where(near & ok).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each member's elements x differ in from its pivot's y, and how many of the differences may have to be looked at."""
    for frame in batches:
        rows = []
        for x, y in zip(frame["x"], frame["y"], strict=True):
            more, less = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
            h, d, p = 4 * len(more) + 5 * len(less), len(more) + len(less), len(y)
            # differences to share with a member that is not alike to the pivot: over h / 9; with one that is: at least (h - p) / 5
            short = d - h // 9
            long = max(short, d + 1 - -((p - h) // 5)) if h > p else short
            rows.append((p, h, d, h > p, short, long, np.concatenate((more, less))))
        yield frame[["pivot", "node", "n", "root"]].join(pd.DataFrame(rows, frame.index, ["p", "h", "d", "far", "short", "long", "differences"]))


def _apart(elements: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of members (pivot, node, n, root) of one pivot that may be alike, found by their differences from it."""
    held = members.join(elements.select(F.col("doc_id").alias("node"), F.col("elements").alias("x")), "node")
    held = held.join(elements.select(F.col("doc_id").alias("pivot"), F.col("elements").alias("y")), "pivot").select("pivot", "node", "n", "root", "x", "y")
    held = held.mapInPandas(_differ, "pivot long, node long, n int, root long, p int, h int, d int, far boolean, short int, long int, differences array<long>")
    held = shared(held.where("long > 0").repartition("pivot", "node"))
    every = held.select("*", F.explode("differences").alias("element")).drop("differences")
    # differences that only one member has come first and meet none; the others follow, rare before frequent
    common = every.groupBy("pivot", "element").agg(F.count("*").alias("times")).where("times > 1")
    mine = Window.partitionBy("pivot", "node")
    places = every.join(common, ["pivot", "element"]).withColumn("place", F.col("d") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("times", "element")) - 1)
    places = shared(places.where("place < long").drop("times", "long"))
    right = places.where("far").select("pivot", "element", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "root", "h", "d", "short", "place")])
    shared_most = F.least(F.col("d") - F.col("place"), F.col("d2") - F.col("place2"))
    enough = 9 * shared_most >= F.col("h") + F.col("h2") - F.col("p")
    near = (F.col("root") != F.col("root2")) & (F.least("n", "n2") >= THRESHOLD * F.greatest("n", "n2"))
    once = ~F.col("far") | ((F.col("place2") < F.col("short2")) & (F.col("node") < F.col("node2")))
    met = places.where("place < short").join(right, ["pivot", "element"]).where(enough & near & once)
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _linked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of all nodes that are alike to others; nodes: doc_id, n, bands, one per distinct text."""
    bands = nodes.select(F.col("doc_id").alias("node"), "n", F.posexplode("bands").alias("band", "value"))
    buckets = bands.select(F.xxhash64("band", "value").alias("bucket"), "node", "n")
    shares = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    active = shared(buckets.join(shares, "bucket"))
    # a text that meets many others is likely to be what they are copies of: it goes first
    central = active.groupBy("node").agg(F.sum("members").alias("score"))
    active = shared(active.drop("members").join(central, "node").withColumn("root", F.col("node")))
    rank = F.struct("score", F.xxhash64("node").alias("h"), "node", "n", "root")
    first = elements = roots = tried = None
    for _ in range(PIVOTS):
        fresh = active
        if tried is not None:
            fresh = active.join(tried.join(roots, "node", "left").select("bucket", F.coalesce("root", "node").alias("root")), ["bucket", "root"], "left_anti")
        pivots = shared(fresh.groupBy("bucket").agg(F.max(rank).alias("p")).select("bucket", "p.node", "p.n", "p.root"))
        pairs = shared(_pairs(active, pivots, F.col("node") != F.col("node2")).distinct())
        roots = _grown(roots, shared(_verified(elements if elements is not None else _contents(docs, _ends(pairs)), pairs)))
        tried = pivots.select("bucket", "node") if tried is None else tried.union(pivots.select("bucket", "node"))
        if first is None:
            first = pivots.select("bucket", F.col("node").alias("pivot"))
            active = active.join(first, "bucket").where("node <> pivot").drop("pivot")
        active = shared(active.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        mixed = active.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
        active = shared(active.join(mixed, "bucket", "left_semi"))
        if active.isEmpty():
            return roots
        _release(docs.sparkSession)
        if elements is None:  # from here on the texts of mixed buckets are all that is read
            first = shared(first.join(active.select("bucket"), "bucket", "left_semi"))
            elements = shared(_contents(docs, active.select(F.col("node").alias("doc_id")).union(first.select("pivot"))))
    members = shared(active.join(first, "bucket").select("pivot", "node", "n", "root").distinct())
    pairs = shared(_apart(elements, members).distinct())
    return _grown(roots, shared(_verified(elements, pairs)))


def _keys(texts: list[str]) -> list[bytes | None]:
    """What texts of equal words share; a wordless text has none."""
    words = [t.lower().encode().split() for t in texts]
    return [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]


def _keyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """These columns and the key of each row's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = [t if isinstance(t, str) else "" for t in frame["said"]]
            yield pd.DataFrame({"row": frame["row"], "key": _keys(texts)})

    held = shared(rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("held"), F.col("text").cast("string").alias("said")).withColumn("row", F.monotonically_increasing_id()))
    return held.join(held.select("row", "said").mapInPandas(run, "row long, key binary"), "row").select(*[F.col(f"held.`{c}`").alias(c) for c in columns], "key")


def _fresh(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, node) of these texts: numbers that are nobody's id."""
    n, seed = keys.count(), 0
    while True:
        nodes = shared(keys.select("key", F.xxhash64("key", F.lit(seed)).alias("node")))
        if nodes.select("node").distinct().count() == n and nodes.join(ids.select(F.col("doc_id").alias("node")), "node", "left_semi").isEmpty():
            return nodes
        seed += 1


def _rooted(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, key, root of the rows with an id, and whether rows of an id differ in text.  The root names the class of the row's
    own text: the least doc_id of its class if no rows of an id differ, else any number."""
    known = docs.where("doc_id IS NOT NULL")
    signed = shared(known.mapInPandas(_sign, "doc_id long, key binary, n int, bands array<long>"))
    some = signed.where("key IS NOT NULL")
    several = shared(some.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("doc_id"))
    differ = not several.isEmpty()
    plain = some.join(several, "doc_id", "left_anti") if differ else some
    texts = shared(plain.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    if differ:  # an id of several texts names none of them: those that no other id has get numbers of their own
        others = some.join(several, "doc_id", "left_semi").join(texts.select("key"), "key", "left_anti")
        others = shared(others.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands")))
        nodes = _fresh(others.select("key"), signed)
        said = _keyed(known.join(several, "doc_id", "left_semi"), ["text"]).join(nodes, "key").groupBy("key", "node").agg(F.first("text").alias("text"))
        known = known.join(several, "doc_id", "left_anti").select("doc_id", "text").union(shared(said.select("node", "text")))
        texts = shared(texts.select("key", "doc_id", "n", "bands").union(others.join(nodes, "key").select("key", "node", "n", "bands")))
    roots = _linked(known, texts)
    by_key = texts.select("key", F.col("doc_id").alias("node"))
    by_key = by_key.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return signed.select("doc_id", "key").join(by_key, "key", "left").select("doc_id", "key", "root"), differ


def _columns(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class): one row per document."""
    docs = _columns(docs)
    rows, differ = _rooted(docs)
    if differ:  # a document whose rows differ links the classes of its texts
        rows = shared(rows)
        own = rows.where("key IS NOT NULL").select("doc_id", "root").distinct()
        low = own.groupBy("doc_id").agg(F.min("root").alias("low"))
        merged = components(own.join(low, "doc_id").select(F.col("root").alias("a"), F.col("low").alias("b")))
        moved = own.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("doc_id", F.coalesce("to", "root").alias("root"))
        moved = shared(moved.distinct())
        moved = moved.join(moved.groupBy("root").agg(F.min("doc_id").alias("least")), "root")
        rows = rows.select("doc_id").distinct().join(moved.select("doc_id", "least"), "doc_id", "left").select("doc_id", F.col("least").alias("root"))
    nulls = docs.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("root", "doc_id")).alias("class_id")).union(nulls)


def dedupe(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those whose text is a copy: of each class of texts a row of its least doc_id stays, and
    of an id's wordless rows one."""
    many = shared(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if many.isEmpty():
        gone = shared(classes(docs)).where("doc_id <> class_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    rows = shared(_rooted(_columns(docs))[0].where("key IS NOT NULL").distinct())
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    stay = shared(rows.join(least, "root").where((F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))).select("doc_id", "key"))
    one = docs.join(many, "doc_id", "left_anti")
    kept = one.join(rows.select("doc_id").join(stay.select("doc_id"), "doc_id", "left_anti"), "doc_id", "left_anti").select(docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    keyed = shared(_keyed(docs.join(many, "doc_id", "left_semi").select("doc_id", "text", whole), ["doc_id", "whole"]).dropDuplicates(["doc_id", "key"]))
    some = keyed.join(stay, ["doc_id", "key"], "left_semi").select("whole").union(keyed.where("key IS NULL").select("whole"))
    return kept.union(some.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns]))
