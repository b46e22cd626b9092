import itertools
import random
from collections import Counter

import numpy as np

from episodica.llm import near_dup

DOCS = "doc_id long, text string, source string"


def bag(text):
    words = near_dup_words(text)
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_dup_words(text):
    return [w.decode() for w in (text or "").lower().encode().split()]


def alike(a, b):
    union = sum((a | b).values())
    return union and sum((a & b).values()) >= 0.8 * union


def brute(rows):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(d, bag(t)) for d, t in rows]
    for (a, x), (b, y) in itertools.combinations(bags, 2):
        n, m = sum(x.values()), sum(y.values())
        if min(n, m) >= 0.8 * max(n, m) and alike(x, y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: find(d) for d in root}


def made(seed=3):
    """Copies, chains of near copies, shared passages, repeated words, short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 12, 60, 200)))] for _ in range(12)]
    rows = []
    for b in base:
        rows += [" ".join(b)] * rng.choice((1, 2, 5))
        now = b
        for _ in range(rng.choice((0, 3, 8))):
            now = list(now)
            for _ in range(max(1, len(now) // 70)):
                now[rng.randrange(len(now))] = rng.choice(words)
            rows.append(" ".join(now))
    passage = [rng.choice(words) for _ in range(60)]
    rows += [" ".join(passage + [rng.choice(words) for _ in range(30)]) for _ in range(25)]
    rows += ["a b a b a b a b a b a b a b", "a b a b a b a b a b a b a", "A  B\ta b A B a b a b a b a b", "", "", None, " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rows = made()
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame([(d, t, "s") for d, t in rows], DOCS)).collect()}
    assert got == brute(rows)


def test_classes_equal_brute_force_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_large_group_around_the_threshold(spark):
    """Copies of two texts that are alike themselves, with so many edits that most pairs are near or below the threshold."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    one = [rng.choice(words) for _ in range(140)]
    two = one[:118] + [rng.choice(words) for _ in range(22)]
    rows = []
    for k in range(420):
        now = list(two if k % 3 == 0 else one)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5))):
            at = rng.randrange(len(now))
            now[at : at + rng.choice((0, 1, 1, 2))] = rng.choice(([], [rng.choice(words)], [rng.choice(words)]))
        rows.append((k, " ".join(now)))
    want = brute(rows)
    assert len(set(want.values())) > 10
    assert {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame([(d, t, "s") for d, t in rows], DOCS)).collect()} == want


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    a[:60], b[240:] = 0, 0
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    docs = np.repeat([0, 1], 300)
    weights = np.concatenate((a, b))
    on = weights > 0
    s = near_dup.bag_minhash(docs[on], np.concatenate((items, items))[on], weights[on], 2, 4096)
    assert abs((s[0] == s[1]).mean() - truth) < 0.03


def test_defined_results(spark):
    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "One two  three four five six", "b"), (None, "one two three four five six", "c"), (3, None, "d"), (4, "", "e"), (9, "x y", "f"), (8, "x y", "f")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got == {1: 1, 2: 1, None: None, 3: 3, 4: 4, 9: 8, 8: 8}
    kept = near_dup.dedupe(docs).collect()
    assert sorted((r.doc_id or 0, r.source) for r in kept) == [(0, "c"), (1, "a"), (3, "d"), (4, "e"), (8, "f")]
    assert near_dup.classes(spark.createDataFrame([], DOCS)).count() == 0
    assert near_dup.dedupe(spark.createDataFrame([], DOCS)).count() == 0
    several = spark.createDataFrame([(5, "a b c d e f", ""), (5, "g h i j k l", ""), (6, "g h i j k l", ""), (7, "a b c d e f", "")], DOCS)
    assert {r.doc_id: r.class_id for r in near_dup.classes(several).collect()} == {5: 5, 6: 5, 7: 5}


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(500)) for _ in range(120)] for _ in range(9)]
    whole = [" ".join(b) for b in base]
    near = [" ".join([*b[:-1], "end"]) for b in base]
    # id 1 has texts 0 to 5, and each has a near copy with an id of its own; 60 shares texts 5 and 6 with others
    rows = [(1, whole[k], f"s{k}") for k in range(6)] + [(10 + k, near[k], "") for k in range(5)]
    rows += [(60, near[5], ""), (60, whole[6], ""), (61, near[6], ""), (62, whole[7], ""), (62, whole[7], ""), (63, None, ""), (63, " ", ""), (63, near[8], ""), (None, whole[0], "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got == {1: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 1, 60: 1, 61: 1, 62: 62, 63: 63, None: None}
    kept = Counter((r.doc_id, (r.text or "").strip()) for r in near_dup.dedupe(docs.withColumnRenamed("source", "key")).collect())
    assert kept == Counter([*((1, whole[k]) for k in range(6)), (60, whole[6]), (62, whole[7]), (63, ""), (63, near[8]), (None, whole[0])])
