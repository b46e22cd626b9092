import itertools
import random

import numpy as np
import pytest
import xxhash

from episodica.llm import simhash
from episodica.llm.scratch import Scratch, beside, components, setting

SCHEMA = "doc_id long, text string, fp string, component_id int"


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """Least index of each component of fingerprints within three bits."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(fps))]


def made():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)] + ["Übung", "ÀB", "ÉCOLE", "ABC", "語"]
    texts = [None, "", " \t\n", "One", "one", "ONE two", "one TWO three", "one\x0btwo three", "x" * 100_000]
    for _ in range(40):
        base = rng.choices(words, k=rng.choice((2, 5, 40, 150)))
        texts += [" ".join(base)] * rng.choice((1, 3))
        for _ in range(rng.choice((0, 4))):
            now = list(base)
            now[rng.randrange(len(now))] = rng.choice(words)
            texts.append("\n".join(now))
    return texts


def test_equal_to_brute_force(spark):
    texts = made()
    rows = [(k + 10, t, "clash", 1) for k, t in enumerate(texts)]
    fps = [plain_fingerprint(t) for t in texts]
    expected = {(k + 10, f"{fps[k]:016x}", r + 10) for k, r in enumerate(brute(fps))}
    got = simhash.classes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {tuple(r) for r in got.collect()} == expected
    assert got.columns == ["doc_id", "fingerprint", "component_id"]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "z y x w"), (5, "z y x w"), (None, "alone now here"), (7, None), (3, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.classes(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (5, 5), (None, None), (7, 3), (3, 3)], key=str)
    assert simhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[::2] for r in simhash.classes(spark.createDataFrame([(9, "one row", None, None)], SCHEMA)).collect()] == [(9, 9)]


@pytest.mark.parametrize("flips", [(0, 1, 2, 3, 4, 5), (2, 6)])
def test_dense_groups_split(spark, flips, monkeypatch):
    """Fingerprints about few centres: buckets that are large, mixed, and split again."""
    monkeypatch.setattr(simhash, "SMALL", 6)
    rng = random.Random(8)
    fps = set()
    for centre in (0, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(250):
            x = centre
            for b in rng.sample(range(0, 64, 2), rng.choice(flips)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x, 1 + k % 3) for k, x in enumerate(signed)], "fp long, copies long")
    scratch = Scratch(spark)
    got = dict(tuple(r) for r in simhash.linked(nodes, scratch).collect())
    classes = {}
    for x, r in zip(signed, brute(fps), strict=True):
        classes.setdefault(r, set()).add(x)
    expected = {x: min(c) for c in classes.values() for x in c}
    assert {x: got.get(x, x) for x in signed} == expected


def test_thresholds_sum_and_cover():
    """Whatever the allocation, two fingerprints within three bits differ in some partition by its threshold or less."""
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    fps[:200] &= np.uint64(0xFFFF)  # skew
    x = simhash.bits(fps).astype(float)
    grouped = simhash.blocks(x.T @ x, len(fps))
    assert sorted(b for g in grouped for b in g) == list(range(64))
    counts = np.stack([np.bincount(v, minlength=256) for v in simhash._block_values(fps, grouped).T]).astype(float)
    for m in (2, 3, 4, 5, 6, 8):
        scheme = simhash.Scheme(grouped, counts, len(fps), m)
        chosen = scheme.thresholds(fps)
        assert (chosen.sum(1) == 4 - m).all() and (chosen >= -1).all()
        if m == 4:
            assert len(np.unique(chosen, axis=0)) > 1
        masks = np.array([sum(1 << b for b in part) for part in scheme.parts], np.uint64)
        for _ in range(300):
            k, flipped = rng.integers(len(fps)), rng.choice(64, 3, replace=False)
            apart = np.uint64(sum(1 << int(b) for b in flipped))
            assert any(int(apart & mask).bit_count() <= t for mask, t in zip(masks, chosen[k], strict=True))


def test_components_and_hot_keys(spark):
    scratch = Scratch(spark)
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 400)] + [(500, 500), (1000, 399)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect())
    assert got == {k: 1 for k in range(2, 61)} | {k: 100 for k in range(101, 400)} | {1000: 100}
    rows = spark.createDataFrame([(k, 7 if k % 3 else k if k % 2 else None) for k in range(6000)], "id long, k long")
    facts = rows.where("k IS NOT NULL").groupBy("k").agg(__import__("pyspark").sql.functions.count("*").alias("n"))
    met = {r["id"]: r["n"] for r in beside(rows, facts, "k", 6000).collect()}
    assert len(met) == 6000 and all(n == (4000 if k % 3 else 1 if k % 2 else None) for k, n in met.items())


def test_settings_are_put_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError), setting(spark, key, "true"):
        assert spark.conf.get(key) == "true"
        1 / 0
    assert spark.conf.get(key, None) == before
