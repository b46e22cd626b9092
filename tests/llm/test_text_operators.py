"""Quality rules, licence scans, decontamination and packing against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from episodica.llm import decontaminate, licenses, packing, quality

DOCS = "doc_id long, text string, score string, kept string"
TEXTS = [None, "", " \n\t", "a b c d e f a b c d e f a", "x\ny\nx\n\n x\nx", "#*$ é𝒳 %&|<> ok\x0b\x0cz", "w " * 30_000, "one two three four five six seven eight nine ten", "no\xa0break space"]
ROWS = [(k, t, "clash", "") for k, t in enumerate(TEXTS)] + [(None, "a b", None, None)] * 2


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_counts(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for docs in (table, spark.createDataFrame(ROWS, DOCS)):
        truth = Counter((r.doc_id, *counts(r.text or "")) for r in docs.collect())
        got = quality.score(docs, None).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == truth
        assert all(r.kept != r.base_failed for r in got)
    assert quality.score(spark.createDataFrame([], DOCS), None).count() == 0


def test_quality_model_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    odd = labels.where("doc_id % 2 = 1")
    model = quality.train(docs, odd)
    got = quality.score(docs.join(labels.where("doc_id % 2 = 0"), "doc_id"), model).join(labels.withColumnRenamed("quality", "label"), "doc_id").select("kept", "base_failed", "label").collect()
    good, bad = [r for r in got if r.label == 1 and not r.base_failed], [r for r in got if r.label == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert quality.train(docs, labels.where("quality = 1")) is None


def test_licence_base(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    phrases = {label: p.split() for label, p in licenses.BASE}
    extra = ["MIT\nLicense, mit-license; éMIT License", "GENERAL public  license Apache.License", "mit licenses"]
    for docs in (table, spark.createDataFrame([(100 + k, t, "", "") for k, t in enumerate(extra)] + ROWS, DOCS)):
        truth = Counter()
        for r in docs.collect():
            t = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
            at = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
            truth[r.doc_id, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at}))] += 1
        got = licenses.scan(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == truth
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_licence_templates_stand_alone():
    texts = [f"lorem ipsum {' '.join(t.split())} dolor" for _, t, _ in licenses.TEMPLATES]
    got = licenses.scan_texts([*texts, "licensed under the moon by a nice person with free software"])
    assert all(label in got["labels"][k].split(",") for k, (label, _, _) in enumerate(licenses.TEMPLATES))
    assert got["labels"].iloc[-1] == "" and got["score"].iloc[-1] == 0


def exhaustive(index, words):
    """Scores of all segments, one by one."""
    out = {}
    for t in set(words):
        for s, w in index.postings.get(t, ()):
            out[s] = out.get(s, 0.0) + w
    return {s for s, x in out.items() if x >= decontaminate.THRESHOLD - 1e-6}


def test_block_max_wand_equals_exhaustive_scores():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words, rng.integers(3, 90)))) for k in range(200)]
    index = decontaminate.Index(items)
    for _ in range(300):
        own = decontaminate._words([" ".join([items[rng.integers(200)][1], *rng.choice(words, 40)])]).hash[rng.integers(5) :]
        numbers = np.array(sorted(set(index.term_numbers(own).tolist()) - {len(index.terms)}), np.int64)
        assert {s for s, _ in index.search(numbers, decontaminate.THRESHOLD)} == exhaustive(index, own.tolist())


def test_verbatim_items_are_found(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    inside = {(d, i.item_id) for i in items.collect() if len(i.text.split()) >= 5 for d, t in texts.items() if t and i.text in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert inside <= got
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == set(texts) - {d for d, _ in got}
    odd = spark.createDataFrame([(None, "alpha beta gamma delta epsilon. zeta eta theta iota kappa."), (1, None), (2, "")], "item_id long, text string")
    rows = spark.createDataFrame([(None, "so ALPHA beta, gamma delta epsilon; zeta eta theta iota kappa and on", "", "")] + ROWS, DOCS)
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(rows, odd).collect()] == [(None, None)]
    assert decontaminate.matches(rows, odd.where("item_id = 7")).count() == 0


def test_every_verbatim_item_of_the_large_table_is_found():
    import duckdb

    read = lambda name, what: duckdb.sql(f"SELECT {what}, text FROM '/root/testdata/sf0.1/{name}.parquet'").fetchall()
    items, docs = read("benchmark", "item_id"), read("documents", "doc_id")
    inside = {(d, i) for i, t in items if t and len(t) > 20 for d, x in docs if x and t in x}
    assert len(inside) > 200
    got = {(docs[k][0], i) for k, i, *_ in decontaminate.Index(items).matches([x or "" for _, x in docs])}
    assert inside <= got
    assert len(got) <= 1.02 * len(inside)


def test_edited_items_are_found():
    import duckdb

    rng = random.Random(3)
    items = duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.1/benchmark.parquet' ORDER BY 1").fetchall()
    index, filler = decontaminate.Index(items), [f"word{k}" for k in range(5000)]
    for edit in (lambda w: [rng.choice(filler)], lambda w: [], lambda w: [w, rng.choice(filler)]):
        texts = [" ".join(rng.choices(filler, k=200) + [y for w in t.split() for y in (edit(w) if rng.random() < 0.05 else [w])] + rng.choices(filler, k=300)) for _, t in items]
        got = {(k, i) for k, i, *_ in index.matches(texts)}
        assert sum((k, i) in got for k, (i, _) in enumerate(items)) >= 0.95 * len(items)
        assert all(items[k][0] == i for k, i in got)


def test_question_and_answer_must_stand_together():
    question, answer = "What is the capital city of the old French republic across the sea today?", "Paris."
    index = decontaminate.Index([(1, f"{question} {answer}"), (2, "solitary")])
    filler = " ".join(f"f{k}" for k in range(1500))
    texts = [f"{filler} {question} {answer} {filler}", f"{filler} {question} {filler} {answer}", f"{question} Rome.", f"{answer} {question}", "a solitary word", f"{filler} {question} {answer}"]
    assert [(k, i) for k, i, *_ in index.matches(texts)] == [(0, 1), (3, 1), (4, 2), (5, 1)]
    long = " ".join(f"q{k}" for k in range(100)) + ". " + " ".join(f"a{k}" for k in range(60)) + "."
    index = decontaminate.Index([(1, long)])
    begin, end = long.split(". ")
    assert [k for k, *_ in index.matches([f"x y z {long} x", f"{begin} {filler} {end}", f"{filler} {long}"])] == [0, 2]


def check_packing(rows, docs, capacity=2048):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    truth = Counter()
    for d, t in docs:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head = (len(ids) - 1) % capacity + 1
        edges = [0, *range(head, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            truth[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == truth
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.best_fit(docs).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.01 * packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1
    odd = ROWS + [(50, "<|endoftext|> a", "", ""), (51, "word " * 9000, "", "")]
    check_packing(packing.best_fit(spark.createDataFrame(odd, DOCS)).collect(), [(r[0], r[1]) for r in odd])
    assert packing.best_fit(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_exchanges_between_groups(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(200, 1100, 400)
    parts = spark.createDataFrame([(int(k), 0, 0, int(x), 0) for k, x in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(parts, group=50).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    alone = len(packing.best_fit_decreasing(sizes, 2048)[2])
    assert len({r.sequence_id for r in rows}) <= alone + 2


def test_pairs_pack_each_piece_once_and_gapless():
    rng = np.random.default_rng(9)
    for low, high in ((1, 101), (15, 50), (3, 4), (100, 101), (30, 40)):
        sizes = rng.integers(low, high, 500)
        bins, offsets, fill = packing.best_fit_pairs(sizes, 100)
        assert fill.max() <= 100 and (np.bincount(bins, sizes) == fill).all()
        for b in range(len(fill)):
            own = sorted((offsets[k], sizes[k]) for k in np.flatnonzero(bins == b))
            assert [x for x, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
    assert all(len(x) == 0 for x in packing.best_fit_pairs(np.zeros(0, np.int64), 100))


@pytest.mark.parametrize("kind", ["thirds", "middling"])
def test_groups_stay_bounded_and_bins_near_the_bound(spark, monkeypatch, kind):
    # lengths that fill no bin whole, or leave nearly all bins open
    length = {"thirds": "3 * (1 + pmod(xxhash64(id), 682))", "middling": "300 + pmod(xxhash64(id), 701)"}[kind]
    parts = spark.range(200_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", f"{length} AS length", "0L AS ids_crc32")
    real, seen = packing._packer, spark.sparkContext.accumulator(0)

    def packer(capacity, last):
        inner = real(capacity, last)

        def run(frame):
            if len(frame) > 2 * packing.GROUP:
                seen.add(1)
            return inner(frame)

        return run

    monkeypatch.setattr(packing, "_packer", packer)
    rows = packing.pack(parts).cache()
    bins, bound = packing.certificate(rows)
    assert rows.count() == 200_000 and seen.value == 0
    assert bins <= 1.01 * bound


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(100):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bound = packing.lower_bound(sizes, 100)
        assert -(-sizes.sum() // 100) <= bound <= len(packing.best_fit_decreasing(sizes, 100)[2])
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3


@pytest.mark.parametrize("seed", [21, 22])
def test_items_with_a_tenth_edited_are_found(seed):
    """Of items with a tenth of their words replaced, removed or added to, inside other documents, nine in ten are found at least."""
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pylist()]
    docs = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    index, rng = decontaminate.Index(items), random.Random(seed)
    pool = [w for t in rng.sample(docs, 50) for w in t.split()]
    for kind in ("replaced", "removed", "added"):
        texts = []
        for _, text in items:
            edited = []
            for w in text.split():
                hit = rng.random() < 0.1
                edited += [rng.choice(pool)] if hit and kind == "replaced" else [] if hit and kind == "removed" else [w, rng.choice(pool)] if hit else [w]
            host = rng.choice(docs).split()
            at = rng.randrange(len(host) + 1)
            texts.append(" ".join(host[:at] + edited + host[at:]))
        found = {d for d, i, *_ in index.matches(texts) if i == items[d][0]}
        assert len(found) >= 0.9 * len(items), kind


def test_held_words_need_a_neighbour():
    share = lambda part, text: decontaminate.Part(part).share(decontaminate.grams(decontaminate._words([text]).hash))
    assert share("a b c d", "x a b c d y") == 1 == share("", "x") == share("solo", "so solo")
    assert share("a b c d", "d c b a") == 0 == share("solo", "so")
    assert share("a b c d e f", "a b x d e f") == 5 / 6 and share("a b c d e f", "a b d e f") == 5 / 6 and share("a b c d e f", "a b c x d e f") == 1


def test_labelled_ids_with_many_rows(spark):
    """Of a labelled id's texts one is fitted, whatever order the rows are in, and the driver gets a row an id."""
    rng = random.Random(2)
    text = lambda good: " ".join(rng.choices([f"{'good' if good else 'bad'}{k}" for k in range(30)] + [f"w{k}" for k in range(50)], k=40))
    rows = [(k % 12, text(k % 2)) for k in range(600)] + [(3, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    got = []
    original = quality.fit

    def fit(x, *args):
        got.append(x)
        return original(x, *args)

    quality.fit = fit
    try:
        models = [quality.train(df, labels) for df in (docs.repartition(7), docs.orderBy("text").coalesce(1))]
    finally:
        quality.fit = original
    assert [len(x) for x in got] == [12, 12] and (got[0] == got[1]).all() and all(models)
