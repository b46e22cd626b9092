"""The pipeline against a plain run of its five stages."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from episodica.llm import decontaminate, quality

from test_near_dup import brute
from test_secrets import ASSIGN, plain_random


def redacted(texts):
    random = plain_random(texts)
    out = []
    for d, text in enumerate(texts):
        spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}", text)] + [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
        places = []
        for a, b in sorted(spans + [tuple(map(int, x.split(":")[1:])) for x in random[d]]):
            if places and a < places[-1][1]:
                places[-1][1] = max(b, places[-1][1])
            else:
                places.append([a, b])
        for a, b in reversed(places):
            text = text[:a] + "[SECRET]" + text[b:]
        out.append(text)
    return out


def test_pipeline_equals_a_plain_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    # the model's verdicts are those of the operator, which other tests hold to labels; all else is plain
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in quality.score(docs, model).collect() if r.kept}
    root = brute([(d, t) for d, t in texts.items() if d in kept])
    kept = {d for d in kept if root[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    order = sorted(kept)
    bad = {order[k] for k, *_ in decontaminate.Index(items).matches([texts[d] for d in order])}
    order = [d for d in order if d not in bad]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, text in zip(order, redacted([texts[d] for d in order]), strict=True):
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert order and Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
