"""Chat perspectives, HTML extraction, sharding, PII surrogates, and the pipeline."""

import re
from collections import Counter

import pandas as pd
import pytest

import corpus_pipeline
from episodica.llm import extraction, perspectives, pii, sharding


def test_perspectives(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 600, "ann", "bye"), (2, 0, "system", "alone"), (None, None, None, "lost")]
    got = perspectives.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = {}
    for r in sorted(got.collect(), key=lambda r: (str(r.conv_id), r.speaker, r.position)):
        text = whole.get((r.conv_id, r.speaker), "")
        assert r.start == len(text) and r.end == r.start + len(r.segment) and r.mask == (r.role == r.speaker)
        whole[r.conv_id, r.speaker] = text + r.segment
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    assert whole[1, "ann"] == "<|system|>\nbe nice<|end|>\n<|assistant|>\nhi<|end|>\n" + "<|user name=bob|>\n<|end|>\n" * 2 + "<|assistant|>\nbye<|end|>\n"
    assert perspectives.segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    parts = perspectives.dialogues(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.text for r in parts} == set(whole.values())
    for r in parts:
        assert all(r.text[s["from"] : s["to"]].endswith("<|end|>\n") for s in r.spans)


def plain_perspectives(rows):
    said = lambda r: (r[2] or "").strip(" ") or "unknown"
    out = Counter()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, said(r), (r[3] or "").encode()))
        for speaker in {said(r) for r in own} - {"system"}:
            at = 0
            for k, r in enumerate(own):
                role = said(r)
                head = f"<|{'system' if role == 'system' else 'assistant' if role == speaker else 'user name=' + role}|>\n"
                segment = f"{head}{r[3] or ''}<|end|>\n"
                out[conv, speaker, k, r[1], role, segment, at, at + len(head), at + len(segment), int(role == speaker)] += 1
                at += len(segment)
    return out


def test_perspectives_of_a_hot_dialogue_equal_a_plain_version(spark, tmp_path):
    # many turns of one dialogue share a number, have none, or are equal; columns have the operator's own names
    rows = [(1, None if k % 3 else 7, f"r{k % 3}", f"{'w' * (k % 5)} é𝒳 {k % 11}") for k in range(3000)] + [(1, 7, "r1", "same")] * 500 + [(1, k, " ann ", "") for k in range(300)]
    rows += [(2, 1, "x", "p" * 1024), (2, 1, "x", "p" * 1024 + "q"), (2, 1, "x", "p" * 1030), (2, 1, "x", "p" * 1024)] * 20 + [(None, None, None, None)] * 3 + [(3, 0, "system", "alone")]
    names = "block segment conv speaker tie nth base start".split()
    docs = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} string" for n in names))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = perspectives.segments(docs).collect()
        assert len({r.block for r in perspectives._turns(docs).where("conv_id = 1").select("block").distinct().collect()}) > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter(map(tuple, got)) == plain_perspectives(rows)
    perspectives.write_dialogues(docs.where("conv_id = 2"), str(tmp_path / "out"))
    (r,) = spark.read.json(str(tmp_path / "out")).collect()
    assert r.text == "".join(x[5] for x in sorted(plain_perspectives([x for x in rows if x[0] == 2]).elements(), key=lambda x: x[6]))
    assert len(r.spans) == 80 and r.spans[-1]["to"] == len(r.text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><a href=/>Site</a></header><nav><ul><li>Menu</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><h1>A &amp; B{k}</h1><p><b>One<br>two  three&nbsp;{k}</b><p>Fo<i>u</i>r.</p><form><p>Mail</p></form>
<div class="promo">Join us</div><ul><li>x<li>y</ul></article><section id="comments"><p>Nice {k}</p></section><aside>Side</aside><footer>&copy; me</footer></body>"""


def test_extraction(spark):
    truth = lambda k: f"A & B{k} One two three {k} Four. x y"
    rows = [(k, f"https://h.example/{k}", PAGE.replace("{k}", str(k)), "clash") for k in range(12)]
    rows += [(90, "https://h.example/n", None, ""), (91, None, "", ""), (92, "https://one.example/", PAGE.replace("{k}", "z"), ""), (93, "x", "plain <p>text &lt;b&gt;", ""), (0, "https://h.example/0", rows[0][2], "")]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, template string")).collect()
    want = Counter((k, truth(k)) for k in range(12)) + Counter([(0, truth(0)), (90, ""), (91, ""), (92, truth("z")), (93, "plain text <b>")])
    assert Counter((r.page_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_equals_article_of_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", inner))).split(" ")).strip()


def test_extraction_without_article(spark):
    body = "<html><body><div class='top'>Same words</div><div class='text'><p>Story {k} goes on and on for long.</p></div><div class='tail'>All rights</div></body></html>"
    rows = [(k, "https://s.example/", body.replace("{k}", str(k))) for k in range(20)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} goes on and on for long." for k in range(20)}


def alone(page):
    """The main text without any template."""
    return extraction.main_text(extraction.Page.of(page), "", {}, {})


def extracted(spark, pages):
    rows = [(k, url, page) for k, (url, page) in enumerate(pages)]
    return [r.text for r in sorted(extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_extraction_below_items_and_odd_classes(spark):
    menu = "<ul class='w-1/2'><li>Home<ul><li>One</li></ul></li></ul><table><tr><td><div>Cell</div></td></tr></table>"
    body = "<html><body><nav>{menu}</nav>{menu}<div class='text w-1/2'><p>{story}</p>{items}</div></body></html>"
    story = lambda k: f"Story {k} goes on and on, for it is long and has much to tell to whom it may concern in the year {k}, and later."
    items = lambda k: "<ul><li>x</li></ul>" * (1 + k % 2)
    got = extracted(spark, [("https://s.example/", body.replace("{menu}", menu).replace("{story}", story(k)).replace("{items}", items(k))) for k in range(20)])
    assert got == [story(k) + " x" * (1 + k % 2) for k in range(20)]


def test_extraction_of_layouts(spark):
    story = lambda k: f"Story {k} goes on and on, for it is long and has much to tell to whom it may concern in the year {k}, and later."
    side = lambda k: f"<div class='intro'>Welcome, reader {k}</div><div class='recent'><p>Recent one {k}</p><p>Recent two {k}</p></div>"
    page = lambda k, body: f"<html><body>{side(k)}{body}<div class='tail'>All rights</div></body></html>"
    two = [("https://two.example/", page(k, f"<div class='{'story' if k % 3 else 'text'}'><p>{story(k)}</p></div>")) for k in range(30)]
    slugs = [("https://slug.example/", page(k, f"<div id='on-{chr(97 + k)}-things'><p>{story(k)}</p></div>")) for k in range(20)]
    articles = [("https://art.example/", page(k, f"<article id='on-{chr(97 + k)}-things'><p>{story(k)}</p></article>")) for k in range(20)]
    mixed = [("https://mixed.example/", page(k, f"<article><p>{story(k)}</p></article>" if k else f"<div class='note'><p>{story(k)}</p></div>")) for k in range(20)]
    nulls = [(None, page(k, f"<div class='c{chr(97 + k)}'><p>{story(k)}</p></div>")) for k in range(20)]
    lone = [("https://lone.example/", page(0, f"<div class='text'><p>{story(0)}</p></div>"))]
    got = extracted(spark, two + slugs + articles + mixed + nulls + lone)
    assert got == [story(k) for group in (two, slugs, articles, mixed, nulls, lone) for k in range(len(group))]


NAMES = {"<article>": '<div class="q">', "</article>": "</div>", "<nav>": '<div class="r">', "</nav>": "</div>", 'class="ad"': 'class="s"', "<footer>": '<div class="t">', "</footer>": "</div>"}


def test_templates_find_the_main_text_without_telling_names(spark):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    truth, pages = {}, []
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        truth[r.page_id] = " ".join(re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", inner))).split(" ")).strip()
        plain = r.html
        for old, new in NAMES.items():
            plain = plain.replace(old, new)
        pages.append((r.page_id, r.url, plain))
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == truth
    # the templates do it: without them many pages come out otherwise
    assert sum(alone(page) != truth[k] for k, _, page in pages) > 0.1 * len(pages)


BARE = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b")


@pytest.mark.parametrize("classes", [True, False])
def test_plain_divs_are_told_apart_by_context(spark, classes):
    import html

    pages, truth = [], {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        truth[r.page_id] = " ".join(re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", inner))).split(" ")).strip()
        bare = BARE.sub(r"<\1div", r.html)
        pages.append((r.page_id, r.url, bare if classes else re.sub(r' (class|id)="[^"]*"', "", bare)))
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    wrong = [k for k in truth if got[k] != truth[k]]
    assert not wrong
    assert sum(alone(page) != truth[k] for k, _, page in pages) >= len(wrong)


def test_slots_that_change_places_or_repeat(spark):
    story = lambda k: f"Story {k} goes on and on, for it is long and has much to tell to whom it may concern in the year {k}, and later." * (1 + k % 3)
    side = lambda k: f"<section><p>Aside {k}</p></section>"
    more = "<div class='k'><p>" + "The same long words stand on all pages of the house. " * 9 + "</p></div>"
    page = lambda k: f"<body>{side(k) if k % 2 else ''}<div class='z'><h1>Title {k}</h1><p>{story(k)}</p></div>{more}{'' if k % 2 else side(k)}</body>"
    hosts = [(f"https://h{h}.example/{k}", page(10 * h + k)) for h in range(3) for k in range(12)]
    got = extracted(spark, hosts)
    assert got == [f"Title {10 * h + k} {story(10 * h + k)}" for h in range(3) for k in range(12)]
    assert sum(alone(p) != t for (_, p), t in zip(hosts, got)) > 10


def test_misplaced_and_valid_tokens():
    assert extraction.misplaced([1, 2, 3]) == extraction.misplaced([]) == set()
    assert extraction.misplaced([5, 1, 2, 3]) == {0} and extraction.misplaced([1, 9, 2, 3, 4]) == {1} and len(extraction.misplaced([2, 1])) == 1
    rows = pd.DataFrame({"token": ["", "/a", "/a/b", "/a/b/c", "/a/li/d", "/x"], "pages": [20] * 6, "wrong": [0, 0, 2, 0, 1, 0]})
    assert extraction.valid(rows) == {"/a", "/a/li/d", "/x"}


@pytest.mark.parametrize("page", ['<a "x ' * 150_000, "<a x=\"'" * 120_000, '<a x="' * 150_001, "<div>" * 200_000, "<button>" * 120_000, "<div>" * 50_000 + "</p>" * 190_000, "<li><blockquote>" * 40_000 + "<li></li>" * 30_000])
def test_broken_pages_are_read_in_time_and_memory(page):
    import time
    import tracemalloc

    began = time.time()
    alone(page)
    assert time.time() - began < 5
    tracemalloc.start()
    list(extraction.read(page[:200_000]))
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_deep_elements_count_as_those_they_are_in():
    deep = "<div>" * 300 + "<p>in</p>" + "</div>" * 299 + "<p>out</p></div><p>after</p>"
    blocks = [(node.path.count("/"), text) for what, node, text in extraction.read(deep) if what == "text"]
    assert blocks == [(extraction.DEPTH, "in"), (2, "out"), (1, "after")]


@pytest.mark.parametrize("limit", [1000, 20_000, 10**9])
def test_shards_fit_and_split_only_when_they_must(spark, sf, limit):
    rows = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet"), limit).collect()
    size, members = Counter(), Counter()
    for r in rows:
        assert len(r.shard) == r.depth and r.overflow == 0
        size[r.shard] += r.n_bytes
        members[r.shard] += 1
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(size[s] <= limit or members[s] == 1 for s in size)
    for s in size:  # the bucket that a shard was split from was too large
        if s:
            assert sum(n for t, n in size.items() if t.startswith(s[:-1])) > limit


def test_shards_of_odd_rows(spark):
    schema = "doc_id long, text string, shard string"
    rows = [(1, "x" * 100, "a")] * 25 + [(None, None, "b"), (2, "", "c"), (3, "y" * 900, "d")]
    got = sharding.shard(spark.createDataFrame(rows, schema), 300).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r.shard, r.overflow] += r.n_bytes
    assert all(n <= 300 or n == 900 for n in size.values())
    assert sharding.shard(spark.createDataFrame([], schema), 300).count() == 0


def test_written_shards_hold_their_own_rows(spark, tmp_path):
    rows = [(1, "x" * 100, "a")] * 25 + [(2, f"{k:03}" * 30, f"b{k}") for k in range(25)] + [(None, f"{k:03}" * 30, None) for k in range(25)] + [(3, "y" * 900, "d"), (4, None, "e"), (5, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sharding.write_shards(docs, str(tmp_path / "out"), 300)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in (tmp_path / "out").glob("shard=*"))
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    size, want = Counter(), Counter()
    for r in got:
        size[r.shard] += len(r.text or "")
    for r in sharding.shard(docs, 300).collect():
        want[f"b{r.shard}-{r.overflow}"] += r.n_bytes
    assert size == want and all(n <= 300 or n == 900 for n in size.values())


TEXTS = [
    "Mail jo.smith9@corp.example.com or JO.SMITH9@corp.example.com, call +1 (503) 555-8963 or +1-503-555-8963.",
    "IP 97.216.119.150, card 4111 1111 1111 1111, ssn 123-45-6789; Mr John Smith met Mrs. Anna Smith and Frau Müller.",
    "Господин Иван Петров, IBAN DE89 3704 0044 0532 0130 00", "nothing at all", None, "", "jo.smith9@corp.example.com again, é𝒳 4111111111111111",
]


def test_surrogates(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], None)]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, digest string"), "key").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and got[None].text == got[0].text and got[0].digest == "clash"
    assert got[3].text == TEXTS[3] and got[4].text is None and got[5].text == ""
    for secret in ("smith9", "555-8963", "97.216", "1111 1111", "123-45", "John", "Anna", "Müller", "Петров", "0532"):
        assert not any(secret.lower() in (r.text or "").lower() for r in out)
    a, b = re.findall(r"\S+@[a-z.]+\.example", got[0].text)
    assert a == b and got[6].text.startswith(a)
    first, second = re.findall(r"\+1[ -]\(?(\d{3})\)?[ -](\d{3}-\d{4})", got[0].text)
    assert first == second
    card = re.search(r"card (4\d{3}) (\d{4}) (\d{4}) (\d{4})", got[1].text)
    assert card and "".join(card.groups()) in got[6].text
    names = re.search(r"Mr (\w+) (\w+) met Mrs\. (\w+) (\w+) and Frau (\w+)", got[1].text)
    assert names[2] == names[4] != names[5] and names[1] in pii.GIVEN["m", "latin"] and names[3] in pii.GIVEN["f", "latin"]
    assert re.search(r"Господин [А-Я][а-яё]+ [А-Я][а-я]+,", got[2].text)
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "key").count() == 0


def test_surrogates_stay_distinct(spark):
    entities = [("family_latin", f"n{k}") for k in range(3000)] + [("given_m_latin", f"g{k}") for k in range(300)] + [("email", f"{c}@x.com") for c in "abcdefghijklmnopqrst"]
    df = pii.surrogates(spark.createDataFrame(entities, "type string, canon string"), "key").collect()
    assert len({(r.type, r.surrogate) for r in df}) == len(entities) == len(df)
    assert not {(r.type, r.surrogate) for r in df} & set(entities)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in rows}
    assert kept and kept < {r.doc_id for r in docs.select("doc_id").collect()}
    size = Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 2048
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
