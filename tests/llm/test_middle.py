import hashlib
import random
import re

from episodica.llm import middle

SCHEMA = "doc_id long, text string, form string, output int"


def plain_version(i, text):
    """The contract, a text at a time."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100 else "spm" if h4 % 100 < 50 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return i, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text)


def made():
    rng = random.Random(5)
    pool = ["", "a", "ß", "語", "😀", "\n", "\n", "\r", " ", "<", "P", ">", "<P>", "<S>", "<M>", "x" * 50, "\x00"]
    texts = ["".join(rng.choices(pool[:12], k=rng.randrange(30))) for _ in range(400)] + ["".join(rng.choices(pool, k=8)) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "end\n", "<", "<P", "P>", "é" * 300_000, "line\n" * 200_000, "<P", ">", "\n<", "S>"]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "a\nb\n"), (None, None), (3, "again\n3"), (3, "again\n3"), (-1, "minus\nc")]


def test_equal_to_a_plain_version(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    for parts in (1, 3):
        got = [tuple(r) for r in middle.digests(df.repartition(parts)).collect()]
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(got, key=key) == sorted((plain_version(i, t) for i, t in rows), key=key)


def test_small_slices_cut_alike(spark, monkeypatch):
    rows = made()[:300]
    texts = [t or "" for _, t in rows]
    import pyarrow as pa

    data, at = middle.buffers(pa.array(["skipped", *texts]).slice(1))
    whole = middle._transform([i for i, _ in rows], data, at, 7, 100, 50).to_pylist()
    runs = list(middle.slices(at, 40))
    assert [i for i, _ in runs] == [0, *[j for _, j in runs]][:-1] and runs[-1][1] == len(rows)
    parts = [r for i, j in runs for r in middle._transform([x for x, _ in rows[i:j]], data[at[i] : at[j]], at[i : j + 1] - at[i], 7, 100, 50).to_pylist()]
    assert parts == whole


def test_rate_and_empty_table(spark):
    df = spark.createDataFrame([(k, f"{k}\na\nb\nc", None, None) for k in range(500)], SCHEMA)
    forms = middle.transform(df, rate=40, spm=20).groupBy("form").count().collect()
    counts = {r["form"]: r["count"] for r in forms}
    assert 250 < counts["plain"] < 350 and counts["spm"] < counts["psm"]
    assert middle.digests(df.limit(0)).count() == 0
