import hashlib
import math
import random
import re

import pytest

from pyspark.sql import functions as F

from episodica.llm import secrets, spans

DOCS = "doc_id long, text string, n_chars long, kind string"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    n = [sum(k == i for _, k, _ in spans) for i in range(3)]
    return (*n, hashlib.sha256(",".join(x for _, _, x in sorted(spans)).encode()).hexdigest())


def test_patterns_equal_brute_force_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(docs).collect()}
    assert got == {r.doc_id: brute(r.text or "") for r in docs.collect()}


CASES = [
    None, "", "no secret", 'API_KEY : "abcdef"', "token=abc token=token: abcdef", "password=a passwd: 123456 é𝒳 secret='zz+/=.-'",
    "AKIA" + "A1" * 8 + " " + "f" * 24 + "g" + "0" * 23, "é𝒳 tOkEn = " + "0123456789abcdef" * 3, "token==abcdefg", "x" * 50_000 + " secret:" + "y" * 50_000,
]


def test_edge_cases(spark):
    rows = [(k, t, 0, "clash") for k, t in enumerate(CASES)] + [(None, "token=abcdefg", 0, None)] * 2
    out = secrets.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = "token=abcdefg" if r.doc_id is None else CASES[r.doc_id] or ""
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute(text)
    assert secrets.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_battery_finds_random_runs_and_leaves_words(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(44)) for _ in range(20)]
    plain = ["verylongidentifier_with_version_2_and_more", "Donaudampfschifffahrtsgesellschaft1", "path/to/some/file/of/2024/11/26/report", "a1" * 20, "0123456789" * 4 + "abcdefghijklmnop"]
    rows = [(k, f"before {x} after", 0, "") for k, x in enumerate(keys + plain)]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()}
    hits = [k for k in range(len(keys)) if got[k] == f"random:7:{7 + 44}"]
    assert len(hits) >= 18
    assert not any("random" in got[len(keys) + k] for k in range(len(plain)))


def test_redact(spark):
    rows = [(1, 'a token = "0123456789abcdef0123456789abcdef" b', 5, "x"), (2, "clean", 5, "y"), (3, None, None, None)]
    got = {r.doc_id: r for r in secrets.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == 'a [SECRET]" b' and got[1].n_chars == len(got[1].text) and got[1].kind == "x"
    assert got[2].text == "clean" and got[2].n_chars == 5 and got[3].text is None


@pytest.mark.parametrize("name", ["body", "assign", "row", "runs"])
def test_clashing_columns(spark, name):
    got = secrets.redact(spark.createDataFrame([(1, "secret: abcdef", "own")], f"doc_id long, text string, {name} string")).first()
    assert got["text"] == "[SECRET]" and got[name] == "own"


def tail(z):
    x = max(abs(z), 0.05)
    upper = min((1 - math.exp(-1.4 * x / 2**0.5)) * math.exp(-x * x / 2) / (1.135 * (2 * math.pi) ** 0.5 * x), 0.5)
    return upper if z >= 0 else 1 - upper


def plain_battery(v):
    """(length, p value against text) of a run that the tests for randomness don't refuse, else None."""
    only = lambda p: re.fullmatch(p, v) is not None
    if not re.search("[A-Za-z]", v) or only("[^0-9A-Z]+") or only("[^0-9a-z]+"):
        return None
    whole = secrets.ORDER.replace("-", "").replace("_", "")
    case = str.lower if re.search("[a-z]", v) else str.upper
    if not re.search("[0-9]", v):
        kind, alphabet = "letters", whole[:52] if only("[A-Za-z]+") else whole
    elif only("[0-9a-f]+|[0-9A-F]+"):
        kind, alphabet = "hex", case("0123456789abcdef")
    elif only("[A-Z2-7]+"):
        kind, alphabet = "base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    elif only("[0-9a-z]+|[0-9A-Z]+"):
        kind, alphabet = "base36", case("0123456789abcdefghijklmnopqrstuvwxyz")
    else:
        kind, alphabet = ("base62", whole[:62]) if only("[0-9a-zA-Z]+") else ("base64", whole)
    x, n, a = [alphabet.index({"-": "+", "_": "/"}.get(c, c)) for c in v], len(v), len(alphabet)
    same = sum(k * (k - 1) for k in (x.count(c) for c in set(x)))
    chi, free, middle = a / n * (same + n) - n, a - 1, (a - 1) / 2
    z_chi = (max(chi / free, 1e-9) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    high = sum(c > middle for c in x)
    expected = 2 * high * (n - high) / n + 1
    turns = sum((p > middle) != (q > middle) for p, q in zip(x, x[1:]))
    z_runs = abs(turns + 1 - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 0.25))
    off, square = sum(c - middle for c in x), sum((c - middle) ** 2 for c in x)
    variance = max(square - off * off / n, 1e-9)
    z_serial = abs((sum((p - middle) * (q - middle) for p, q in zip(x, x[1:])) - off * off / n) / variance) * math.sqrt(n)
    if min(tail(z_chi), 2 * tail(z_runs), 2 * tail(z_serial)) < secrets.ALPHA / 3:
        return None
    changes = len(re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "0", v)))) - 1
    pairs, k2, k3, r = n * (n - 1), 0.065, 0.0052, 0.3 if kind == "letters" else 0.1
    z_same = (pairs * k2 - same) / math.sqrt(4 * pairs * (n - 2) * (k3 - k2 * k2) + 2 * pairs * (k2 - k2 * k2))
    z_changes = (changes - 0.5 - r * (n - 1)) / math.sqrt(r * (1 - r) * (n - 1))
    return n, max(tail((z_same + z_changes) / 2**0.5), 10.0**-secrets.DECADES)


def plain_random(texts):
    """The battery's spans of all texts, run by run."""
    tests = []
    for d, text in enumerate(texts):
        taken = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", text)]
        taken += [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
        hidden = list(text)
        for a, b in taken:
            hidden[a:b] = " " * (b - a)
        for m in re.finditer(secrets.RUN, "".join(hidden)):
            if found := plain_battery(m[0]):
                n, p = found
                tests.append((math.floor(math.log2(n) * 2), math.floor(-math.log10(p) * secrets.PER_DECADE), d, m.start(), m.end()))
    out = {d: [] for d in range(len(texts))}
    for stratum in {t[0] for t in tests}:
        bins = [t[1] for t in tests if t[0] == stratum]
        good = [b for b in set(bins) if 10.0 ** (-b / secrets.PER_DECADE) * len(bins) <= secrets.RATE * sum(x >= b for x in bins)]
        for t in tests:
            if t[0] == stratum and good and t[1] >= min(good):
                out[t[2]].append((t[3], t[4]))
    return {d: [f"random:{a}:{b}" for a, b in sorted(x)] for d, x in out.items()}


def test_battery_equals_a_plain_version(spark, sf):
    rng = random.Random(8)
    alphabets = ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", secrets.ORDER[:62], secrets.ORDER[:64], secrets.ORDER[:62] + "-_"]
    draw = lambda a: "".join(rng.choices(a, k=rng.choice((20, 21, 24, 32, 44, 100, 900))))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t or "" for t in CASES]
    texts += [f"some words {draw(a)} or token={draw(a)}/{draw(a)}, {'ab' * 12}{draw(a)} {'word' * 8}" for a in alphabets for _ in range(12)]
    texts += ["getUserNameFromDatabaseTable and_some_snake_case_name_2 /usr/local/lib/python3/site-packages", "AKIA" + "Z9" * 10 + "/" + draw(secrets.ORDER[:62]), "x1" * 4000]
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("random")] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = plain_random(texts)
    assert sum(map(len, want.values())) > 60
    # a p value at a bin's edge may round into either bin
    assert sum(got[d] != want[d] for d in want) <= 1


def test_many_matches_cost_time_in_proportion(spark):
    import time

    seconds = {}
    for n in (1000, 80_000):
        docs = spark.createDataFrame([(1, "token=abcdefg " * n)], "doc_id long, text string")
        began = time.time()
        (row,) = secrets.scan(docs).collect()
        (clean,) = secrets.redact(docs).collect()
        seconds[n] = time.time() - began
        assert row.n_assign == n and clean.text == "[SECRET] " * n
    assert seconds[80_000] < seconds[1000] + 30


def test_spans_merge_and_rewrite(spark):
    rng = random.Random(1)
    texts = ["", "12", "é𝒳9 77", "x" * 3000 + "5" + "é" * 2100 + "66"] + ["".join(rng.choices("ab 1𝒳2é", k=rng.randint(0, 4000))) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.find(F.col("t"), "[0-9]+").alias("p"), spans.find(F.col("t"), "[0-9]|[ab]{2}").alias("q"))
    df = df.withColumn("m", spans.merged(F.concat("p", "q")))
    new = F.transform("m", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("#").alias("new")))
    for r in df.select("*", spans.outside(F.col("t"), F.col("m")).alias("o"), spans.rewrite(F.col("t"), new).alias("w")).collect():
        assert [(x.start, x.end, x.value) for x in r.p] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", r.t)]
        want = []
        for a, b in sorted([m.span() for m in re.finditer("[0-9]+", r.t)] + [m.span() for m in re.finditer("[0-9]|[ab]{2}", r.t)]):
            if want and a < want[-1][1]:
                want[-1][1] = max(b, want[-1][1])
            else:
                want.append([a, b])
        assert [[x.start, x.end] for x in r.m] == want
        edges = [0, *(x for p in want for x in p), len(r.t)]
        parts = [(edges[k], r.t[edges[k] : edges[k + 1]]) for k in range(0, len(edges), 2)]
        assert [(x.start, x.value) for x in r.o] == parts and r.w == "#".join(x for _, x in parts)


def test_redact(spark):
    rows = [(k, t, len(t or ""), "kept") for k, t in enumerate(CASES)]
    got = secrets.redact(spark.createDataFrame(rows, DOCS)).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows] and all(r.kind == "kept" for r in got)
    for r in got:
        text = CASES[r.doc_id]
        places = []
        for m in sorted(m.span() for p in (ASSIGN, re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")) for m in p.finditer(text or "") if p is not ASSIGN or len(m[2]) >= 6):
            if places and m[0] < places[-1][1]:
                places[-1] = (places[-1][0], max(m[1], places[-1][1]))
            else:
                places.append(m)
        want = text
        for a, b in reversed(places):
            want = want[:a] + "[SECRET]" + want[b:]
        assert r.text == want and r.n_chars == len(want or "")
