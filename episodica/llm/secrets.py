"""Secret scans (1): fixed patterns, and a randomness test battery under length-aware false-discovery control.

The battery reads the runs of letters, digits and + / _ - of MIN_LENGTH and more in what the patterns leave of a text (a run
that a pattern cuts is tested in its parts).  Its parts:

* the encoding is inferred from the characters: hexadecimal, base 32, base 36, base 62 or base 64, or letters of both cases
  (a run of digits alone is a number, one of letters of one case alone a word: they are not tested);
* three tests of the hypothesis "characters are drawn evenly from the encoding's alphabet": chi-squared uniformity
  (Wilson-Hilferty), runs above and below the middle of the alphabet, and lag-1 serial correlation of the places in it.
  A run that any of them refuses at ALPHA / 3 is not random;
* the same statistics against ordinary text and identifiers, which repeat letters and seldom change between small letters,
  capitals and digits (names made of capitalised words change more often, so letters alone need more changes): a p value from the number of coincidences and the number of class changes together;
* these p values go through Benjamini-Hochberg control at rate RATE in strata of like length: short runs, which are many and
  carry little evidence, don't loosen the level of long ones, nor long ones that of short ones.  The control reads
  counts of p values in PER_DECADE bins a decade, a table of bounded size, taken over all rows.

Only DataFrame operations and SQL functions are used.

Defined results: a null text is empty and has no spans; spans of several kinds may overlap, but the battery's don't overlap
those of the patterns; a text's matches cost time in proportion to their number; repeated rows each count and get their own result row; extra columns are carried by redact() and not
read by scan(); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared
from .spans import bound, find, merged, outside, rewrite

#: Kind, pattern, what a match must be like.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
ASSIGN_LEAST = 6
MIN_LENGTH, ALPHA, RATE, PER_DECADE, DECADES = 20, 0.001, 0.01, 4, 30
RUN = f"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
RUNS = "array<struct<start:int,end:int,test:struct<length:int,p_random:double,p_text:double>>>"
ORDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, to a relative error of some per cent far out (Karagiannidis and Lioumpas)."""
    x = F.greatest(F.abs(z), F.lit(0.05))
    upper = F.least((1 - F.exp(-1.4 * x / 2**0.5)) * F.exp(-x * x / 2) / (1.135 * (2 * 3.141592653589793) ** 0.5 * x), F.lit(0.5))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _code(c: Column, kind: Column) -> Column:
    """Place of a character in the alphabet of the encoding, from 0."""
    low = F.ascii(c)
    digit, upper, lower = low.between(48, 57), low.between(65, 90), low.between(97, 122)
    return (
        F.when(kind == "hex", F.when(digit, low - 48).otherwise(F.when(lower, low - 87).otherwise(low - 55)))
        .when(kind == "base32", F.when(upper, low - 65).otherwise(low - 24))
        .when(kind == "base36", F.when(digit, low - 48).otherwise(F.when(lower, low - 87).otherwise(low - 55)))
        # letters, base 62 and base 64: A-Z, a-z, 0-9, then the two signs of either alphabet
        .otherwise(F.when(upper, low - 65).when(lower, low - 71).when(digit, low + 4).when(c.isin("+", "-"), 62).otherwise(63))
    )


def battery(value: Column) -> Column:
    """struct(length, p_random, p_text): the least p value of the three tests against randomness, and the p value against text."""
    kind = (
        F.when(~value.rlike("[A-Za-z]") | value.rlike("^(?:[^0-9A-Z]+|[^0-9a-z]+)$"), F.lit(None))
        .when(~value.rlike("[0-9]"), "letters")
        .when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(value.rlike("^[A-Z2-7]+$"), "base32")
        .when(value.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .when(value.rlike("^[0-9a-zA-Z]+$"), "base62")
        .otherwise("base64")
    )
    # letters may come with the signs of base 64
    alphabet = F.when(kind == "hex", 16.0).when(kind == "base32", 32.0).when(kind == "base36", 36.0).when(kind == "base62", 62.0).when((kind == "letters") & value.rlike("^[a-zA-Z]+$"), 52.0).otherwise(64.0)
    characters = F.split(value, "")
    codes = F.transform(characters, lambda c: _code(c, kind).cast("double"))
    # each step is a one-element array, so that the next names it instead of repeating it
    s = F.struct(kind.alias("kind"), alphabet.alias("a"), codes.alias("x"), F.length(value).cast("double").alias("n"), value.alias("value"))

    def sums(s: Column) -> Column:
        x, n = s["x"], s["n"]
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda t, y: t + f(y))
        middle = (s["a"] - 1) / 2
        kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["value"], "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
        return F.struct(
            s["a"].alias("a"), n.alias("n"), s["kind"].alias("kind"),
            total(F.transform(F.array_distinct(x), lambda c: F.size(F.filter(x, lambda y: y == c)).cast("double")), lambda k: k * (k - 1)).alias("same"),
            total(x, lambda y: y - middle).alias("sum"),
            total(x, lambda y: (y - middle) * (y - middle)).alias("square"),
            total(pairs, lambda y: (y["p"] - middle) * (y["q"] - middle)).alias("product"),
            total(pairs, lambda y: F.when((y["p"] > middle) != (y["q"] > middle), 1.0).otherwise(0.0)).alias("turns"),
            total(x, lambda y: F.when(y > middle, 1.0).otherwise(0.0)).alias("high"),
            (F.length(kinds) - 1).cast("double").alias("changes"),
        )

    def verdict(t: Column) -> Column:
        n, a = t["n"], t["a"]
        chi = a / n * (t["same"] + n) - n
        free = a - 1
        z_chi = (F.pow(F.greatest(chi / free, F.lit(1e-9)), F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        high, low = t["high"], n - t["high"]
        expected = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.25)))
        z_runs = F.abs(t["turns"] + 1 - expected) / spread
        variance = F.greatest(t["square"] - t["sum"] * t["sum"] / n, F.lit(1e-9))
        z_serial = F.abs((t["product"] - t["sum"] * t["sum"] / n) / variance) * F.sqrt(n)
        p_random = F.least(_tail(z_chi), 2 * _tail(z_runs), 2 * _tail(z_serial))
        # of ordinary text: chance of a coincidence 0.065, of three 0.0052; of a change between classes 0.1, in letters alone 0.3
        pairs, k2, k3 = n * (n - 1), 0.065, 0.0052
        z_same = (pairs * k2 - t["same"]) / F.sqrt(4 * pairs * (n - 2) * (k3 - k2 * k2) + 2 * pairs * (k2 - k2 * k2))
        change = F.when(t["kind"] == "letters", 0.3).otherwise(0.1)
        z_changes = (t["changes"] - 0.5 - change * (n - 1)) / F.sqrt(change * (1 - change) * (n - 1))
        p_text = _tail((z_same + z_changes) / 2**0.5)
        return F.struct(n.cast("int").alias("length"), p_random.alias("p_random"), F.greatest(p_text, F.lit(10.0**-DECADES)).alias("p_text"))

    out = F.transform(F.transform(F.array(s), sums), verdict)[0]
    return F.when(kind.isNotNull() & (F.length(value) >= MIN_LENGTH), out)


def _stratum(length: Column) -> Column:
    """Lengths that differ by less than a half are one stratum."""
    return F.floor(F.log2(length.cast("double")) * 2).cast("int")


def _bin(p: Column) -> Column:
    return F.floor(-F.log10(p) * PER_DECADE).cast("int")


def _spans(text: Column) -> dict[str, Column]:
    assigned = F.filter(find(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= ASSIGN_LEAST)
    return {"assign": assigned, "access": find(text, ACCESS), "hex": find(text, HEX)}


def _candidates(df: DataFrame) -> DataFrame:
    """df (with a column of each pattern's spans) with runs: the spans that the battery tests, and their p values."""
    parts = outside(F.col("body"), merged(F.concat("assign", "access", "hex")))
    span = lambda g, s: F.struct((g["start"] + s["start"]).alias("start"), (g["start"] + s["end"]).alias("end"), battery(s["value"]).alias("test"))
    tested = F.flatten(F.transform(parts, lambda g: F.transform(find(g["value"], RUN), lambda s: span(g, s))))
    some = F.filter(tested, lambda s: s["test"].isNotNull() & (s["test"]["p_random"] >= ALPHA / 3))
    return df.withColumn("runs", F.when(F.col("body").rlike(RUN), some).otherwise(F.array().cast(RUNS)))


def _prepared(docs: DataFrame) -> DataFrame:
    df = docs.withColumn("body", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return _candidates(df.withColumns(_spans(F.col("body"))))


def levels(runs: DataFrame) -> dict[int, int]:
    """stratum: the least bin from which on a run is a discovery, decided over all rows (column runs)."""
    tests = runs.select(F.explode("runs").alias("s")).select(_stratum(F.col("s.test.length")).alias("stratum"), _bin(F.col("s.test.p_text")).alias("bin"))
    counts = tests.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))  # at most PER_DECADE x DECADES rows
    ranked = counts.select("stratum", "bin", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    # the p values of a bin are at most 10 ** (-bin / PER_DECADE)
    good = F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE) * F.col("all") <= RATE * F.col("rank")
    # two rows for each doubling of the length at most
    return {r["stratum"]: r["least"] for r in ranked.where(good).groupBy("stratum").agg(F.min("bin").alias("least")).collect()}


def _discovered(df: DataFrame, table: dict[int, int]) -> DataFrame:
    """df with the spans of the battery (random) for the runs it tested."""
    level = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]) if table else F.lit(None).cast("map<int,int>")
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    hit = lambda s: _bin(s["test"]["p_text"]) >= F.try_element_at(level, _stratum(s["test"]["length"]))
    return df.withColumn("random", F.transform(F.filter("runs", lambda s: F.coalesce(hit(s), F.lit(False))), plain)).drop("runs")


KINDS = ("assign", "access", "hex", "random")


def _joined(kinds: tuple[str, ...]) -> Column:
    def rows(i: int, k: str) -> Column:
        return F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), F.concat_ws(":", F.lit(k), s["start"], s["end"]).alias("said")))

    return F.array_join(F.transform(F.array_sort(F.concat(*map(rows, range(len(kinds)), kinds))), lambda s: s["said"]), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: how many spans of each kind, the digest of the patterns' spans, and all spans."""
    df = _prepared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    places = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS[:3]]
    # places and p values, without the texts, are kept: texts are read and tested once
    held = shared(df.select("doc_id", *places, "runs"))
    df = _discovered(held, levels(held))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return df.select("doc_id", *counts, F.sha2(_joined(KINDS[:3]), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs, all columns, with each span of the text (overlapping ones as one) replaced by the mark, and n_chars, if there, counted anew."""
    table = levels(_prepared(docs.select("text").where(F.col("text").rlike(RUN))))
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    df = _discovered(_prepared(work), table)
    spans = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    marked = lambda places: F.transform(places, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("new")))
    n = sum((F.size(k) for k in KINDS), F.lit(0))
    df = df.withColumn("clean", F.when(n > 0, bound(merged(spans), lambda p: rewrite(F.col("body"), marked(p)))).otherwise(F.col("text").cast("string")))
    kinds = dict(docs.dtypes)
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("clean").alias(c))
        elif c == "n_chars":
            out.append(F.when(n > 0, F.length("clean")).otherwise(F.col("row.n_chars")).cast(kinds[c]).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return df.select(*out)
