"""Inverted-index scoring: units with idf, binary and BM25 weights, and three lexical BM25 variants.

All take postings (keys, u, tf, length), query units (qid, u, tf) and documents (keys, length) and give (qid, keys, score) of the rows that
match: an equality join on the unit, so only postings of query units move.  Statistics of the units are sums over all rows.  With
by=["store_id"] all three have that column, and each store is an index of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, FLOOR = 1.5, 0.75, 0.25


def document_frequency(postings: DataFrame, by: list[str] | None = None) -> DataFrame:
    return postings.groupBy(*(by or []), "u").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def with_total(rows: DataFrame, documents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows with n, the number of documents, and avgdl, their mean length, of their store (of all: one row of two numbers beside each)."""
    total = documents.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))
    return rows.join(total, by) if by else rows.join(F.broadcast(total))


def dealt(postings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Postings by unit: they are made and moved once, and what follows (frequencies, norms, matches) meets them where they are."""
    return postings.repartition(*(by or []), "u")


def weights(postings: DataFrame, documents: DataFrame, weighting: str = "idf", by: list[str] | None = None) -> DataFrame:
    """by, u, w: the weight of each unit."""
    df = with_total(document_frequency(postings, by), documents, by)
    return df.select(*(by or []), "u", (F.lit(1.0) if weighting == "binary" else idf(F.col("n"), F.col("df"))).alias("w"))


def cosine(postings: DataFrame, queries: DataFrame, documents: DataFrame, keys: list[str], weighting: str = "idf", by: list[str] | None = None) -> DataFrame:
    """Weighted cosine of unit sets; a query's norm takes only units that occur."""
    by = by or []
    postings = dealt(postings.select(*by, *keys, "u"), by)
    w = weights(postings, documents, weighting, by)
    square = F.sum(F.col("w") * F.col("w"))
    norms = postings.join(w, [*by, "u"]).groupBy(*by, *keys).agg(F.sqrt(square).alias("norm"))
    q = queries.select(*by, "qid", "u").distinct().join(w, [*by, "u"])
    q_norms = q.groupBy(*by, "qid").agg(F.sqrt(square).alias("q_norm"))
    met = postings.join(q, [*by, "u"]).groupBy(*by, "qid", *keys).agg(square.alias("s"))
    return met.join(norms, [*by, *keys]).join(q_norms, [*by, "qid"]).select(*by, "qid", *keys, (F.col("s") / (F.col("norm") * F.col("q_norm"))).alias("score"))


def _saturated(avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.greatest(avgdl, F.lit(1e-9))))


#: Rows of question units that are sent to the postings; with more of them, postings are dealt by unit instead.
FEW = 100_000


def is_few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


def bm25(postings: DataFrame, queries: DataFrame, documents: DataFrame, keys: list[str], by: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """BM25 with a positive idf; a query unit counts once.  Postings that lie by document are summed where they are.

    of: the postings of the documents to score, if not all; weights and lengths are those of all."""
    by = by or []
    asked = queries.select(*by, "qid", "u").distinct()
    few = is_few(asked)
    send = F.broadcast if few else (lambda rows: rows)
    postings = postings if few else dealt(postings, by)
    # of the units' frequencies only those of query units are used
    counts = document_frequency(postings.join(send(asked.select(*by, "u").distinct()), [*by, "u"], "left_semi"), by)
    q = asked.join(with_total(counts, documents, by), [*by, "u"]).select(*by, "qid", "u", idf(F.col("n"), F.col("df")).alias("w"), "avgdl")
    met = (postings if of is None else of).join(send(q), [*by, "u"])
    return met.groupBy(*by, "qid", *keys).agg(F.sum(F.col("w") * _saturated(F.col("avgdl"))).alias("score"))


def okapi(postings: DataFrame, queries: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Okapi BM25: negative idfs become a share of the mean idf; a repeated query term counts each time."""
    postings = dealt(postings)
    df = with_total(document_frequency(postings), documents).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))
    w = df.join(F.broadcast(mean)).select("u", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("w"))
    q = queries.select("qid", "u", F.col("tf").alias("times")).join(w, "u")
    met = with_total(postings.join(q, "u"), documents)
    return met.groupBy("qid", *keys).agg(F.sum(F.col("times") * F.col("w") * _saturated(F.col("avgdl"))).alias("score"))


def counted(items: Column) -> Column:
    """(u, tf) of the distinct elements of an array, without a shuffle: the array is sorted and cut where it changes."""
    of = lambda a, f: F.transform(F.array(a), f)[0]

    def cut(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return of(starts, lambda a: F.transform(a, lambda i, n: F.struct(F.get(s, i).alias("u"), (F.coalesce(F.get(a, n + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return of(F.sort_array(items), cut)


def token_counts(texts: DataFrame, keys: list[str], tokens: Column, among: DataFrame | None = None) -> DataFrame:
    """keys, u, tf, length of any token array; a row of texts is one document.  among: of these units (u) alone, which are sent to the texts."""
    if among is not None:
        rows = texts.select(*keys, tokens.alias("tokens")).select(*keys, F.size("tokens").cast("long").alias("length"), F.explode("tokens").alias("u"))
        return rows.join(F.broadcast(among), "u", "left_semi").groupBy(*keys, "u", "length").agg(F.count("*").alias("tf"))
    rows = texts.select(*keys, tokens.alias("tokens")).select(*keys, F.size("tokens").cast("long").alias("length"), F.explode(counted(F.col("tokens"))).alias("c"))
    return rows.select(*keys, "c.u", "c.tf", "length")


def top(scored: DataFrame, k: int | None, order: list[str], score: str = "score") -> DataFrame:
    """scored with rank: by score, ties by the order columns.  k: that many for each question (a limit that Spark pushes below the sort)."""
    window = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 6)), *order)
    out = scored.withColumn("rank", F.row_number().over(window))
    return out if k is None else out.where(F.col("rank") <= k)


def ranks(scored: DataFrame, wanted: DataFrame, keys: list[str], k: int | None = None, own: DataFrame | None = None) -> DataFrame:
    """qid, keys, rank of the wanted rows (qid, keys), counted from the rows of their question that stand before them: no question's
    rows are sorted, and counts are partial sums.  Wanted rows that have no score have no rank.

    k: of the best k wanted rows of each question alone, so that a question's rows meet k others at most; these hold all wanted rows among the
    first k of the ranking, and the first wanted row wherever it stands.  own: the scores of the wanted rows, if they are made apart."""
    scored = scored.select("qid", *keys, (-F.round("score", 6)).alias("at"))
    if own is None:
        own = scored.join(wanted.select("qid", *keys).distinct(), ["qid", *keys], "left_semi")
    else:
        own = own.select("qid", *keys, (-F.round("score", 6)).alias("at"))
    if k is not None:
        own = own.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("at", *keys))).where(F.col("nth") <= k).drop("nth")
    own = own.select("qid", *[F.col(c).alias(f"own_{c}") for c in (*keys, "at")])
    if k is not None and is_few(wanted.select("qid").distinct()):
        own = F.broadcast(own)
    upto = F.lit(True)
    for c in reversed(["at", *keys]):
        upto = (F.col(c) < F.col(f"own_{c}")) | ((F.col(c) == F.col(f"own_{c}")) & upto)
    met = scored.join(own, "qid").where(upto).groupBy("qid", *[f"own_{c}" for c in keys]).agg(F.count("*").alias("rank"))
    return met.select("qid", *[F.col(f"own_{c}").alias(c) for c in keys], "rank")


# ---- the index as tables, and its upkeep
def build(postings: DataFrame, documents: DataFrame, folder: str) -> None:
    """Write postings, unit weights, norms and documents once, so that questions read them instead of making them again."""
    spark = postings.sparkSession
    keys = [c for c in documents.columns if c != "length"]
    postings.write.mode("overwrite").parquet(f"{folder}/postings")
    documents.write.mode("overwrite").parquet(f"{folder}/documents")
    held, docs = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/documents")
    with_total(document_frequency(held), docs).select("u", "df", idf(F.col("n"), F.col("df")).alias("w")).write.mode("overwrite").parquet(f"{folder}/units")
    w = spark.read.parquet(f"{folder}/units")
    norms = held.join(w, "u").groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    norms.write.mode("overwrite").parquet(f"{folder}/norms")


def search(folder: str, queries: DataFrame, keys: list[str]) -> DataFrame:
    """As cosine with idf weights, from the tables that build() wrote: only postings of query units and norms of matches are read on."""
    read = lambda name: queries.sparkSession.read.parquet(f"{folder}/{name}")
    square = F.sum(F.col("w") * F.col("w"))
    q = queries.select("qid", "u").distinct().join(read("units").select("u", "w"), "u")
    met = read("postings").select(*keys, "u").join(q, "u").groupBy("qid", *keys).agg(square.alias("s"))
    q_norms = q.groupBy("qid").agg(F.sqrt(square).alias("q_norm"))
    return met.join(read("norms"), keys).join(q_norms, "qid").select("qid", *keys, (F.col("s") / (F.col("norm") * F.col("q_norm"))).alias("score"))


def reconciled(rows: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (of postings, patterns, norms) whose episode is still there."""
    return rows.join(live.select(*keys).distinct(), keys, "left_semi")


def lookup(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the wanted keys; keys that no row has are left out."""
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that a cache has no row of."""
    return wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def completed(ranked: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """qid, keys, rank over all rows (qid, keys): the unranked follow the ranked, in order of their keys."""
    rest = every.select("qid", *keys).join(ranked.select("qid", *keys), ["qid", *keys], "left_anti")
    last = ranked.groupBy("qid").agg(F.max("rank").alias("last"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(*keys))
    rest = rest.withColumn("nth", nth).join(last, "qid", "left").select("qid", *keys, (F.coalesce("last", F.lit(0)) + F.col("nth")).cast("long").alias("rank"))
    return ranked.select("qid", *keys, F.col("rank").cast("long").alias("rank")).unionByName(rest)
