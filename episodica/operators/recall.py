"""The composite read: dense, unit and time-context scores of a store's episodes, fused, reinstated around an anchor, joined by schemas.

Everything is keyed by (store_id, qid): a question meets the episodes of its own store only, in blocks.  What is known of a question's
candidates as a whole (ranges, anchors) is an aggregate of partial sums, joined back; no question's candidates are sorted before
copies are gone and a limit applies.

episodes: store_id, session, idx, text, v, strength.  questions: store_id, qid, text, v, session, position (null session: no time
context).  schemas: store_id, schema, centroid, mass, exemplars.  Ties go to the episode that is first by (session, idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import StoreConfig
from ..functions import text as T
from ..functions import vectors as V
from . import dense, fuse, index, units

KEYS = ["session", "idx"]
ONE = ["store_id", "qid"]
#: What a decayed trace keeps, an anchor's share, what a recall adds to a trace, schemas at least.
KEPT, ANCHOR, REHEARSED, SCHEMAS = 0.85, 0.15, 0.05, 4


def _near(score: str | Column) -> Column:
    return F.round(score, 6)


def _units(episodes: DataFrame, questions: DataFrame, config: StoreConfig) -> DataFrame:
    """store_id, qid, keys, score of the episodes that share units with a question."""
    args = {"order": config.conj_order, "window": config.conj_window}
    length = F.size(T.content_terms(F.col("text"))).cast("long").alias("length")
    documents = episodes.select("store_id", *KEYS, length)
    if config.conj_weighting == "bm25":
        return index.bm25(units.unit_counts(episodes, ["store_id", *KEYS], **args), units.unit_counts(questions, ONE, **args), documents, KEYS, ["store_id"])
    return index.cosine(units.unit_rows(episodes, ["store_id", *KEYS], **args), units.unit_rows(questions, ONE, **args), documents, KEYS, config.conj_weighting, ["store_id"])


def candidates(episodes: DataFrame, questions: DataFrame, config: StoreConfig) -> DataFrame:
    """store_id, qid, keys, strength, key (of the text), semantic, conjunctive, temporal (null without a session); a pathway of no weight is
    left out, but semantic.  A question's candidates lie together and are kept (memory, then disk; what a lost executor held is made
    again), so that what follows neither makes nor moves them again; spark.catalog.clearCache() lets go of them."""
    known = episodes.withColumn("key", F.md5("text"))
    rows = dense.products(known, questions, [*KEYS, "strength", "key"]).withColumnRenamed("score", "semantic")
    if config.w_conjunctive > 0:
        rows = rows.join(_units(episodes, questions, config).withColumnRenamed("score", "conjunctive"), [*ONE, *KEYS], "left").withColumn("conjunctive", F.coalesce("conjunctive", F.lit(0.0)))
    if config.w_temporal > 0:
        asked = questions.select(*ONE, F.col("session").alias("s"), F.coalesce("position", F.lit(0)).alias("p"))
        rows = rows.join(asked, ONE).withColumn("temporal", F.when(F.col("s").isNotNull(), V.theta(F.col("session"), F.col("idx"), F.col("s"), F.col("p")))).drop("s", "p")
    return rows.repartition(*ONE).persist()


def scored(rows: DataFrame, config: StoreConfig) -> DataFrame:
    """candidates() with <pathway>_n, total and score: fused, and lowered by what the episode's strength has lost."""
    parts = {"semantic": config.w_semantic, "conjunctive": config.w_conjunctive, "temporal": config.w_temporal}
    rows = fuse.fused(rows, {p: w for p, w in parts.items() if p in rows.columns}, config.fusion, KEYS, config.rrf_k, ONE, always=("semantic",))
    return rows.withColumn("score", F.col("total") * (KEPT + (1 - KEPT) * F.col("strength")))


def best(rows: DataFrame) -> DataFrame:
    """store_id, qid, a_session, a_idx, a_score: each question's best candidate."""
    first = F.min(F.struct(-_near("score"), *KEYS, "score")).alias("x")
    return rows.groupBy(*ONE).agg(first).select(*ONE, F.col("x.session").alias("a_session"), F.col("x.idx").alias("a_idx"), F.col("x.score").alias("a_score"))


def reinstated(rows: DataFrame, questions: DataFrame, config: StoreConfig) -> DataFrame:
    """rows with top (the best score before), reinstated (offset from the anchor, or null), anchor: where a question asks for what came
    right after or before, the neighbours of its best candidate gain, and the best candidate loses."""
    rows = rows.join(best(rows).join(questions.select(*ONE, T.direction(F.col("text")).alias("direction")), ONE), ONE)
    offset = F.when(F.col("session") == F.col("a_session"), (F.col("idx") - F.col("a_idx")) * F.col("direction"))
    asks = (F.col("direction") != 0) & F.lit(config.w_reinstate > 0)
    near = F.when(asks & offset.between(1, config.reinstate_span), offset)
    anchor = asks & F.coalesce(offset == 0, F.lit(False))
    rows = rows.withColumns({"reinstated": near.cast("long"), "anchor": anchor, "top": F.when(F.col("a_score") == 0, 1.0).otherwise(F.col("a_score"))})
    moved = F.when(F.col("anchor"), F.col("score") * ANCHOR).when(F.col("reinstated").isNotNull(), F.col("score") + config.w_reinstate * F.col("a_score") / F.col("reinstated"))
    return rows.withColumn("score", moved.otherwise(F.col("score"))).drop("a_session", "a_idx", "a_score", "direction")


def schema_hits(schemas: DataFrame, questions: DataFrame, k: int | None, mass_weight: float = 0.6) -> DataFrame:
    """store_id, qid, schema, similarity, mass, score, text: the max(4, k) best schemas of a question's store; those without an exemplar
    are left out after that choice."""
    sims = dense.products(schemas.select("store_id", "schema", F.col("centroid").alias("v")), questions, ["schema"]).withColumnRenamed("score", "similarity")
    heaviest = schemas.groupBy("store_id").agg(F.max(F.log1p("mass")).alias("heaviest"))
    rows = sims.join(schemas.select("store_id", "schema", "mass", "exemplars"), ["store_id", "schema"]).join(heaviest, "store_id")
    heavy = F.log1p("mass") / F.greatest("heaviest", F.lit(1e-6))
    rows = rows.withColumn("score", F.col("similarity") * (1 - mass_weight + mass_weight * heavy))
    nth = F.row_number().over(Window.partitionBy(*ONE).orderBy(F.desc(_near("score")), F.desc("schema")))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= max(SCHEMAS, k or SCHEMAS)).where(F.size("exemplars") > 0)
    return rows.select(*ONE, "schema", "similarity", "mass", "score", F.col("exemplars")[0].alias("text"), "nth")


def routed(hits: DataFrame, tops: DataFrame, questions: DataFrame, config: StoreConfig) -> DataFrame:
    """hits with scores in units of the question's best episode (tops: store_id, qid, top), higher for questions of the usual."""
    span = hits.groupBy(*ONE).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    rows = hits.join(span, ONE).join(questions.select(*ONE, T.is_generic(F.col("text")).alias("generic")), ONE).join(tops, ONE, "left")
    weight = config.w_schema * F.when(F.col("generic"), config.schema_generic_boost).otherwise(1.0) * F.coalesce("top", F.lit(1.0))
    share = F.when(F.col("high") - F.col("low") > 1e-6, (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    return rows.withColumn("score", weight * share).drop("low", "high", "top")


def recall(episodes: DataFrame, questions: DataFrame, schemas: DataFrame | None, config: StoreConfig, k: int | None = 5, include_schemas: bool = True, dedup: bool = True) -> DataFrame:
    """store_id, qid, rank, source, session, idx, schema, score, reinstated, anchor: each question's ranking, of k or of all.

    Of hits with equal texts the best stays if dedup; episodes go before schemas of an equal score.
    """
    rows = reinstated(scored(candidates(episodes, questions, config), config), questions, config)
    tops = rows.groupBy(*ONE).agg(F.max("top").alias("top"))
    none = F.lit(None).cast("long")
    out = rows.select(*ONE, F.lit("episode").alias("source"), F.lit(0).alias("late"), *KEYS, none.alias("schema"), "score", "reinstated", "anchor", "key", F.lit(0).alias("nth"))
    if include_schemas and schemas is not None and config.w_schema > 0:
        hits = routed(schema_hits(schemas, questions, k), tops, questions, config)
        out = out.unionByName(hits.select(*ONE, F.lit("schema").alias("source"), F.lit(1).alias("late"), none.alias("session"), none.alias("idx"), F.col("schema").cast("long").alias("schema"), "score", none.alias("reinstated"), F.lit(False).alias("anchor"), F.md5("text").alias("key"), "nth"))
    order = [F.desc(_near("score")), "late", *KEYS, "nth"]
    if dedup:
        carried = ["source", "schema", "score", "reinstated", "anchor"]
        first = out.groupBy(*ONE, "key").agg(F.min(F.struct((-_near("score")).alias("near"), "late", *KEYS, "nth", F.struct(*carried).alias("x"))).alias("m"))
        out = first.select(*ONE, "m.late", *[f"m.{c}" for c in KEYS], "m.nth", *[f"m.x.{c}" for c in carried])
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*ONE).orderBy(*order)).cast("long"))
    if k is not None:
        out = out.where(F.col("rank") <= k)
    return out.select(*ONE, "rank", "source", *KEYS, "schema", "score", "reinstated", "anchor")


def rehearsals(recalled: DataFrame) -> DataFrame:
    """store_id, keys, times, gain: what a recall's episodes gain in strength.  A read changes nothing: the next write adds the gains."""
    rows = recalled.where("source = 'episode'").groupBy("store_id", *KEYS).agg(F.count("*").alias("times"))
    return rows.withColumn("gain", REHEARSED * F.col("times"))


def rehearsed(episodes: DataFrame, gains: DataFrame) -> DataFrame:
    """episodes with strengths after the gains, at most 1."""
    rows = episodes.join(gains.select("store_id", *KEYS, "gain"), ["store_id", *KEYS], "left")
    return rows.withColumn("strength", F.least(F.lit(1.0), F.col("strength") + F.coalesce("gain", F.lit(0.0)))).drop("gain").select(episodes.columns)
