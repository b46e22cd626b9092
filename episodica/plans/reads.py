"""Registered queries of the composite read, its stages, its evaluation and the upkeep of a store, with SQL that says the same.

Turns are the episodes of stores of about CONVERSATIONS conversations, items their questions, and all embeddings the vectors of both;
clusters of embeddings of one label are the schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import StoreConfig
from ..functions import text as T
from ..functions import vectors as V
from ..operators import coding, consolidation, dense, evaluation, index, recall, units
from ..sources.corpora import incidents
from ..sources.tables import episodes, table
from . import catalog as C
from .catalog import EPISODES, KEYS, SQL_CONJ, query, r6

ONE = recall.ONE
CONFIG = StoreConfig()
#: Conversations of a store; the stores and vectors that follow from the tables, as SQL.
CONVERSATIONS = 50
STORES = f"(SELECT greatest(2, count(DISTINCT conv_id) // {CONVERSATIONS}) FROM conversations)"
VECTORS = "(SELECT count(*) FROM embeddings)"


# ---- the inputs
def stores(spark, sf) -> int:
    return max(2, table(spark, sf, "conversations").select("conv_id").distinct().count() // CONVERSATIONS)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("vec"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _episodes(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("session")
    age = F.count("*").over(w) - F.row_number().over(w.orderBy("idx")) + 1
    rows = episodes(spark, sf).withColumn("strength", F.pow(F.lit(CONFIG.decay_rate), age)).withColumn("vec", (F.col("session") * 31 + F.col("idx")) % table(spark, sf, "embeddings").count())
    return rows.join(_vectors(spark, sf), "vec").select((F.col("session") % stores(spark, sf)).alias("store_id"), *KEYS, "text", "v", "strength")


def _questions(spark, sf) -> DataFrame:
    n, of = F.col("item_id"), stores(spark, sf)
    cue = F.when(n % 5 == 0, "What happened right after that? ").when(n % 5 == 1, "just before: ").when(n % 5 == 2, "What do they USUALLY say? ").otherwise("")
    session = F.when(n % 3 != 0, n % of + of * (n % 7))
    rows = table(spark, sf, "benchmark").select((n % of).alias("store_id"), n.alias("qid"), F.concat(cue, "text").alias("text"), session.alias("session"), (n % 3).alias("position"), (n * 17 % table(spark, sf, "embeddings").count()).alias("vec"))
    return rows.join(_vectors(spark, sf), "vec").drop("vec")


def _schemas(spark, sf) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("schema"), "embedding")
    means = v.select("schema", F.posexplode("embedding").alias("i", "x")).groupBy("schema", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroid = V.l2(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])).alias("centroid")
    mass = v.groupBy("schema").agg(F.count("*").cast("double").alias("mass"))
    said = episodes(spark, sf).where("idx = 0 AND session % 5 <> 4").select(F.col("session").alias("schema"), F.array("text").alias("exemplars"))
    rows = means.groupBy("schema").agg(centroid).join(mass, "schema").join(said, "schema", "left")
    return rows.select((F.col("schema") % stores(spark, sf)).alias("store_id"), "schema", "centroid", "mass", F.coalesce("exemplars", F.array().cast("array<string>")).alias("exemplars"))


PHASES = " + ".join(f"cos(({V.SESSION_SCALE} * (re.session - rq.session) + re.idx - rq.position) * {f!r})" for f in V.FREQUENCIES)
BASE = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
re AS (SELECT conv_id % {STORES} AS store_id, conv_id AS session, turn AS idx, text, (conv_id * 31 + turn) % {VECTORS} AS vec, pow(0.9995, count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1) AS strength FROM conversations),
rq AS (SELECT item_id % {STORES} AS store_id, item_id AS qid, CASE item_id % 5 WHEN 0 THEN 'What happened right after that? ' WHEN 1 THEN 'just before: ' WHEN 2 THEN 'What do they USUALLY say? ' ELSE '' END || text AS text,
  CASE WHEN item_id % 3 <> 0 THEN item_id % {STORES} + {STORES} * (item_id % 7) END AS session, item_id % 3 AS position, item_id * 17 % {VECTORS} AS vec FROM benchmark),
{C._units("p", "store_id, session, idx", "re")}, {C._units("q", "store_id, qid", "rq")},
w AS (SELECT store_id, u, ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM (SELECT store_id, u, count(*) AS df FROM p GROUP BY store_id, u) JOIN (SELECT store_id, count(*) AS n FROM re GROUP BY store_id) USING (store_id)),
norms AS (SELECT session, idx, sqrt(sum(w * w)) AS norm FROM p JOIN w USING (store_id, u) GROUP BY session, idx),
qn AS (SELECT qid, sqrt(sum(w * w)) AS q_norm FROM q JOIN w USING (store_id, u) GROUP BY qid),
met AS (SELECT qid, session, idx, sum(w * w) AS s FROM (SELECT store_id, session, idx, u FROM p) JOIN (SELECT store_id, qid, u FROM q) USING (store_id, u) JOIN w USING (store_id, u) GROUP BY qid, session, idx),
c AS (SELECT rq.store_id, rq.qid, re.session, re.idx, re.text, re.strength, list_dot_product(a.e, b.e) AS semantic, coalesce(s / (norm * q_norm), 0) AS conjunctive, CASE WHEN rq.session IS NOT NULL THEN ({PHASES}) / 16 END AS temporal
  FROM rq JOIN re USING (store_id) JOIN v a ON a.vec_id = re.vec JOIN v b ON b.vec_id = rq.vec LEFT JOIN met ON met.qid = rq.qid AND met.session = re.session AND met.idx = re.idx LEFT JOIN norms ON norms.session = re.session AND norms.idx = re.idx LEFT JOIN qn ON qn.qid = rq.qid)"""
_range = lambda p: f"coalesce(CASE WHEN max({p}) OVER w - min({p}) OVER w >= 1e-6 THEN ({p} - min({p}) OVER w) / (max({p}) OVER w - min({p}) OVER w) END, 0)"
_standard = lambda p: f"coalesce(CASE WHEN stddev_pop({p}) OVER w >= 1e-9 THEN ({p} - avg({p}) OVER w) / stddev_pop({p}) OVER w END, 0)"
_rank = lambda p: f"coalesce(CASE WHEN {p} IS NULL OR max({p}) OVER w - min({p}) OVER w < 1e-6 THEN 0 ELSE 1 / (60.0 + row_number() OVER (PARTITION BY store_id, qid ORDER BY round({p}, 9) DESC, session, idx)) END, 0)"


def _fused(part) -> str:
    move = " - min(total) OVER w" if part is _standard else ""
    return f"""f AS (SELECT *, {part("semantic")} + 0.9 * {part("conjunctive")} + 0.25 * {part("temporal")} AS total FROM c WINDOW w AS (PARTITION BY store_id, qid)),
g AS (SELECT store_id, qid, session, idx, text, (total{move}) * (0.85 + 0.15 * strength) AS score FROM f WINDOW w AS (PARTITION BY store_id, qid))"""


REINSTATED = f"""anchor AS (SELECT store_id, qid, session AS a_session, idx AS a_idx, score AS a_score, CASE WHEN regexp_matches(rq.text, '{C._re2(T.CUE_AFTER)}') THEN 1 WHEN regexp_matches(rq.text, '{C._re2(T.CUE_BEFORE)}') THEN -1 ELSE 0 END AS d
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id, qid ORDER BY round(score, 6) DESC, session, idx) AS k FROM g) JOIN (SELECT store_id, qid, text FROM rq) rq USING (store_id, qid) WHERE k = 1),
o AS (SELECT *, CASE WHEN session = a_session AND d <> 0 THEN (idx - a_idx) * d END AS offset_ FROM g JOIN anchor USING (store_id, qid)),
h AS (SELECT store_id, qid, session, idx, text, CASE WHEN offset_ = 0 THEN 0.15 * score WHEN offset_ BETWEEN 1 AND 3 THEN score + 2.0 * a_score / offset_ ELSE score END AS score,
  CASE WHEN offset_ BETWEEN 1 AND 3 THEN offset_ END AS reinstated, coalesce(offset_ = 0, false) AS anchor, CASE WHEN a_score = 0 THEN 1 ELSE a_score END AS top FROM o)"""
SCHEMAS = f"""x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY label, i),
sc AS (SELECT label % {STORES} AS store_id, label AS schema, list(m / norm ORDER BY i) AS centroid, any_value(mass) AS mass FROM m JOIN (SELECT label, greatest(sqrt(sum(m * m)), 1e-12) AS norm FROM m GROUP BY label) USING (label) JOIN (SELECT label, count(*) AS mass FROM embeddings GROUP BY label) USING (label) GROUP BY label),
sim AS (SELECT store_id, qid, schema, mass, list_dot_product(centroid, e) AS similarity FROM sc JOIN (SELECT store_id, qid, vec FROM rq) USING (store_id) JOIN v ON vec_id = vec),
sr AS (SELECT *, similarity * (0.4 + 0.6 * ln(1 + mass) / (SELECT max(ln(1 + mass)) FROM sc WHERE sc.store_id = sim.store_id)) AS score FROM sim)"""


def _hits(k: int) -> str:
    return f"""hit AS (SELECT store_id, qid, schema, similarity, mass, score, t.text FROM (SELECT *, row_number() OVER (PARTITION BY store_id, qid ORDER BY round(score, 6) DESC, schema DESC) AS nth FROM sr) JOIN conversations t ON t.conv_id = schema AND t.turn = 0 WHERE nth <= {k} AND schema % 5 <> 4)"""


def _recall(part, k: int | None = 5, dedup: bool = True, schemas: bool = True) -> str:
    union, cut = "", f" WHERE rank <= {k}" if k else ""
    if schemas:
        weight = f"CASE WHEN regexp_matches(rq.text, '{C._re2(T.CUE_GENERIC)}') THEN 0.6 * 2.4 ELSE 0.6 END"
        union = f""" UNION ALL SELECT store_id, qid, 'schema', 1, NULL, NULL, schema, {weight} * top * CASE WHEN max(hit.score) OVER w - min(hit.score) OVER w > 1e-6 THEN (hit.score - min(hit.score) OVER w) / (max(hit.score) OVER w - min(hit.score) OVER w) ELSE 1 END, NULL, false, hit.text
  FROM hit JOIN (SELECT store_id, qid, text FROM rq) rq USING (store_id, qid) JOIN (SELECT store_id, qid, max(top) AS top FROM h GROUP BY store_id, qid) USING (store_id, qid) WINDOW w AS (PARTITION BY store_id, qid)"""
    once = "WHERE k = 1" if dedup else ""
    order = "round(score, 6) DESC, late, session, idx, schema"
    return f"""{BASE}, {_fused(part)}, {REINSTATED}, {SCHEMAS}, {_hits(max(4, k or 4))},
un AS (SELECT store_id, qid, 'episode' AS source, 0 AS late, session, idx, NULL::BIGINT AS schema, score, reinstated, anchor, text FROM h{union}),
dd AS (SELECT *, row_number() OVER (PARTITION BY store_id, qid, text ORDER BY {order}) AS k FROM un),
rk AS (SELECT *, row_number() OVER (PARTITION BY store_id, qid ORDER BY {order}) AS rank FROM dd {once})
SELECT store_id, qid, rank, source, session, idx, CAST(schema AS BIGINT) AS schema, round(score, 6) AS score, CAST(reinstated AS BIGINT) AS reinstated, anchor FROM rk{cut}"""


def _recalled(spark, sf, config: StoreConfig = CONFIG, **how) -> DataFrame:
    rows = recall.recall(_episodes(spark, sf), _questions(spark, sf), _schemas(spark, sf), config, **how)
    return rows.withColumn("score", r6("score"))


# ---- the stages of the read
@query(f"{BASE} SELECT store_id, qid, session, idx, round(semantic, 6) AS semantic, round(conjunctive, 6) AS conjunctive, round(temporal, 6) AS temporal FROM c")
def recall_candidates(spark, sf):
    rows = recall.candidates(_episodes(spark, sf), _questions(spark, sf), CONFIG)
    return rows.select(*ONE, *KEYS, *[r6(c, c) for c in ("semantic", "conjunctive", "temporal")])


@query(f"{BASE}, {_fused(_range)} SELECT store_id, qid, session, idx, round(score, 6) AS score FROM g")
def recall_fused(spark, sf):
    e = _episodes(spark, sf)
    return recall.scored(recall.candidates(e, _questions(spark, sf), CONFIG), CONFIG).select(*ONE, *KEYS, r6("score", "score"))


@query(f"{BASE}, {_fused(_range)}, {REINSTATED} SELECT store_id, qid, session, idx, round(score, 6) AS score, CAST(reinstated AS BIGINT) AS reinstated, anchor FROM h")
def recall_reinstated(spark, sf):
    e, q = _episodes(spark, sf), _questions(spark, sf)
    rows = recall.reinstated(recall.scored(recall.candidates(e, q, CONFIG), CONFIG), q, CONFIG)
    return rows.select(*ONE, *KEYS, r6("score", "score"), "reinstated", "anchor")


@query(f"{BASE}, {SCHEMAS}, {_hits(4)} SELECT store_id, qid, schema, round(similarity, 6) AS similarity, CAST(mass AS DOUBLE) AS mass, round(score, 6) AS score, text FROM hit")
def recall_schemas(spark, sf):
    return recall.schema_hits(_schemas(spark, sf), _questions(spark, sf), None).select(*ONE, "schema", r6("similarity", "similarity"), "mass", r6("score", "score"), "text")


@query(_recall(_range))
def recall_full(spark, sf):
    return _recalled(spark, sf)


@query(_recall(_standard, k=10, dedup=False, schemas=False))
def recall_zscore_plain(spark, sf):
    return _recalled(spark, sf, CONFIG.reconfigured(fusion="zscore"), k=10, include_schemas=False, dedup=False)


@query(_recall(_rank))
def recall_rrf(spark, sf):
    return _recalled(spark, sf, CONFIG.reconfigured(fusion="rrf"))


@query(_recall(_range, k=None))
def recall_whole_ranking(spark, sf):
    return _recalled(spark, sf, k=None)


@query(f"SELECT store_id, session, idx, count(*) AS times, round(CAST(0.05 AS DOUBLE) * count(*), 6) AS gain FROM ({_recall(_range)}) WHERE source = 'episode' GROUP BY store_id, session, idx")
def recall_rehearsals(spark, sf):
    return recall.rehearsals(_recalled(spark, sf)).withColumn("gain", r6("gain"))


# ---- evaluation
@query(
    f"""{_recall(_range)[: _recall(_range).rindex("SELECT store_id, qid, rank")]}, ask AS (SELECT item_id % {STORES} AS store_id, item_id AS qid, item_id % {STORES} + {STORES} * (item_id % 7) AS a_session, item_id % 3 AS a_idx, regexp_extract(lower(text), '[a-z][a-z0-9]+') AS needle FROM benchmark),
said AS (SELECT rk.*, coalesce(s.text, rk.text) AS shown FROM rk LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) s ON s.conv_id = rk.schema WHERE rank <= 5),
mm AS (SELECT ask.qid, min(CASE WHEN session = a_session AND idx = a_idx THEN rank END) AS k, min(CASE WHEN needle <> '' AND regexp_matches(shown, '(?i)(^|[^\\pL\\pN_])' || needle || '($|[^\\pL\\pN_])') THEN rank END) AS a FROM ask LEFT JOIN said USING (store_id, qid) GROUP BY ask.qid)
SELECT qid, CAST(coalesce(k = 1, false) AS DOUBLE) AS key_at_1, round(coalesce(1.0 / k, 0), 6) AS key_rr, CAST(coalesce(a = 1, false) AS DOUBLE) AS answer_at_1, round(coalesce(1.0 / a, 0), 6) AS answer_rr FROM mm"""
)
def recall_query_scores(spark, sf):
    n, of = F.col("item_id"), stores(spark, sf)
    needle = F.regexp_extract(F.lower("text"), "[a-z][a-z0-9]+", 0)
    ask = table(spark, sf, "benchmark").select((n % of).alias("store_id"), n.alias("qid"), (n % of + of * (n % 7)).alias("answer_session"), (n % 3).alias("answer_idx"), needle.alias("answer"))
    e = _episodes(spark, sf).select("store_id", *KEYS, "text")
    exemplar = _schemas(spark, sf).select("store_id", "schema", F.get("exemplars", F.lit(0)).alias("gist"))
    shown = _recalled(spark, sf).join(e, ["store_id", *KEYS], "left").join(exemplar, ["store_id", "schema"], "left")
    got = evaluation.query_scores(shown.withColumn("text", F.coalesce("text", "gist")), ask, ONE, KEYS)
    return got.select("qid", "key_at_1", r6("key_rr", "key_rr"), "answer_at_1", r6("answer_rr", "answer_rr"))


GOLD = "gs AS (SELECT DISTINCT qid, session FROM (SELECT item_id AS qid, unnest([item_id % 23, item_id * 7 % 100]) AS session FROM benchmark) WHERE session IN (SELECT conv_id FROM conversations))"
RANKED = f"{SQL_CONJ}, r AS (SELECT qid, session, idx, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, session, idx) AS rank FROM scored)"
EVERY = "every AS (SELECT qid, session, idx, rank FROM r UNION ALL SELECT qid, session, idx, (SELECT coalesce(max(rank), 0) FROM r WHERE r.qid = z.qid) + row_number() OVER (PARTITION BY qid ORDER BY session, idx) FROM (SELECT qid, session, idx FROM (SELECT qid FROM a) CROSS JOIN (SELECT session, idx FROM e) EXCEPT SELECT qid, session, idx FROM r) z)"


@query(f"{RANKED}, {EVERY} SELECT qid, session, idx, rank FROM every")
def completed_ranking(spark, sf):
    ranked = index.top(C._conj_scores(spark, sf), None, KEYS)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    # all turns for each of a stated set of questions
    every = episodes(spark, sf).select(*KEYS).crossJoin(asked)
    return index.completed(ranked, every, KEYS)


def _session_sql(k: int) -> str:
    return f"""{RANKED}, {GOLD}, fs AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM (SELECT qid, session, min(rank) AS rank FROM r GROUP BY qid, session)),
cut AS (SELECT qid, coalesce((SELECT rank FROM fs WHERE fs.qid = x.qid AND nth = {k}), max(x.rank)) AS cut FROM r x GROUP BY qid),
ng AS (SELECT qid, count(DISTINCT session) AS sessions, count(*) AS turns FROM gs JOIN e USING (session) GROUP BY qid),
ht AS (SELECT qid, count(DISTINCT session) AS found, sum(CASE WHEN rank = 1 THEN 1 ELSE 1 / log2(rank) END) AS dcg FROM r JOIN gs USING (qid, session) JOIN cut USING (qid) WHERE rank <= cut GROUP BY qid)
SELECT ng.qid, CAST(coalesce(found, 0) = sessions AS DOUBLE) AS recall_all, round(coalesce(dcg, 0) / (SELECT sum(CASE WHEN i = 1 THEN 1 ELSE 1 / log2(i) END) FROM range(1, least(turns, coalesce(cut, {k})) + 1) t(i)), 6) AS ndcg FROM ng LEFT JOIN ht USING (qid) LEFT JOIN cut USING (qid)"""


@query(_session_sql(5))
def session_metrics(spark, sf):
    e = episodes(spark, sf)
    n = F.col("item_id")
    gold = table(spark, sf, "benchmark").select(n.alias("qid"), F.explode(F.array(n % 23, n * 7 % 100)).alias("session")).distinct().join(e.select("session").distinct(), "session", "left_semi")
    got = evaluation.session_level(index.top(C._conj_scores(spark, sf), None, KEYS), gold, e.select("session"), 5)
    return got.select("qid", "recall_all", r6("ndcg", "ndcg"))


DAYS, SERVICES, FAULTS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday"), ("auth", "billing", "search", "storage", "gateway"), ("latency", "timeouts", "crashes", "corruption", "overload")
CUBE = f"cube AS (SELECT row_number() OVER (ORDER BY di, si, fi) - 1 AS id, d, s, f FROM (SELECT unnest({list(DAYS)}) AS d, generate_subscripts({list(DAYS)}, 1) AS di) CROSS JOIN (SELECT unnest({list(SERVICES)}) AS s, generate_subscripts({list(SERVICES)}, 1) AS si) CROSS JOIN (SELECT unnest({list(FAULTS)}) AS f, generate_subscripts({list(FAULTS)}, 1) AS fi))"
ASKED = "a AS (SELECT id AS qid, 'What went wrong with the ' || s || ' service on ' || d || '?' AS text FROM cube)"


@query(
    SQL_CONJ.replace(EPISODES, f"{CUBE}, e AS (SELECT id AS session, 0 AS idx, 'On ' || d || ' the ' || s || ' service reported ' || f || '.' AS text FROM cube)").replace(C.ASKED, ASKED)
    + """, r AS (SELECT qid, session, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, session) AS rank FROM scored)
SELECT q.id AS qid, CAST(t.session = q.id AS DOUBLE) AS key_at_1, round(1.0 / r.rank, 6) AS key_rr, CAST(c.d = q.d AND c.s = q.s AS DOUBLE) AS class_at_1 FROM cube q JOIN r t ON t.qid = q.id AND t.rank = 1 JOIN cube c ON c.id = t.session JOIN r ON r.qid = q.id AND r.session = q.id"""
)
def incident_scores(spark, sf):
    rows = incidents(spark, list(DAYS), list(SERVICES), list(FAULTS))
    asked = rows.select(F.col("id").alias("qid"), F.format_string("What went wrong with the %s service on %s?", "service", "day").alias("text"))
    own = rows.select(F.col("id").alias("session"), F.lit(0).cast("long").alias("idx"), "text")
    ranked = index.top(index.cosine(units.unit_rows(own, KEYS), units.unit_rows(asked, ["qid"]), own.withColumn("length", F.size(T.content_terms(F.col("text")))), KEYS), None, KEYS)
    got = evaluation.class_scores(ranked.select("qid", F.col("session").alias("id"), "rank"), rows.select("id", "day", "service"))
    return got.select("qid", "key_at_1", r6("key_rr", "key_rr"), "class_at_1")


# ---- stores: novelty, energy, statistics, upkeep
STORED = "WITH s AS (SELECT vec_id % 8 AS store_id, vec_id AS seq, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _stored(spark, sf):
    return table(spark, sf, "embeddings").select((F.col("vec_id") % 8).alias("store_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("v"))


@query(f"{STORED} SELECT a.store_id, a.seq, round(CASE WHEN count(b.seq) = 0 THEN 1 ELSE least(1, greatest(0, 1 - max(list_dot_product(a.e, b.e)))) END, 6) AS novelty FROM s a LEFT JOIN s b ON a.store_id = b.store_id AND b.seq < a.seq GROUP BY a.store_id, a.seq")
def novelty_dense(spark, sf):
    return dense.novelty(_stored(spark, sf), 256).select("store_id", "seq", r6("novelty", "novelty"))


@query(C.DENSE + "SELECT qid, round(-ln(sum(exp(22 * (score - top)))) / 22 - 0.5 * max(self), 6) AS energy FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top, max(CASE WHEN id = qid THEN score END) OVER (PARTITION BY qid) AS self FROM scored) GROUP BY qid")
def hopfield_energy(spark, sf):
    v, q = C._asked(spark, sf)
    known = dense.spreads(v, q, ["id"], CONFIG.beta)
    self = q.select("qid", V.dot(F.col("v"), F.col("v")).alias("self"))
    return known.join(self, "qid").select("qid", r6(-F.log("whole") / CONFIG.beta - 0.5 * F.col("self"), "energy"))


@query(C.CODES + ", n AS (SELECT u, count(*) AS n FROM (SELECT unnest(code) AS u FROM c) GROUP BY u) SELECT count(*) AS used, round(count(*) / 64.0, 6) AS coverage FROM n")
def code_coverage(spark, sf):
    return coding.code_stats(C._codes(spark, sf), 64).select("used", r6("coverage", "coverage"))


@query("WITH s AS (SELECT label % 2 AS store_id, label, count(DISTINCT vec_id % 40) AS n FROM embeddings GROUP BY label) SELECT store_id, CAST(count(*) AS DOUBLE) AS schemas, round(avg(n), 6) AS mean_support, CAST(max(n) AS DOUBLE) AS max_support, round(sum(n) / count(*), 6) AS compression FROM s GROUP BY store_id")
def schema_statistics(spark, sf):
    v = table(spark, sf, "embeddings").select((F.col("label") % 2).alias("store_id"), "label", (F.col("vec_id") % 40).alias("key"))
    got = consolidation.schema_stats(v.groupBy("store_id", "label").agg(F.collect_list("key").alias("support")))
    return got.select("store_id", "schemas", r6("mean_support", "mean_support"), "max_support", r6("compression", "compression"))


@query("SELECT user_id % 8 AS store_id, count(*) AS written, count(*) FILTER (event_id % 3 <> 0) AS resident, round(count(*) FILTER (event_id % 3 <> 0) / count(*), 6) AS retention FROM events GROUP BY user_id % 8")
def store_statistics(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 8).alias("store_id"), (F.col("event_id") % 3 != 0).alias("resident"))
    return consolidation.store_stats(e, e).withColumn("retention", r6("retention"))


GONE = "idx % 5 <> 0"


@query(f"WITH {EPISODES}, {C._units('p', 'session, idx', 'e')} SELECT u, count(*) AS df FROM p WHERE {GONE} GROUP BY u")
def index_reconciled(spark, sf):
    e = episodes(spark, sf)
    postings = units.unit_rows(e, KEYS)
    return index.document_frequency(index.reconciled(postings, e.where(GONE), KEYS))


@query("SELECT DISTINCT md5(text) AS key FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def cache_misses(spark, sf):
    keyed = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.content_key(F.col("text")).alias("key"))
    return index.misses(keyed, keyed.where("doc_id % 3 = 0"), ["key"])
