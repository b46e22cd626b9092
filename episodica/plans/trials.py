"""Registered queries of tuning, ablations and paraphrases, with SQL that says the same.

Candidates, questions and stores are those of ``reads``; a question has two gold turns of its store.  Paraphrased questions are made from
orders (who, which week, which day) and items of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import StoreConfig
from ..functions import paraphrase as P
from ..functions import text as T
from ..operators import fuse, recall, tuning
from ..sources.tables import table
from . import reads as R
from .catalog import KEYS, query, r6

PARTS = ["semantic", "conjunctive", "temporal", "unigrams", "presence"]
STRENGTH = "strength"
#: The grid's axes, and what each ablation changes of the full read (columns ending in _r are reciprocal ranks).
GRID = tuning.grid(semantic_n=(0.0, 1.0), conjunctive_n=(0.0, 0.6, 0.9, 1.2, 2.4), temporal_n=(0.0, 0.25, 0.5))
GRID = {name: w for name, w in GRID.items() if any(w.values())}
FULL = {"semantic_n": 1.0, "conjunctive_n": 0.9, "temporal_n": 0.25}
ABLATIONS = {
    "full": FULL,
    "-semantic": FULL | {"semantic_n": 0.0},
    "-conjunctive": FULL | {"conjunctive_n": 0.0},
    "-temporal-ctx": FULL | {"temporal_n": 0.0},
    "conj: unigrams": {"semantic_n": 1.0, "unigrams_n": 0.9, "temporal_n": 0.25},
    "conj: binary": {"semantic_n": 1.0, "presence_n": 0.9, "temporal_n": 0.25},
    "fusion: rrf": {"semantic_r": 1.0, "conjunctive_r": 0.9, "temporal_r": 0.25},
}


def _gold(spark, sf) -> DataFrame:
    n, of = F.col("item_id"), R.stores(spark, sf)
    rows = table(spark, sf, "benchmark").select((n % of).alias("store_id"), n.alias("qid"), (n % of + of * (n % 7)).alias("session"), F.explode(F.array(n % 3, (n + 1) % 3)).alias("idx"))
    return rows.distinct()


def _judged(spark, sf, configs: dict[str, dict[str, float]]) -> DataFrame:
    """The candidates once, with every column that a configuration weighs, and all configurations judged on them."""
    used = {c for w in configs.values() for c in w}
    e, q = R._episodes(spark, sf), R._questions(spark, sf)
    rows = recall.candidates(e, q, R.CONFIG)
    for name, config in {"unigrams": StoreConfig(conj_order=1), "presence": R.CONFIG.reconfigured(conj_weighting="binary")}.items():
        if f"{name}_n" in used:
            rows = rows.join(recall._units(e, q, config).withColumnRenamed("score", name), [*R.ONE, *KEYS], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    parts = [p for p in PARTS if p in rows.columns]
    rows = fuse.normalised(rows, parts, "minmax", KEYS, by=R.ONE)
    ranked = [p for p in parts if f"{p}_r" in used]
    if ranked:
        rows = rows.withColumns({f"{p}_r": F.coalesce(F.when(F.col(p).isNotNull(), fuse.reciprocal(p, KEYS, R.ONE)), F.lit(0.0)) for p in ranked})
    factor = recall.KEPT + (1 - recall.KEPT) * F.col(STRENGTH)
    return tuning.judged(tuning.ranks(rows, _gold(spark, sf), configs, R.ONE, KEYS, factor), R.ONE, 5, 10)


# ---- SQL
def _conj(name: str, units: str, weight: str) -> str:
    """met, norms and qn once more, for other units or weights."""
    return f"""{name}_w AS (SELECT store_id, u, {weight} AS w FROM w WHERE {units}),
{name}_norms AS (SELECT session, idx, sqrt(sum(w * w)) AS norm FROM p JOIN {name}_w USING (store_id, u) GROUP BY session, idx), {name}_qn AS (SELECT qid, sqrt(sum(w * w)) AS q_norm FROM q JOIN {name}_w USING (store_id, u) GROUP BY qid),
{name}_met AS (SELECT qid, session, idx, sum(w * w) AS s FROM (SELECT store_id, session, idx, u FROM p) JOIN (SELECT store_id, qid, u FROM q) USING (store_id, u) JOIN {name}_w USING (store_id, u) GROUP BY qid, session, idx),
{name} AS (SELECT qid, session, idx, s / (norm * q_norm) AS {name} FROM {name}_met JOIN {name}_norms USING (session, idx) JOIN {name}_qn USING (qid))"""


def _judged_sql(configs: dict[str, dict[str, float]]) -> str:
    used = sorted({c for w in configs.values() for c in w})
    more = {"unigrams": _conj("unigrams", "NOT contains(u, '|')", "w"), "presence": _conj("presence", "true", "1.0::DOUBLE")}
    more = {k: v for k, v in more.items() if f"{k}_n" in used}
    joins = "".join(f" LEFT JOIN {k} USING (qid, session, idx)" for k in more)
    columns = "".join(f", coalesce({k}, 0) AS {k}" for k in more)
    parts = ", ".join(f"{(R._range if c.endswith('_n') else R._rank)(c[:-2])} AS {c}" for c in used)
    rows = ", ".join("('" + name + "', " + ", ".join(str(float(w.get(c, 0))) for c in used) + ")" for name, w in configs.items())
    total = " + ".join(f"k.{c} * n.{c}" for c in used)
    return f"""{R.BASE}{"".join(", " + v for v in more.values())}, x AS (SELECT c.*{columns} FROM c{joins}), n AS (SELECT store_id, qid, session, idx, strength, {parts} FROM x WINDOW w AS (PARTITION BY store_id, qid)),
k(config, {", ".join(used)}) AS (VALUES {rows}),
rr AS (SELECT config, store_id, qid, session, idx, row_number() OVER (PARTITION BY config, store_id, qid ORDER BY round(({total}) * (0.85 + 0.15 * strength), 6) DESC, session, idx) AS rank FROM n, k),
gold AS (SELECT DISTINCT item_id % {R.STORES} AS store_id, item_id AS qid, item_id % {R.STORES} + {R.STORES} * (item_id % 7) AS session, unnest([item_id % 3, (item_id + 1) % 3]) AS idx FROM benchmark),
jj AS (SELECT config, qid, count(*) AS golds, count(*) FILTER (rank <= 5) AS found, sum(CASE WHEN rank > 10 THEN 0 WHEN rank = 1 THEN 1 ELSE 1 / log2(rank) END) AS dcg FROM rr JOIN gold USING (store_id, qid, session, idx) GROUP BY config, qid),
j AS (SELECT config, qid, CAST(found = golds AS DOUBLE) AS recall_all, dcg / (SELECT sum(CASE WHEN i = 1 THEN 1 ELSE 1 / log2(i) END) FROM range(1, least(golds, 10) + 1) t(i)) AS ndcg FROM jj),
o AS (SELECT *, (recall_all + ndcg) / 2 AS objective FROM j)"""


SPLIT = "(list_sum(list_transform(string_split(sha1(CAST(qid AS VARCHAR)), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 = 0)"


@query(
    f"""{_judged_sql(GRID)}, s AS (SELECT *, {SPLIT} AS dev FROM o),
t AS (SELECT config, avg(objective) FILTER (dev) AS d, avg(objective) FILTER (NOT dev) AS t, count(*) FILTER (dev) AS n_dev, count(*) FILTER (NOT dev) AS n_test FROM s GROUP BY config)
SELECT config, round(d, 6) AS dev, round(t, 6) AS test, n_dev, n_test, row_number() OVER (ORDER BY round(coalesce(d, -1), 6) DESC, config) = 1 AS chosen FROM t"""
)
def tune_grid(spark, sf):
    """All weights of the grid, tuned on dev questions and read on test questions."""
    got = tuning.report(_judged(spark, sf, GRID), T.split_of(F.col("qid")))
    return got.select("config", r6("dev", "dev"), r6("test", "test"), "n_dev", "n_test", "chosen")


@query(
    f"""{_judged_sql(ABLATIONS)} SELECT config, round(avg(o.recall_all), 6) AS recall_all, round(avg(o.ndcg), 6) AS ndcg, round(avg(o.objective), 6) AS objective, round(avg(b.objective - o.objective), 6) AS less,
  count(*) FILTER (b.objective - o.objective > 1e-9) AS worse, count(*) FILTER (b.objective - o.objective < -1e-9) AS better FROM o JOIN (SELECT qid, objective FROM o WHERE config = 'full') b USING (qid) GROUP BY config"""
)
def ablation_table(spark, sf):
    got = tuning.ablations(_judged(spark, sf, ABLATIONS), "full", R.ONE)
    return got.select("config", *[r6(c, c) for c in ("recall_all", "ndcg", "objective", "less")], "worse", "better")


# ---- paraphrases
ACTS, THINGS = [*P.ACTIONS, "shipped"], [*P.ARTIFACTS, "mural"]
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_pick = lambda words, place: f"{_list(words)}[CAST('0x' || substr(md5(key || ':{place}'), 1, 8) AS BIGINT) % {len(words)} + 1]"
_other = lambda word, known: f"coalesce(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in known.items())}}}[{word}], {word})"
_nth = f"CASE WHEN week < 20 THEN {_list(P.ORDINALS)}[week + 1] WHEN week % 10 = 0 THEN {_list(P.TENTHS)}[week // 10 + 1] ELSE {_list(P.TENS)}[week // 10 + 1] || '-' || {_list(P.ORDINALS)}[week % 10 + 1] END"


@query(
    f"""WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey % 5 AS kind, 'C' || o_custkey AS who, weekofyear(o_orderdate) AS week, dayname(o_orderdate) AS day,
  {_list(ACTS)}[o_orderkey // 5 % {len(ACTS)} + 1] AS act, {_list(THINGS)}[o_orderkey // 7 % {len(THINGS)} + 1] AS thing FROM orders),
m AS (SELECT key, CASE kind
  WHEN 0 THEN 'What ' || {_pick(P.PROJECT, 0)} || ' was ' || who || ' ' || CASE WHEN {_pick("ab", 1)} = 'a' THEN {_pick(P.WORKED, 2)} ELSE 'occupied with' END || ' on the ' || day || ' of their ' || {_nth} || ' week?'
  WHEN 1 THEN 'On the ' || day || ' of their ' || {_nth} || ' week, what did ' || who || ' ' || {_other("act", P.ACTIONS)} || '?'
  WHEN 2 THEN 'What does ' || who || ' spend most of their time on, generally speaking?'
  WHEN 3 THEN {_pick(P.AFTER, 3)} || ' ' || who || ' ' || {_other("act", P.ACTIONS)} || ' that atlas ' || {_other("thing", P.ARTIFACTS)} || ' in their ' || {_nth} || ' week, what came next for them?'
  ELSE 'Who is ' || who || '?' END AS text FROM b)
SELECT 'order' AS source, CAST(key AS BIGINT) AS id, text FROM m UNION ALL SELECT 'item', item_id, text FROM benchmark"""
)
def paraphrased_questions(spark, sf):
    """Questions of four kinds made from orders in other words; a fifth kind and the benchmark's items, which no rule matches, stay as they are."""
    key = F.col("o_orderkey")
    kind = key % 5
    who, week, day = F.concat(F.lit("C"), F.col("o_custkey")), F.weekofyear("o_orderdate").cast("string"), F.date_format("o_orderdate", "EEEE")
    act, thing = (P._of(x, F.floor(key / n) % len(x)) for x, n in ((ACTS, 5), (THINGS, 7)))
    text = (
        F.when(kind == 0, F.concat(F.lit("Which project did "), who, F.lit(" work on in week "), week, F.lit(" on "), day, F.lit("?")))
        .when(kind == 1, F.concat(F.lit("In week "), week, F.lit(" on "), day, F.lit(", which project did "), who, F.lit(" "), act, F.lit("?")))
        .when(kind == 2, F.concat(F.lit("Which project does "), who, F.lit(" usually work on?")))
        .when(kind == 3, F.concat(F.lit("What did "), who, F.lit(" work on right after they "), act, F.lit(" the atlas "), thing, F.lit(" in week "), week, F.lit("?")))
        .otherwise(F.concat(F.lit("Who is "), who, F.lit("?")))
    )
    task = P._of(("episodic", "interference", "abstraction", "temporal", "other"), kind)
    orders = table(spark, sf, "orders").select(F.lit("order").alias("source"), key.alias("id"), text.alias("text"), task.alias("task"))
    items = table(spark, sf, "benchmark").select(F.lit("item").alias("source"), F.col("item_id").alias("id"), "text", F.lit("episodic").alias("task"))
    return orders.unionByName(items).select("source", "id", P.paraphrased(F.col("text"), F.col("task"), F.col("id")).alias("text"))
