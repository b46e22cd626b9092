"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, extraction, licenses, middle, near_dup, packing, perspectives, pii, quality, secrets, sharding, simhash
from .common import table

#: The surrogates' key in the registered query; a user passes one of their own.
KEY = "registered query"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.segments(table(spark, sf_dir, "conversations"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_sharding_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with shards so small that every table splits, some shards on more bits than others."""
    return sharding.shard(table(spark, sf_dir, "documents"), 64 << 10)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), KEY).drop("n_chars")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_secret_scan, op2_chat_perspectives, op3_html_extraction, op4_near_dup, op5_sharding, op5_sharding_64k, op6_quality_rules, op7_best_fit_packing,
    op8_decontamination, op9_license_scan, op10_pii_surrogates, op11_simhash, op12_fill_in_middle, op13_centroids,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


SQL = {
    "op2_chat_perspectives": """
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN coalesce(trim(role), '') = '' THEN 'unknown' ELSE trim(role) END AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT t.*, s.speaker, '<|' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || '|>' || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.c),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM r),
n AS (SELECT *, row_number() OVER w AS nth, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS stop FROM g
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, speaker, nth - 1 AS "position", turn, role, segment, CAST(stop - length(segment) AS BIGINT) AS "start", CAST(stop - length(segment) + length(head) AS BIGINT) AS learn_from, CAST(stop AS BIGINT) AS "end", CAST(role = speaker AS INTEGER) AS mask
FROM n""",
    "op12_fill_in_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, string_split(text, chr(10)) AS l, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN right(text, 1) = chr(10) THEN 1 ELSE 0 END END AS n,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN text ELSE array_to_string(l[1:a], chr(10)) || chr(10) END AS prefix,
  CASE WHEN b = 0 THEN '' WHEN b = n THEN text ELSE array_to_string(l[1:b], chr(10)) || chr(10) END AS head FROM c),
m AS (SELECT *, substr(head, length(prefix) + 1) AS middle, substr(text, length(head) + 1) AS suffix FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM m""",
}
#: Extendible hashing, bucket by bucket.
SHARDS = """
WITH RECURSIVE d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
  md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || chr(31) || md5(coalesce(text, ''))) AS m FROM documents),
b AS (SELECT doc_id, n_bytes, format('{{:060b}}', CAST('0x' || substr(m, 1, 15) AS BIGINT)) AS h FROM d),
split AS (
  SELECT '' AS prefix, 0 AS depth
  UNION ALL
  SELECT p.prefix || bit, p.depth + 1 FROM split p, (VALUES ('0'), ('1')) AS v(bit)
  WHERE p.depth < 60 AND (SELECT sum(n_bytes) FROM b WHERE substr(h, 1, p.depth) = p.prefix) > {limit}
    AND (SELECT count(*) FROM b WHERE substr(h, 1, p.depth) = p.prefix) > 1),
leaf AS (SELECT prefix, depth FROM split s WHERE NOT EXISTS (SELECT 1 FROM split t WHERE t.depth = s.depth + 1 AND substr(t.prefix, 1, s.depth) = s.prefix))
SELECT doc_id, n_bytes, prefix AS shard, depth, CAST(0 AS BIGINT) AS overflow FROM b JOIN leaf ON substr(h, 1, depth) = prefix"""
SQL |= {"op5_sharding": SHARDS.format(limit=sharding.LIMIT), "op5_sharding_64k": SHARDS.format(limit=64 << 10)}


def _lloyd(k: int = 8, rounds: int = 10) -> str:
    """K-means on whole numbers, a table for each round."""
    out = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM e ORDER BY c LIMIT %d)""" % k
    square = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for n in range(rounds + 1):
        out += f""",
a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := CAST({square} AS BIGINT), c := c.c)) AS m FROM e, c{n} AS c GROUP BY r)"""
        if n < rounds:
            out += f""",
s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT a.m.c AS c, unnest(e.v) AS x, unnest(range(64)) AS i FROM a{n} AS a JOIN e USING (r)) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(g.v, c.v) AS v FROM c{n} AS c LEFT JOIN
  (SELECT c, list(CAST((s - ((s %% n) + n) %% n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c) AS g USING (c))""".replace("%%", "%")
    return out + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS "cluster", m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN c{rounds} AS c ON c.c = m.c"""


SQL["op13_centroids"] = _lloyd()


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
