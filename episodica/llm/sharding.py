"""Sharding (5): extendible hashing of rows into shards of a byte limit.

A row's hash is 60 bits of the MD5 of its id and of its text's MD5.  The directory starts as one bucket; a bucket
whose bytes exceed the limit splits on the next bit of the hash, and only it.  So a row's bucket is the shortest prefix of
its hash whose bytes are within the limit.  Bytes are summed for cells of a fixed number of bits, chosen from the total so
that cells are some times as many as shards; all shorter prefixes are sums of cells.  Cells that are still too large are
divided further, step by step.  Rows that share all bits (equal ids and texts) fill a chain of overflow shards.

Only DataFrame operations and SQL functions are used.

Defined results: a null or empty text has no bytes; a null id hashes as the word null; repeated rows are rows of their own and can share
a shard; a single row beyond the limit is a shard of its own; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared

BITS, STEP = 60, 12
LIMIT = 16 << 20


def hash_bits(*values: Column) -> Column:
    """60 bits of an MD5 as a string of 0 and 1."""
    joined = F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("null")) for v in values])
    return F.lpad(F.conv(F.substring(F.md5(joined), 1, BITS // 4), 16, 2), BITS, "0")


def _prefix(bits: str, n: Column | int) -> Column:
    return F.substring(F.col(bits), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """prefix, depth, bytes, members: the buckets of rows (hash, bytes), each within the limit or of depth BITS or of one row."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    done, bits = None, min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 3))
    cells = shared(rows.groupBy(_prefix("hash", bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("members")))
    base = 0
    while True:
        # a row for each prefix of each cell; sums meet before the shuffle
        depth = F.explode(F.sequence(F.lit(base), F.lit(bits))).alias("depth")
        sums = cells.select("cell", "bytes", "members", depth).groupBy("depth", _prefix("cell", F.col("depth")).alias("prefix"))
        sums = shared(sums.agg(F.sum("bytes").alias("bytes"), F.sum("members").alias("members")))
        fits = (F.col("bytes") <= limit) | (F.col("members") == 1)
        if bits == BITS:
            fits |= F.col("depth") == BITS
        parent = sums.where(~fits).select("depth", "prefix")
        # a bucket: it fits, and the prefix that it was split from did not
        own = sums.where(fits)
        up = own.withColumns({"up_depth": F.col("depth") - 1, "up": _prefix("prefix", F.col("depth") - 1)})
        leaves = up.join(parent.select(F.col("depth").alias("up_depth"), F.col("prefix").alias("up")), ["up_depth", "up"], "left_semi").select("prefix", "depth", "bytes", "members")
        if base == 0:
            leaves = leaves.union(own.where("depth = 0").select("prefix", "depth", "bytes", "members"))
        done = leaves if done is None else done.union(leaves)
        large = parent.where(F.col("depth") == bits).select("prefix")
        if bits == BITS or large.isEmpty():
            return shared(done)
        base, bits, before = bits, min(BITS, bits + STEP), bits
        inside = rows.withColumn("prefix", _prefix("hash", before)).join(large, "prefix", "left_semi")
        cells = shared(inside.groupBy(_prefix("hash", bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("members")))


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (the prefix of the hash), depth, overflow (0, and on for rows that share all bits): one row per row of docs."""
    return _placed(docs, limit)


def _placed(docs: DataFrame, limit: int, *carried: Column) -> DataFrame:
    """The rows of shard() with other columns of theirs."""
    text = F.col("text").cast("string")
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = shared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes.alias("bytes"), hash_bits(F.col("doc_id"), F.md5(F.coalesce(text, F.lit("")))).alias("hash"), *carried))
    names = rows.columns[3:]
    buckets = directory(rows, limit)
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most BITS + 1 numbers
    # a row meets the one bucket among its prefixes of the depths in use: an equality join on the prefix
    size = buckets.agg(F.count("*")).first()[0]
    tries = F.explode(F.array(*[_prefix("hash", d) for d in sorted(depths)])).alias("shard") if depths else F.lit("").alias("shard")
    keys = buckets.select(F.col("prefix").alias("shard"), "depth", F.col("bytes").alias("bucket_bytes"), F.col("members").alias("bucket_members"))
    if size * 100 <= 8 << 20:  # a row of the directory takes less than 100 bytes
        keys = F.broadcast(keys)
    got = rows.select("doc_id", "bytes", "hash", *names, tries).join(keys, "shard")
    over = (F.col("depth") == BITS) & (F.col("bucket_bytes") > limit) & (F.col("bucket_members") > 1)
    columns = ["doc_id", F.col("bytes").alias("n_bytes"), "shard", "depth"]
    plain = got.where(~over).select(*columns, F.lit(0).cast("long").alias("overflow"), *names)
    if buckets.where((F.col("depth") == BITS) & (F.col("bytes") > limit) & (F.col("members") > 1)).isEmpty():
        return plain
    # equal rows have equal sizes: number them by partition, then within it, and fill shards by number
    same = shared(got.where(over).withColumn("part", F.spark_partition_id()))
    per = same.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id")) - 1
    each = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))), F.lit(1))
    chain = same.withColumn("nth", nth).join(per, ["shard", "part"]).withColumn("overflow", F.floor((F.col("offset") + F.col("nth")) / each).cast("long"))
    return plain.union(chain.select(*columns, "overflow", *names))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """The rows of docs as Parquet, a folder for each shard; each row goes to its own shard and overflow."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    shard = F.concat_ws("-", F.concat(F.lit("b"), "shard"), "overflow").alias("shard")
    # each shard is written by one task, so that there is a file a shard; its limit bounds what the task holds of one
    _placed(docs, limit, whole).select("whole.*", shard).repartition("shard").write.partitionBy("shard").parquet(path)
