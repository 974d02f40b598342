"""Contiguous shards of nearly equal bytes, from global prefix sums of row sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import store

#: Bytes that a row counts for beside its text.
OVERHEAD = 8
SHARDS = 24
#: Range partitions per configured shuffle partition.
SPREAD = 2


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Cut ``docs`` (doc_id, text) in order of doc_id into ``shards`` runs of nearly equal bytes.

    Only doc_id, size and checksum are dealt by range; each range's total goes
    into a running sum over ranges, of which there are as many as partitions,
    and each row's first byte is its range's start plus the sum within the
    range. A row belongs to the shard that holds its middle byte when all
    bytes are cut at equal targets. A shard's size thus differs from its
    target by at most the size of a row at either end.

    Rows are ordered by doc_id (nulls first), then checksum and size; rows
    equal in all of these may stand in either order. A null text has size 8
    and the checksum of no bytes; of a text of any length, only its size and
    checksum are moved. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    parts = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id())
    dealt = store(dealt, "ranges")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per partition: as few as the cluster has tasks, whatever the input
    starts = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"), F.sum("bytes").over(every).alias("total")
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("upto", F.sum("size").over(inside)).join(F.broadcast(starts), "part")
    # the middle byte, doubled to stay whole; decimals, since bytes times shards may pass 2**63
    middle = (2 * (F.col("start") + F.col("upto")) - F.col("size")).cast("decimal(28,0)") * F.lit(shards)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / (2 * F.col("total")).cast("decimal(20,0)")).cast("int")))
    # places in a shard from the same two steps: each range's count of each shard, then within the range
    per = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    first = per.select("shard", "part", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("part", "shard").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("number", number)
        .join(F.broadcast(first), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same sums in one window; the checksum is folded over the bits of the text, lowest bit of each byte first.
ORACLE = r"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
n AS (SELECT doc_id, size, list_transform(h, lambda x: (strpos('0123456789ABCDEF', x) - 1)::BIGINT) AS n FROM d),
b AS (SELECT doc_id, size, flatten(list_transform(range(1, len(n), 2), lambda i: [n[i + 1] & 1, n[i + 1] >> 1 & 1, n[i + 1] >> 2 & 1, n[i + 1] >> 3, n[i] & 1, n[i] >> 1 & 1, n[i] >> 2 & 1, n[i] >> 3])) AS b FROM n),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, v: xor(a >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295) AS crc FROM b),
p AS (SELECT doc_id, size, crc, sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(23, ((2 * upto - size) * 24) // (2 * total)) AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""
