"""Balanced contiguous shards: global byte-size prefix sums from per-partition totals.

Documents are dealt by ranges of their key and sorted within each partition. The totals of the
partitions (one row each) are summed up in order, a running sum within each partition is added, and
a document goes to the shard in which the middle of its bytes falls when the whole is cut at equal
targets. So shards are contiguous in key order and differ by about one document. Only keys, sizes
and checksums move; texts stay where they are read.

Law: "bytes". Groups of equal texts get no place of their own: contiguity is by key.

Defined results: a null text has size 1 and checksum 0, as has the empty one; null keys come first;
rows equal in key, size and checksum are interchangeable; a text of any length counts with all its bytes, and one
longer than a shard fills it; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import staged, table

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every document: key, size, text_crc32, law, shard, slot, grown_shard (null)."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = docs.select(F.col(key).alias("_k"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    order = ["_k", "text_crc32", "size"]
    ranged = slim.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").drop("_tie")
    ranged = staged(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_all"),
    )
    # one row per partition of the shuffle above, so never more than its partitions
    within = Window.partitionBy("_part").orderBy(*order)
    placed = ranged.join(F.broadcast(totals), "_part").select(
        "_k", "size", "text_crc32",
        (F.col("_bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).alias("_end"),
        (F.col("_rows_before") + F.row_number().over(within)).alias("_row"),
        "_all",
    )
    cut = F.expr(f"least({shards - 1}, ((2 * _end - size) * {shards}) div (2 * _all))").cast("int")
    placed = staged(placed.withColumn("shard", cut).drop("_end", "_all"), "placed")
    first = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_shard")).select(
        F.col("_k").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes; all cases as the module says."""
    return shard_by_bytes(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sharding": op8_sharding}
#: The checksum is made of the bits of its polynomial; the order is that of key, checksum and size, null keys first.
ORACLES = {
    "op8_sharding": """
WITH RECURSIVE steps AS (
    SELECT n, n::BIGINT AS c, 0 AS k FROM range(256) r(n) UNION ALL
    SELECT n, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END), k + 1 FROM steps WHERE k < 8),
bytewise AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bs FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, x: xor(a >> 8, bytewise.t[1 + (xor(a, x) & 255)])), 4294967295::BIGINT) AS crc
      FROM d, bytewise),
p AS (SELECT doc_id, size, crc, sum(size) OVER w AS ends, sum(size) OVER () AS whole, row_number() OVER w AS nth FROM c
      WINDOW w AS (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(15, ((2 * ends - size) * 16) // (2 * whole))::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM s"""
}
