"""Contiguous shards of near-equal byte size, from a global prefix sum of sizes.

Rows are put in id order by a range partitioning of narrow rows (id, size, checksum).  Each
partition's totals are added up, one row for each; a running sum over those rows gives the
bytes and rows before each partition, and a running sum inside each partition the bytes
before each row.  A row goes to the shard whose equal share of all bytes holds the middle of
the row.  Only DataFrame operations run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import persist, shuffle_partitions, text_or_empty

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The shard and the place in it of each row.

    A null text has no bytes, and every row counts one byte more.  Null ids come first;
    equal ids are ordered by checksum and size, so any two rows that could change places
    are alike.  Repeated rows each get a place.  An empty table gives no rows.  Other
    columns are left out.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_column)
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    order = ("doc_id", "text_crc32", "size")
    # the salt only deals equal rows out over partitions
    dealt = narrow.withColumn("salt", F.floor(F.rand(17) * 1024).cast("int")).repartitionByRange(shuffle_partitions(spark), *order, "salt")
    rows = persist(dealt.withColumn("part", F.spark_partition_id()), "sizes")

    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    # as many rows as shuffle partitions, which is a setting and not the data's size
    placed = rows.join(F.broadcast(before), "part")
    inside = Window.partitionBy("part").orderBy(*order, "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")
    row = F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy(*order, "salt")) - 1

    def shard(start: Column) -> Column:
        middle = start.cast("decimal(38,0)") * 2 + F.col("size")
        return F.least(F.lit(shards - 1), F.floor(middle * shards / (F.col("all_bytes").cast("decimal(38,0)") * 2)).cast("int"))

    sharded = placed.select("doc_id", "size", "text_crc32", row.alias("row"), start.alias("start"), "all_bytes").withColumn("shard", shard(F.col("start")))
    sharded = persist(sharded.select("doc_id", "size", "text_crc32", "row", "shard"), "shards")
    first = sharded.groupBy("shard").agg(F.min("row").alias("first"))  # one row for each shard
    return sharded.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The same rule over the whole table in one running sum.
ORACLE_SQL = """
WITH s AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents
), p AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start,
         sum(size) OVER () AS total FROM s
), q AS (
  SELECT doc_id, size, least(15, CAST(floor((2 * start + size) * 16 / CAST(2 * total AS DOUBLE)) AS INTEGER)) AS shard FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot
FROM q
"""
