"""Sharding by a two-pass external shuffle, with DataFrame operations only.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of
identifier, text checksum and size.  Pass two holds one bucket at a time as an
array in a fixed order, Fisher-Yates shuffles it (the built-in `shuffle`, seeded)
and lays the buckets end to end: a record's place in that global permutation gives
its shard and slot.  Shards are equal stretches of places, so their row counts
differ by at most one ("rows" law), and each bucket writes to one or two shards.

Buckets that land in one partition are sorted before they are shuffled, so reruns
and retried tasks agree.  Only one row a bucket (its count) meets in one place.

Results for odd input: a null text has no bytes, checksum 0; an empty table gives an
empty result; null and repeated identifiers are ordinary rows; rows that repeat
identifier and text share a bucket; extra columns are carried only if named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, table

ROW_BYTES = 16


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_rows: int = 8192, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the carried columns of every row.

    bucket_rows bounds what pass two holds at once; with whole texts carried, choose it as memory / mean text."""
    if shards < 1 or bucket_rows < 1:
        raise ValueError("shards and bucket_rows start at 1")
    rows = docs.select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), *carry)
    spark = docs.sparkSession
    total = docs.count()
    n = max(1, math.ceil(total / bucket_rows), min(partitions(spark), total))
    record = F.struct(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size").alias("mix"), "doc_id", "size", "text_crc32", *carry)
    scattered = rows.select(F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "size"), F.lit(n)).cast("int").alias("bucket"), record.alias("r"))
    held = scattered.repartition(n, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("r")).alias("rs")).sortWithinPartitions("bucket")
    mixed = table(held.select("bucket", F.shuffle("rs", seed).alias("rs")), "shard-buckets")
    starts = mixed.select("bucket", F.size("rs").cast("long").alias("n")).withColumn("start", F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    placed = mixed.join(starts.select("bucket", F.coalesce("start", F.lit(0)).alias("start")), "bucket").select("start", F.posexplode("rs").alias("i", "r"))
    placed = placed.select("r.*", (F.col("start") + F.col("i")).alias("place"))
    # the last shard whose first place, floor(shard * count / shards), is not after this place
    out = placed.withColumn("shard", F.expr(f"cast(((place + 1) * {shards}L - 1) div {max(total, 1)}L as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total}L) div {shards}L")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"), *carry)


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17, bucket_rows: int = 4096) -> None:
    """Writes doc_id and text as one folder of Parquet files a shard, rows in slot order within each file."""
    out = shard(docs, shards, seed, bucket_rows, carry=("text",))
    out.repartitionByRange(max(shards, partitions(docs.sparkSession)), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
