"""What the operators of this subpackage share: reading, shared storage, hashing of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def trim() -> None:
    """A Python worker, which lives on after its task, gives its free memory back."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, and `trim` after it."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        trim()

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one only a local session runs, in a folder of our own, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexgrain-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Narrow rows that one file of a table holds.
ROWS_A_FILE = 250_000


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors.

    rows: a bound on narrow rows that cost little to make; the table has no more files than they need."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


#: Bits of a set of marks; its table has a 64th as many rows at most.
MARK_BITS = 1 << 24


def marked(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows with a boolean `maybe`: true wherever the long column `on` is in keys, and false for most others.

    The marks are one bit a key, MARK_BITS // 64 rows at most whatever the input, so they are broadcast; with far more keys than bits all rows are true."""
    at = F.pmod(F.xxhash64(F.col(f"`{on}`")), F.lit(MARK_BITS))
    bits = keys.select(F.shiftright(at, 6).alias("mark_word"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = table(bits.groupBy("mark_word").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("mark_bits")), "marks")
    here = rows.withColumn("mark_word", F.shiftright(at, 6)).join(F.broadcast(words), "mark_word", "left")
    bit = F.call_function("shiftright", F.col("mark_bits"), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return here.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("mark_word", "mark_bits")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
