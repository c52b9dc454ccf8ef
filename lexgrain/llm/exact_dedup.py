"""Exact dedup by content sort, with DataFrame operations only.

Sampled splitters range-partition the normalised texts by leading characters and
digest, each partition sorts its rows externally, equal texts stand next to each
other and the window's full comparison of neighbouring texts delimits the groups.
One identifier of each group stays.

A text that fills more than about one partition is found in a sample whose size
follows the number of partitions; its rows are salted over all partitions and the
partial groups are merged by digest.  The table of such texts has at most
2 * partitions rows, whatever the input, so it may be broadcast.

Results for odd input: a null text counts as empty; an empty table gives an empty
result; a null identifier stays only where its group has no other; of rows that
repeat both identifier and text one is kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, partitions, table

#: Expected sampled rows of a partition's share, and how many of them make a text heavy.
SAMPLE_PER_PARTITION, HEAVY = 40, 20
#: Characters of the text that lead the sort key; the digest splits longer common starts.
LEAD = 32


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def heavy_texts(rows: DataFrame, n: int) -> DataFrame:
    """Digests that hold more than about 1/(2n) of the rows, by a sample keyed on the identifier."""
    total = rows.count()
    share = min(1.0, SAMPLE_PER_PARTITION * n / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    least = max(2, int(HEAVY * min(1.0, total / (SAMPLE_PER_PARTITION * n)))) if total else 2
    return sample.groupBy(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256).alias("text_sha256")).count().where(F.col("count") >= least).select("text_sha256")


def exact_dedup(docs: DataFrame, keep: str = "min") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; keep: "min" or "max" identifier stays."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    rows, n = docs.select("doc_id", "text"), partitions(docs.sparkSession)
    heavy = table(heavy_texts(rows, n), "exact-heavy")
    norm = rows.select("doc_id", F.encode(normalised(F.col("text")), "UTF-8").alias("norm"))
    keyed = norm.withColumn("text_sha256", F.sha2("norm", 256)).join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "text_sha256", "left")
    keyed = keyed.select("doc_id", "norm", "text_sha256", F.substring("norm", 1, LEAD).alias("lead"), F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).otherwise(-1).alias("salt"))
    dealt = keyed.repartitionByRange(n, "lead", "text_sha256", "salt")
    best = F.max if keep == "max" else F.min
    run = W.partitionBy("lead", "text_sha256", "salt", "norm").orderBy(F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    marked = dealt.select("doc_id", "text_sha256", "salt", best("doc_id").over(whole).alias("run_id"), F.count(F.lit(1)).over(whole).alias("run_size"), F.row_number().over(run).alias("nth"))
    runs = table(marked, "exact-runs")
    merged = runs.where("salt >= 0").groupBy("text_sha256").agg(best("doc_id").alias("all_id"), F.count(F.lit(1)).alias("all_size"))
    out = runs.join(F.broadcast(merged), "text_sha256", "left")
    keep_id = F.coalesce("all_id", "run_id")
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("all_size", "run_size").alias("group_size"), (F.col("doc_id").eqNullSafe(keep_id) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def drop_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs without the rows whose text another row with a smaller (or larger) identifier has; all columns stay."""
    n, names = partitions(docs.sparkSession), docs.columns
    best = F.max if keep == "max" else F.min
    heavy = table(heavy_texts(docs.select("doc_id", "text"), n), "exact-heavy")
    norm = lambda text: F.encode(normalised(text), "UTF-8")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", F.substring(norm(F.col("text")), 1, LEAD).alias("lead"), F.sha2(norm(F.col("text")), 256).alias("text_sha256"))
    keyed = keyed.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "text_sha256", "left")
    keyed = keyed.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).otherwise(-1))
    merged = keyed.where("hot").groupBy("text_sha256").agg(best("doc_id").alias("all_id"))
    dealt = keyed.drop("hot").repartitionByRange(n, "lead", "text_sha256", "salt")
    # the texts travel once, and are compared whole where they stand next to each other
    run = W.partitionBy("lead", "text_sha256", "salt", norm(F.col("row.text"))).orderBy(F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last())
    first = dealt.withColumn("nth", F.row_number().over(run)).where("nth = 1").join(F.broadcast(merged), "text_sha256", "left")
    return first.where((F.col("salt") < 0) | F.col("doc_id").eqNullSafe(F.col("all_id"))).select("row.*")
