"""The stored index: files, postings, dictionary and metadata as Parquet tables under one version folder.

Layout: ROOT/v=N/{files,postings,dictionary,blooms,skipped,meta}; ROOT/CURRENT/v=N (an empty marker
table) names the version in use, so readers never see a half-written one."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..errors import IndexCorrupted, IndexMissing, TableMissing, UnsupportedVersion
from ..functions.text import is_binary
from ..functions.trigrams import postings, surveyed
from ..schema import BLOOMS, DICTIONARY, FILES, MAX_FILE_BYTES, POSTINGS, SOURCE, VERSION

SKIPPED = "path string, mtime_ns long, size_bytes long"
SKIPPED_NAMES = ("path", "mtime_ns", "size_bytes")
TABLES = {"files": FILES, "postings": POSTINGS, "dictionary": DICTIONARY, "skipped": SKIPPED, "blooms": BLOOMS}
META = "version_major int, version_minor int, created_at_us long, file_count long, posting_count long, trigram_count long, source_bytes long, skipped_binary long, skipped_size long, checksum string"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = file_system(spark, f"{root}/CURRENT")
    return sorted(int(x.getPath().getName()[2:]) for x in fs.listStatus(p) if x.getPath().getName().startswith("v=")) if fs.exists(p) else []


def exists(spark: SparkSession, root: str) -> bool:
    return bool(versions(spark, root))


def _publish(spark: SparkSession, root: str, version: int) -> None:
    fs, p = file_system(spark, f"{root}/CURRENT/v={version}")
    fs.mkdirs(p)
    for old in versions(spark, root)[:-2]:  # the version before stays for readers that have it open
        for gone in (f"{root}/CURRENT/v={old}", f"{root}/v={old}"):
            fs.delete(file_system(spark, gone)[1], True)


def file_table(source: DataFrame) -> DataFrame:
    """FILES of source(file_id, path, ext, mtime_ns, size_bytes, content); trigram_count is filled in by `build`."""
    return source.select(
        "file_id", "path", "ext", "mtime_ns", "size_bytes", F.md5("content").alias("content_hash"), F.lit(None).cast("int").alias("trigram_count"),
        is_binary(F.col("content")).alias("is_binary"), F.lit("fresh").alias("status"),
    )


def usable(source: DataFrame) -> DataFrame:
    """What is indexed: not too large and not binary."""
    return source.where((F.col("size_bytes") <= MAX_FILE_BYTES) & ~is_binary(F.col("content")))


def build_stats(source: DataFrame) -> DataFrame:
    """files_scanned, files_skipped_binary, files_skipped_size, bytes_scanned of a source."""
    return _totals(source.select("size_bytes", is_binary(F.col("content")).alias("is_binary")))


def _totals(files: DataFrame) -> DataFrame:
    large = F.col("size_bytes") > MAX_FILE_BYTES
    binary = ~large & F.col("is_binary")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return files.agg(
        F.count(F.lit(1)).alias("files_scanned"), count(binary).alias("files_skipped_binary"), count(large).alias("files_skipped_size"),
        F.coalesce(F.sum(F.when(large, 0).otherwise(F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes_scanned"),
    )


def doc_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("trigram").agg(F.count(F.lit(1)).alias("doc_frequency"))


def _survey(source: DataFrame, at: str) -> DataFrame:
    """FILES, indexed (null: neither that nor skipped) and bloom of source, stored at `at`: one pass tells all that is told of whole files."""
    fits = F.col("size_bytes") <= MAX_FILE_BYTES
    rows = source.select("file_id", "path", "ext", "mtime_ns", "size_bytes", is_binary(F.col("content")).alias("is_binary"), F.lit("fresh").alias("status"), "content")
    rows = rows.withColumn("indexed", F.when(fits & ~F.col("is_binary"), True).when(~fits | F.col("is_binary"), False))
    seen = surveyed(rows.withColumn("content", F.when(F.col("indexed"), F.col("content"))).withColumn("content_hash", F.md5("content")))
    seen.write.option("compression", "zstd").parquet(at)
    return source.sparkSession.read.schema(seen.schema).parquet(at)


def _spread(source: DataFrame) -> DataFrame:
    """source on all cores: a table may lie in fewer row groups."""
    cores = source.sparkSession.sparkContext.defaultParallelism
    return source.repartition(cores) if source.rdd.getNumPartitions() < cores else source


#: How postings lie on disk: runs of a trigram and small steps of identifiers.
ENCODING = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#file_id": "false"}
#: Postings that one file holds as one run; postings for each file of the dictionary about; dropped files that an update broadcasts at most.
TOGETHER, COUNTED, DROPPED = 1_000_000, 64_000_000, 1 << 20


def _write(spark: SparkSession, root: str, version: int, files: DataFrame, posted: DataFrame, filters: DataFrame, left_out: DataFrame, counts: tuple[int, int]) -> None:
    at = f"{root}/v={version}"
    left_out.write.parquet(f"{at}/skipped")
    filters.select(*BLOOMS.names).write.option("compression", "zstd").parquet(f"{at}/blooms")
    files.select(*FILES.names).write.option("compression", "zstd").parquet(f"{at}/files")
    totals = spark.read.schema(FILES).parquet(f"{at}/files").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("trigram_count"), F.lit(0)).alias("t")).first()
    # runs sorted by (trigram, file) follow each other in a file: a lookup reads a page or two of each, and no posting is moved
    posted = posted.coalesce(1).sortWithinPartitions("trigram", "file_id") if totals["t"] <= TOGETHER else posted
    posted.select(*POSTINGS.names).write.options(**ENCODING).parquet(f"{at}/postings")
    posted = spark.read.schema(POSTINGS).parquet(f"{at}/postings")
    total = posted.count()
    doc_frequency(posted).repartitionByRange(max(1, -(-total // COUNTED)), "trigram").sortWithinPartitions("trigram").write.options(**ENCODING).parquet(f"{at}/dictionary")
    row = (*VERSION, time.time_ns() // 1000, totals["n"], total, spark.read.parquet(f"{at}/dictionary").count(), totals["b"], *counts)
    spark.createDataFrame([(*row, _checksum(row))], META).coalesce(1).write.parquet(f"{at}/meta")
    fs, p = file_system(spark, f"{at}/seen")
    fs.delete(p, True)
    _publish(spark, root, version)


def _checksum(row: tuple) -> str:
    return hashlib.md5(repr(row).encode()).hexdigest()


def build(source: DataFrame, root: str) -> dict:
    """Indexes source(file_id, path, ext, mtime_ns, size_bytes, content) and returns the build's statistics."""
    spark = source.sparkSession
    version = max(versions(spark, root), default=0) + 1
    source = _spread(source.select(*SOURCE.names))
    seen = _survey(source, f"{root}/v={version}/seen")
    stats = _totals(seen).first().asDict()
    good = seen.where("indexed")
    _write(spark, root, version, good, postings(usable(source)), good, seen.where("not indexed").select(*SKIPPED_NAMES), (stats["files_skipped_binary"], stats["files_skipped_size"]))
    return stats


class StoredIndex:
    """An opened index; its tables are lazy DataFrames."""

    def __init__(self, spark: SparkSession, root: str, check: bool = True):
        self.spark, self.root = spark, root
        found = versions(spark, root)
        if not found:
            raise IndexMissing(root)
        self.version = found[-1]
        self.meta = self._open("meta", META).first()
        if self.meta is None:
            raise IndexCorrupted(f"{root}: no metadata")
        if self.meta["version_major"] != VERSION[0] or self.meta["version_minor"] < VERSION[1]:
            raise UnsupportedVersion(f"{root}: {self.meta['version_major']}.{self.meta['version_minor']}")
        if _checksum(tuple(self.meta)[:-1]) != self.meta["checksum"]:
            raise IndexCorrupted(f"{root}: metadata and their checksum differ")
        self.files, self.postings, self.dictionary, self.skipped, self.blooms = (self._open(t, s) for t, s in TABLES.items())
        if check:
            self.check()

    def _open(self, table: str, schema) -> DataFrame:
        path = f"{self.root}/v={self.version}/{table}"
        fs, p = file_system(self.spark, path)
        if not fs.exists(p):
            raise TableMissing(path)
        # a page that was damaged fails the read
        return self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)

    def check(self) -> None:
        """Row counts against the metadata; they come from the files' footers."""
        for table, n in (("files", "file_count"), ("postings", "posting_count"), ("dictionary", "trigram_count")):
            got = getattr(self, table).count()
            if got != self.meta[n]:
                raise IndexCorrupted(f"{table} has {got} rows, not {self.meta[n]}")

    def frequencies(self, trigrams: list[int]) -> dict[int, int]:
        """doc_frequency of a query's trigrams that occur (as many rows as the query has trigrams at most)."""
        return {r["trigram"]: r["doc_frequency"] for r in self.dictionary.where(F.col("trigram").isin(trigrams)).collect()} if trigrams else {}


def diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, change ("added", "modified", "deleted") between current(path, mtime_ns, size_bytes) and stored files."""
    a = current.select("path", F.col("mtime_ns").alias("m"), F.col("size_bytes").alias("s"))
    b = stored.select("path", F.col("mtime_ns").alias("m0"), F.col("size_bytes").alias("s0"))
    change = F.when(F.col("s0").isNull(), "added").when(F.col("s").isNull(), "deleted").when((F.col("m") != F.col("m0")) | (F.col("s") != F.col("s0")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where(F.col("change").isNotNull())


def is_stale(current: DataFrame, index: StoredIndex) -> bool:
    """Whether anything was modified after the index was built."""
    last = current.agg(F.max("mtime_ns")).first()[0]
    return last is not None and last // 1000 > index.meta["created_at_us"]


def update(source: DataFrame, root: str, load: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Brings the index to source: rows of unchanged files are kept, deleted ones dropped, changed and new ones extracted. Identifiers are the source's own.

    load: gives the content of those of source that are added or modified; source is only listed then."""
    spark = source.sparkSession
    if not exists(spark, root):
        build(load(source) if load else source, root)
        return {"added": StoredIndex(spark, root).meta["file_count"], "modified": 0, "deleted": 0}
    old = StoredIndex(spark, root)
    known = old.files.select("path", "mtime_ns", "size_bytes").unionByName(old.skipped)
    changed = diff(source, known).persist(StorageLevel.DISK_ONLY)
    if changed.isEmpty():
        return {"added": 0, "modified": 0, "deleted": 0}
    now = source.join(changed.where(F.col("change") != "deleted").select("path"), "path", "left_semi")
    now = (load(now) if load else now.select(*SOURCE.names)).persist(StorageLevel.DISK_ONLY)
    seen = _survey(now, f"{root}/v={old.version + 1}/seen")
    left_out, fresh, filed = seen.where("not indexed").select(*SKIPPED_NAMES), usable(now), seen.where("indexed")
    news = changed.join(left_out.select("path"), "path", "left_anti").join(old.skipped.select("path", F.lit(True).alias("was")), "path", "left")
    news = news.where(~((F.col("change") == "deleted") & F.col("was").isNotNull()))
    counts = {"added": 0, "modified": 0, "deleted": 0} | {r["change"]: r["count"] for r in news.groupBy("change").count().collect()}
    kept = old.files.join(changed, "path", "left_anti")
    top = old.files.agg(F.max("file_id")).first()[0] or 0
    # what goes is mostly less than what stays, and as a broadcast moves no posting
    gone = old.files.join(changed, "path", "left_semi").select("file_id").join(kept.select("file_id"), "file_id", "left_anti").persist(StorageLevel.DISK_ONLY)
    few = F.broadcast(gone) if gone.count() <= DROPPED else gone
    reused, filters = (t.where(F.col("file_id").isNotNull()).join(few, "file_id", "left_anti") for t in (old.postings, old.blooms))
    if not source.join(kept.select("file_id", F.col("path").alias("p")), "file_id").where(F.col("path") != F.col("p")).isEmpty():
        anew = {"file_id": F.col("file_id") + F.lit(top + 1)}  # the source numbered its files anew
        fresh, filed = fresh.withColumns(anew), filed.withColumns(anew)
    files = kept.select(*FILES.names).unionByName(filed.select(*FILES.names))
    out = old.skipped.join(changed, "path", "left_anti").unionByName(left_out)
    large = out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("size_bytes") > MAX_FILE_BYTES).cast("long")), F.lit(0)).alias("large")).first()
    _write(spark, root, old.version + 1, files, reused.unionByName(postings(fresh)), filters.unionByName(filed.select(*BLOOMS.names)), out, (large["n"] - large["large"], large["large"]))
    gone.unpersist()
    now.unpersist()
    changed.unpersist()
    return counts
