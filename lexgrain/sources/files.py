"""Files of a folder as a DataFrame, plain, compressed or in archives."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import MAX_FILE_BYTES, SOURCE
from .walk import extension, walk

CODECS = ("gz", "zst", "bz2", "xz")
#: Files listed for one read task; bytes of content and files that a batch is passed on with.
PER_TASK, PASSED, ROWS = 256, 1 << 20, 1000


def decompressed(data: bytes, ext: str) -> bytes:
    """The contents of a compressed file, all streams of it; other extensions as they are."""
    if ext == "gz":
        return gzip.decompress(data)
    if ext == "bz2":
        return bz2.decompress(data)
    if ext == "xz":
        return lzma.decompress(data)
    if ext == "zst":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    return data


def entries(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path:entry, content) of the regular entries of a zip or tar.gz archive."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield f"{path}:{info.filename}", z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
            for m in t:
                if m.isfile():
                    yield f"{path}:{m.name}", t.extractfile(m).read()


def _packed(path: str) -> bool:
    return path.endswith((".zip", ".tar.gz"))


def _expanded(file_id: int, path: str, ext: str, mtime: int, size: int, data: bytes | None, decompress: bool, archives: bool) -> Iterator[tuple]:
    """SOURCE rows of a file; none if it is broken inside."""
    packed = archives and _packed(path)
    try:
        if data is None:
            rows = [(path, None)]
        else:
            rows = list(entries(path, data)) if packed else [(path, decompressed(data, ext) if decompress and ext in CODECS else data)]
    except (OSError, EOFError, lzma.LZMAError, tarfile.TarError, zipfile.BadZipFile, ValueError):
        return
    for k, (name, body) in enumerate(rows):
        kind = extension(name.rpartition(":")[2].rpartition("/")[2]) if packed else ext
        yield file_id + (k << 40), name, kind, mtime, len(body) if packed else size, body


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch; only one is held besides it."""
    for row in zip(*b.columns, strict=True):
        yield tuple(x.as_py() for x in row)


def _passed_on(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """SOURCE rows as batches of a few contents."""
    held, size = [], 0
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if size >= PASSED or len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=SOURCE.names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=SOURCE.names)


def expand(files: DataFrame, decompress: bool = False, archives: bool = False) -> DataFrame:
    """SOURCE rows with compressed contents decompressed and archives replaced by their entries (path:entry)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _passed_on(out for b in batches for row in _rows(b) for out in _expanded(*row, decompress, archives))

    return files.select(*SOURCE.names).mapInArrow(work, SOURCE)


LISTED = "file_id long, path string, ext string, mtime_ns long, size_bytes long"


def list_files(spark: SparkSession, root: str, archives: bool = False, warn=None, paths: list[str] | None = None) -> DataFrame:
    """LISTED rows of the files under root, none of which is opened; identifiers count paths in sorted order. paths: only these, relative to root."""
    only = None if paths is None else set(paths)
    found = [f for f in walk(root, warn, archives) if only is None or f.path in only]
    if not found:
        return spark.createDataFrame([], LISTED)
    columns = {"file_id": pa.array(range(len(found)), pa.int64()), "path": pa.array([f.path for f in found], pa.string()), "ext": pa.array([f.ext for f in found], pa.string())}
    return spark.createDataFrame(pa.table(columns | {"mtime_ns": pa.array([f.mtime_ns for f in found], pa.int64()), "size_bytes": pa.array([f.size for f in found], pa.int64())}))


def load_files(listed: DataFrame, root: str, decompress: bool = False, archives: bool = False, files: int | None = None) -> DataFrame:
    """SOURCE rows of listed files (LISTED) under root, a folder that all executors see; only these are opened.

    Files above the size limit come without content, except compressed ones that are to be read decompressed.
    A file that can't be read, or is broken inside, is left out.  files: how many there are about."""
    base = os.path.dirname(os.path.abspath(root)) if os.path.isfile(root) else os.path.abspath(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for file_id, path, ext, mtime, size in _rows(b):
                data = None
                if size <= MAX_FILE_BYTES or decompress and ext in CODECS or archives and _packed(path):
                    try:
                        with open(os.path.join(base, path), "rb") as f:
                            data = f.read()
                    except OSError:
                        continue
                yield from _expanded(file_id, path, ext, mtime, size, data, decompress, archives)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _passed_on(read(batches))

    n = listed.count() if files is None else files
    cores = listed.sparkSession.sparkContext.defaultParallelism
    return listed.select(*SOURCE.names[:-1]).repartition(max(1, min(n, cores), -(-n // PER_TASK))).mapInArrow(load, SOURCE)


def read_files(spark: SparkSession, root: str, decompress: bool = False, archives: bool = False, warn=None, paths: list[str] | None = None) -> DataFrame:
    """SOURCE rows of all files under root, or of those of paths."""
    return load_files(list_files(spark, root, archives, warn, paths), root, decompress, archives)


def listing(spark: SparkSession, root: str, warn=None) -> DataFrame:
    """path, mtime_ns, size_bytes of the files under root."""
    rows = [(f.path, f.mtime_ns, f.size) for f in walk(root, warn)]
    return spark.createDataFrame(rows, "path string, mtime_ns long, size_bytes long")
