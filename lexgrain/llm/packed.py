"""Exchanges of packed arrays: a task sends each bucket one row of compressed columns instead of a row for each record."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import lean

#: Rows of an exchange: a bucket, and packed columns.
ROWS = "bucket int, blob binary"


def pack(columns: dict[str, np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps({k: (v.dtype.str, v.tobytes()) for k, v in columns.items()}, protocol=5))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(b, t) for k, (t, b) in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)).items()}  # noqa: S301  our own bytes


def deal(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The rows of columns by bucket, in order within each."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    moved = {k: v[order] for k, v in columns.items()}
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(sorted_[a]), {k: v[a:b] for k, v in moved.items()}


def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def by_bucket(df: DataFrame, buckets: int, work: Callable[[Iterator[dict[str, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work gets the unpacked rows of one bucket at a time (an iterator) and yields batches of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != at and held:
                    yield from work(map(unpack, held))
                    held = []
                at = k
                held.append(blob.as_py())
        if held:
            yield from work(map(unpack, held))

    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), schema)


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
