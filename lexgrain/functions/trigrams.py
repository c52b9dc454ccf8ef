"""Byte trigrams, the filters over them, and their extraction from whole tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Size in bytes and hash functions of a file's filter.
BLOOM_BYTES, BLOOM_HASHES = 256, 5
#: Bytes of content whose trigrams are sorted together; rows taken up or passed on together; bytes of content and files whose filters are made together.
PIECE, ROWS, SMALL, MANY = 1 << 24, 1 << 16, 1 << 20, 4096


def trigram(a: int, b: int, c: int) -> int:
    return a << 16 | b << 8 | c


def trigram_set(data: bytes) -> list[int]:
    """Distinct trigrams of a query, sorted; those with a zero byte are left out, as in the index."""
    return sorted({trigram(*data[i : i + 3]) for i in range(len(data) - 2) if 0 not in data[i : i + 3]})


def case_variants(gram: bytes) -> list[int]:
    """The trigrams that equal gram but for ASCII case, at most eight."""
    sides = [sorted({b, b ^ 0x20}) if 65 <= b & 0xDF <= 90 and b < 0x80 else [b] for b in gram]
    return sorted(trigram(*x) for x in product(*sides))


def folds_plainly(gram: bytes) -> bool:
    """Whether Unicode case folding keeps to ASCII: not for bytes above, nor for k and s, which other code points fold to."""
    return all(b < 0x80 and b not in b"kKsS" for b in gram)


def case_groups(data: bytes) -> list[list[int]]:
    """One group of variants for each place of a query that the index can answer soundly."""
    return [case_variants(g) for i in range(len(data) - 2) if folds_plainly(g := data[i : i + 3]) and 0 not in g]


def codes(data: bytes) -> np.ndarray:
    """The trigram at each place, -1 where it has a zero byte."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    if len(b) < 3:
        return np.zeros(0, np.int32)
    out = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    out[(b[:-2] == 0) | (b[1:-1] == 0) | (b[2:] == 0)] = -1
    return out


def with_offsets(data: bytes) -> list[tuple[int, int]]:
    """(trigram, offset) pairs, sorted."""
    c = codes(data)
    at = np.flatnonzero(c >= 0)
    order = np.lexsort((at, c[at]))
    return list(zip(c[at][order].tolist(), at[order].tolist(), strict=True))


def _xxh64(grams: np.ndarray, seed: int) -> np.ndarray:
    """xxh64 of each trigram's four bytes, little end first."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = np.asarray(grams).astype(np.uint64) * p1 ^ np.uint64(seed + int(p5) + 4)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _bits(grams: np.ndarray) -> np.ndarray:
    """BLOOM_HASHES places for each trigram."""
    h1, h2 = _xxh64(grams, 0), _xxh64(grams, 1)
    return np.stack([(h1 + np.uint64(i) * h2) % np.uint64(BLOOM_BYTES * 8) for i in range(BLOOM_HASHES)]).astype(np.int64)


def _filter(places: np.ndarray) -> bytes:
    bits = np.zeros(BLOOM_BYTES * 8, np.uint8)
    bits[places.ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bloom(grams: np.ndarray) -> bytes:
    return _filter(_bits(grams))


def bloom_may_contain(filter_: bytes | None, gram: int) -> bool:
    """False only if gram is certainly not in it; an unreadable filter may contain anything."""
    if not filter_ or len(filter_) != BLOOM_BYTES:
        return True
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8), bitorder="little")
    return bool(bits[_bits(np.array([gram]))].all())


def pieces(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of batches, whose last column is content, by PIECE bytes of it; a larger content is alone."""
    most = most or PIECE
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).fill_null(0).to_numpy().astype(np.int64))
        start = 0
        while start < len(b):
            before = int(ends[start - 1]) if start else 0
            end = max(int(np.searchsorted(ends, before + most - size, "right")), start + (not held))
            if end > start:
                held.append(b.slice(start, end - start))
                size += int(ends[end - 1]) - before
            if end < len(b):
                yield pa.concat_batches(held)
                held, size = [], 0
            start = end
    if held:
        yield pa.concat_batches(held)


def _counted(content: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trigram, rank of the content and occurrences of the distinct trigrams of each of content, sorted by trigram and rank."""
    content = content.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
    data = np.frombuffer(content.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    if len(data) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    if len(content) == 1:  # one content, however large: counts in a table, piece by piece
        n = sum(np.bincount(c[c >= 0], minlength=1 << 24) for c in (codes(data[i : i + PIECE + 2].tobytes()) for i in range(0, len(data), PIECE))) if len(data) > PIECE else None
        kinds, n = (np.flatnonzero(n), n[n > 0]) if n is not None else np.unique((c := codes(data.tobytes()))[c >= 0], return_counts=True)
        return kinds.astype(np.int32), np.full(len(kinds), rank[0]), n.astype(np.int32)
    plain = data != 0
    good = plain[:-2] & plain[1:-1]
    good &= plain[2:]
    last = at[1:] - at[0]
    for k in (1, 2):  # no trigram goes over a content's end
        ends = last - k
        good[ends[(ends >= 0) & (ends < len(good))]] = False
    of = np.repeat(rank.astype(np.uint32), np.diff(at))
    key = np.empty(np.count_nonzero(good), np.uint64)
    end = 0
    for i in range(0, len(good), ROWS):  # what is made on the way stays in the cache
        keep, d = good[i : i + ROWS], data[i : i + ROWS + 2].astype(np.uint32)
        code, own = (d[:-2] << 16 | d[1:-1] << 8 | d[2:])[keep], of[i : i + ROWS][: len(keep)][keep]
        key[end : end + len(code)] = code.astype(np.uint64) << np.uint64(32) | own
        end += len(code)
    del of, good, plain
    key.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key))).astype(np.int32)
    key = key[first]
    return (key >> np.uint64(32)).astype(np.int32), (key & np.uint64((1 << 32) - 1)).astype(np.int64), n


def postings(files: DataFrame, offsets: bool = False) -> DataFrame:
    """trigram, file_id, tf (and offsets) of files(file_id, content).

    Without offsets, rows come as runs sorted by (trigram, file_id), each of about PIECE bytes of content; with them, one file at a time."""
    schema = "trigram int, file_id long, tf int" + (", offsets array<int>" if offsets else "")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            order = pc.array_sort_indices(b.column(0))
            rank = np.empty(len(b), np.int64)
            rank[order.to_numpy()] = np.arange(len(b))
            ids = b.column(0).take(order)
            kinds, of, n = _counted(b.column(1), rank)
            for i in range(0, len(kinds), ROWS):
                part = slice(i, i + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[part]), ids.take(pa.array(of[part])), pa.array(n[part])], names=["trigram", "file_id", "tf"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, content in zip(b.column(0), b.column(1), strict=True):
                c = codes(content.as_py() or b"")
                at = np.flatnonzero(c >= 0)
                c = c[at]
                if not len(c):
                    continue
                order = np.argsort(c, kind="stable")
                kinds, first = np.unique(c[order], return_index=True)
                ends = np.append(first, len(c)).astype(np.int32)
                where = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int32)))
                arrays = [pa.array(kinds, pa.int32()), pa.array(np.full(len(kinds), file_id.as_py()), pa.int64()), pa.array(np.diff(ends), pa.int32()), where]
                yield pa.RecordBatch.from_arrays(arrays, names=["trigram", "file_id", "tf", "offsets"])

    return files.select("file_id", "content").mapInArrow(work if offsets else runs, schema)


def surveyed(files: DataFrame) -> DataFrame:
    """files with trigram_count and bloom in place of their content."""
    schema = T.StructType([f for f in files.schema if f.name != "content"] + [T.StructField("trigram_count", T.IntegerType()), T.StructField("bloom", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, SMALL):
            for i in range(0, len(whole), MANY):
                b = whole.slice(i, MANY)
                kinds, of, _ = _counted(b.column(b.num_columns - 1), np.arange(len(b)))
                first = np.flatnonzero(np.diff(kinds, prepend=-1))
                places = np.repeat(_bits(kinds[first]), np.diff(np.append(first, len(kinds))), axis=1)
                bits = np.zeros(len(b) * BLOOM_BYTES * 8, bool)
                for row in places:
                    bits[of * (BLOOM_BYTES * 8) + row] = True
                packed = pa.py_buffer(np.packbits(bits, bitorder="little"))
                filters = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BLOOM_BYTES), len(b), [None, packed]).cast(pa.binary())
                count = pa.array(np.bincount(of, minlength=len(b)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], count, filters], names=[f.name for f in schema])

    return files.select(*[c for c in files.columns if c != "content"], "content").mapInArrow(work, schema)


def blooms(files: DataFrame) -> DataFrame:
    """file_id, bloom of files(file_id, content)."""
    return surveyed(files.select("file_id", "content")).select("file_id", "bloom")


def may_contain(filters: DataFrame, grams: list[int]) -> DataFrame:
    """file_id of filters(file_id, bloom) that may hold all of grams: a filter has all their bits, or can't be read."""
    wanted = _filter(_bits(np.array(sorted(set(grams)), np.int64))) if grams else bytes(BLOOM_BYTES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(wanted, np.uint8)
        for b in batches:
            got = [x.as_py() for x in b.column(1)]
            keep = [x is None or len(x) != BLOOM_BYTES or bool(((np.frombuffer(x, np.uint8) & mask) == mask).all()) for x in got]
            yield b.filter(pa.array(keep, pa.bool_())).select(["file_id"])

    return filters.select("file_id", "bloom").mapInArrow(work, "file_id long")
