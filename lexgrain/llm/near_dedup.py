"""MinHash near-dedup with bottom-k sketches of one hash function.

A text's set of shingles is hashed once; its SKETCH smallest values are its sketch, of
which the LISTED smallest go into inverted lists.
Texts with equal sets (by 128-bit digest) are one class from the start.  Inverted lists of
retained values join the classes that share one: two sketches with `shared_values`
in common meet within the LISTED - shared_values + 1 rarest values of either, so only those are listed,
rarest by exact document frequency.  Two sets of similarity 0.8 share about 26 of 32
listed values, and fewer than 13 with a probability of about 1e-7.

Lists of up to SHORT members compare all members in memory and pass on only pairs whose
union-sketch estimate reaches the limit less five standard errors.  A longer list never
meets in one task and never makes all its pairs: `deltas` looks at its members' differences
from a pivot, which finds its links without loss.  Exact Jaccard over full sets verifies
every pair.  Components name the groups.

Results for odd input: a null, empty or wordless text has an empty set and is linked
with nothing; an empty table gives an empty result; rows that share an identifier are one
document, so all that any of them is linked with is linked; a null identifier is linked
with nothing and kept; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, marked, table
from .components import components
from .deltas import long_list_pairs
from .packing import slices
from .shingles import shingle_sets

SKETCH, LISTED, SHORT = 96, 32, 48


def shared_values(limit: float) -> int:
    """Of LISTED values, how many two sets of that similarity share but for a chance of about 1e-7."""
    return max(1, math.ceil(LISTED * limit - 5.6 * math.sqrt(LISTED * limit * (1 - limit))))


def least_estimate(limit: float) -> float:
    """The limit less five standard errors of a sketch's estimate."""
    return limit - 5.0 * math.sqrt(limit * (1 - limit) / SKETCH)


def packed_sketch(values: np.ndarray) -> bytes:
    """The upper halves of a set's least values, in order."""
    return (values[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, s0, s1 (128-bit digest of the set), sketch (its LISTED least values), sk (packed sketch)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                sizes, digests, least, packed = [], [], [], []
                for s in shingle_sets(part.column(1), words):
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    least.append(s[:LISTED])
                    packed.append(packed_sketch(s))
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32)
                flat = np.concatenate(least) if least else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))), pa.array(packed, pa.binary())], names=["doc_id", "n_shingles", "s0", "s1", "sketch", "sk"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), "doc_id long, n_shingles long, s0 long, s1 long, sketch array<long>, sk binary")


def sets_of(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """id, set (bytes of the sorted 64-bit hashes) of classes(id, doc_id, s0, s1): of the rows with a class's identifier the one with its digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                sets = [s.tobytes() for s in shingle_sets(part.column(1), words)]
                own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, sets)), np.int64).reshape(-1, 2)
                ok = (own[:, 0] == part.column(3).to_numpy()) & (own[:, 1] == part.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(sets, pa.binary())], names=["id", "set"]).filter(pa.array(ok))

    classes = table(classes, "near-wanted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = marked(rows, classes.select("doc_id"), "doc_id").where("maybe").join(classes, "doc_id")  # the others aren't shuffled
    return rows.select("doc_id", "text", "id", "s0", "s1").mapInArrow(lean(work), "id long, set binary").dropDuplicates(["id"])


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the union's sketch: of its least values, the part that is in both. Rows are sorted, padded with the largest value."""
    both = np.sort(np.concatenate([a, b], 1), 1)
    pad = np.iinfo(np.uint32).max
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    new &= both != pad
    rank = np.cumsum(new, 1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != pad)
    least = np.minimum(rank[:, -1], SKETCH)
    return (twice & (rank <= least[:, None])).sum(1) / np.maximum(least, 1)


def _unpack(blobs: list[bytes]) -> np.ndarray:
    out = np.full((len(blobs), SKETCH), np.iinfo(np.uint32).max, np.uint32)
    for i, x in enumerate(blobs):
        v = np.frombuffer(x, "<u4")
        out[i, : len(v)] = v
    return out


def _near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of sketches have an estimate of least or more."""
    return np.concatenate([estimates(a[s : s + 10_000], b[s : s + 10_000]) >= least for s in range(0, len(a), 10_000)] or [np.zeros(0, bool)])


def _filter_pairs(limit: float):
    """Of rows (a, b, sk, lsk) the pairs whose estimate allows limit."""
    least = least_estimate(limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _near(_unpack(batch.column(2).to_pylist()), _unpack(batch.column(3).to_pylist()), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return work


def _list_pairs(limit: float):
    """Pairs (a, b) whose estimate allows limit, of rows (value, id, n, sk) sorted by value; a list has SHORT rows at most."""
    least = least_estimate(limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def pairs(rows: list) -> pa.RecordBatch:
            value = np.array([r[0] for r in rows], np.int64)
            ids = np.array([r[1] for r in rows], np.int64)
            n = np.array([r[2] for r in rows], np.int64)
            sk = _unpack([r[3] for r in rows])
            start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            size = np.diff(np.append(start, len(value)))
            left, right = [], []
            for step in range(1, int(size.max(initial=1))):  # members `step` places apart in their list
                at = np.arange(len(value) - step)
                ok = value[at] == value[at + step]
                left.append(at[ok])
                right.append(at[ok] + step)
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            near = (np.minimum(n[i], n[j]) >= limit * np.maximum(n[i], n[j]) - 1e-9) & (ids[i] != ids[j])
            i, j = i[near], j[near]
            keep = np.concatenate([_near(sk[i[s : s + 10_000]], sk[j[s : s + 10_000]], least) for s in range(0, len(i), 10_000)] or [np.zeros(0, bool)])
            a, b = np.minimum(ids[i], ids[j])[keep], np.maximum(ids[i], ids[j])[keep]
            both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) > 20_000:
                last = held[-1][0]
                cut = len(held)
                while cut and held[cut - 1][0] == last:
                    cut -= 1
                if cut:
                    yield pairs(held[:cut])
                held = held[cut:]
        if held:
            yield pairs(held)

    return work


def _verify(limit: float):
    """limit: similarity; pairs (a, b, sa, sb) that reach it. The comparison is exact: 100 * both >= limit% * either."""
    percent = round(limit * 100)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def near_lists(reps: DataFrame, limit: float) -> DataFrame:
    """value, id, n, sk, rank (all documents that share a value with it): the inverted lists of the rarest shared values of reps(id, n, sketch, sk), one a distinct set."""
    values = reps.select("id", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(common, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
    # of the least values of a set, those that belong to it alone come first in order of frequency
    kept = F.least(F.col("n"), F.lit(LISTED))
    need = F.least(F.lit(shared_values(limit)), F.ceil(F.col("n") * limit))
    listed = reps.join(shared, "id").withColumn("most", (kept - need + 1 - (kept - F.size("vs"))).cast("int")).where("most > 0")
    listed = listed.select("id", "n", "sk", F.aggregate("vs", F.lit(0).cast("long"), lambda s, v: s + v["df"]).alias("rank"), F.explode(F.slice("vs", 1, F.col("most"))).alias("v"))
    return listed.select("v.value", "id", "n", "sk", "rank")


def link_lists(listed: DataFrame, limit: float, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect all pairs of limit or more that share a list of listed(value, id, n, sk, rank).

    sets_of gives id, set of a distinct id column."""
    listed = table(listed, "near-lists")
    listings = listed.count()
    sizes = table(listed.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "near-list-sizes", listings)
    sized = listed.join(sizes, "value")
    short = sized.where(F.col("members") <= SHORT).select("value", "id", "n", "sk")
    found = table(short.repartition("value").sortWithinPartitions("value").mapInArrow(lean(_list_pairs(limit)), "a long, b long").distinct(), "near-found")
    long = table(sized.where(F.col("members") > SHORT).select("value", "id", "rank"), "near-long", listings)
    wanted = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).unionByName(long.select("id")).distinct()
    sets = table(sets_of(wanted), "near-sets")
    links = compared(found, sets, limit)
    if long.isEmpty():
        return links
    sketch = table(listed.join(long.select("id").distinct(), "id").select("id", "sk").dropDuplicates(["id"]), "near-long-sketches")
    near, pairs = long_list_pairs(long, sets, sketch, limit)
    both = pairs.join(sketch.select(F.col("id").alias("a"), "sk"), "a").join(sketch.select(F.col("id").alias("b"), F.col("sk").alias("other")), "b")
    likely = both.select("a", "b", "sk", "other").mapInArrow(lean(_filter_pairs(limit)), "a long, b long")
    return links.unionByName(near).unionByName(compared(likely, sets, limit))


def compared(pairs: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """Those of pairs(a, b) whose full sets, of sets(id, set), reach limit."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return table(joined.select("a", "b", "sa", "sb").mapInArrow(lean(_verify(limit)), "a long, b long"), "near-links")


def near_dedup(docs: DataFrame, words: int = 5, limit: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = docs.select("doc_id", "text")
    each = table(sketches(rows, words), "near-sketches")
    able = each.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = able.groupBy("s0", "s1").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    # a class is known by the row of its least identifier
    whole = able.select("doc_id", "s0", "s1", "sketch", "sk").join(classes, ["s0", "s1", "doc_id"])
    reps = table(whole.select("id", "n", "sketch", "sk").dropDuplicates(["id"]), "near-reps")
    key = classes.select("id", "doc_id", "s0", "s1")
    links = link_lists(near_lists(reps, limit), limit, lambda ids: sets_of(rows, key.join(ids, "id"), words))
    # rows that share an identifier are one document
    several = able.groupBy("doc_id").agg(F.min(F.struct("s0", "s1")).alias("lo"), F.max(F.struct("s0", "s1")).alias("hi")).where("lo <> hi").select("doc_id")
    named = table(able.select("doc_id", "s0", "s1").join(several, "doc_id").distinct().join(classes.select("s0", "s1", "id"), ["s0", "s1"]).select("doc_id", "id"), "near-shared-ids")
    one = named.join(named.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")
    groups = components(links.unionByName(one)).withColumnRenamed("component", "least")
    named = classes.join(groups, "id", "left").select("s0", "s1", "doc_id", "rows", F.coalesce("least", "id").alias("group"))
    least = named.groupBy("group").agg(F.min("doc_id").alias("component"), F.sum("rows").alias("rows")).where("rows > 1")
    known = named.select("s0", "s1", "group").join(least.drop("rows"), "group").drop("group")
    out = each.join(known, ["s0", "s1"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame, words: int = 5, limit: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies; all columns stay."""
    gone = table(near_dedup(docs, words, limit).where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    key, names = f"key {uuid.uuid4().hex}", [F.col(f"`{c}`") for c in docs.columns]
    parted = marked(docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias(key)), gone.select(F.col("doc_id").alias(key)), key)
    sure = parted.where(~F.col("maybe"))  # rows that surely stay aren't shuffled
    left = parted.where("maybe").join(gone.select(F.col("doc_id").alias(key)), key, "left_anti")
    return sure.select("row.*").unionByName(left.select("row.*"))
