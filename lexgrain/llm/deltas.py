"""Links within long inverted lists, without comparing all pairs of a list.

Lists get a pivot p: each member knows the foremost member that it shares a list with, and a
list joins the family of the one that most of its members know.  A family's pivot is the
member whose sketch values most others have.  Of every other member x only the difference
D(x) = x xor p is looked at.  With s = |x xor y| the limit P % asks for
(100 + P) s <= (100 - P) (|x| + |y|), and s = |D(x)| + |D(y)| - 2 |D(x) & D(y)|.  So

* members whose difference is small are linked to the pivot, and need no link among
  themselves;
* a pair with one of the other members (outsiders) needs a certain overlap of the two
  differences, one element at least: each member is listed under the first elements of its
  difference only (what it adds before what it lacks, each by hash), as many as leave less
  than the least overlap that any partner can ask for.  A pair that reaches the limit
  shares such an element, at a place that still leaves its own overlap in both; pairs
  whose places don't, or whose sizes differ too much, are not made.

Nothing is estimated here, so no link is lost.  Where more than CROWDED pairs of a list of
one element are left, or it has more than WIDE members, its sets are compared in memory by
`connect`, which gives a link less than members.  A list of more than SETS_BYTES is taken on
in another round, led by the member that differs least; such a list lacks the pivots before,
so the rounds end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, table
from .packed import ROWS, batch, by_bucket, deal, joined, pack
from .shingles import mix

#: Pairs that a list passes on, and members that it compares in memory.
CROWDED, WIDE = 1200, 4096
#: Bytes of sets behind one bucket of differences.
BUCKET_BYTES = 16 << 20
#: Entries that a task holds before it passes on those of lists that are too large anyway; members of a family that its pivot is chosen by.
HELD, RANKED = 4_000_000, 50_000
#: Sets that are compared in memory.
SETS_BYTES = 48 << 20

MET = "kind int, value long, a long, b long"
LINK, PAIR, LISTED = 0, 1, 2


def without(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What x has and y lacks; both sorted and distinct."""
    if not len(y):
        return x
    return x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x]


def _ceil(a: np.ndarray | int, b: int) -> np.ndarray | int:
    return -(-a // b)


def _differences(percent: int, buckets: int):
    """Packed entries of members' differences by bucket, and links to the pivot, of rows (list, id, pivot, set, pivot's set)."""
    k, m = 100 + percent, 100 - percent

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near: list[tuple[int, int]] = []
            elements, facts = [], []
            for of, i, p, sx, sp in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3), b.column(4), strict=True):
                x, y = np.frombuffer(sx.as_buffer(), np.uint64), np.frombuffer(sp.as_buffer(), np.uint64)
                more, less = without(x, y), without(y, x)
                far = len(more) + len(less)
                excess = k * far - m * len(x)
                inside = excess <= m * len(y)
                if inside:
                    near.append((i, p))
                    partner = m * len(y) + 1  # only outsiders are partners
                else:
                    partner = max(-m * len(y), excess - 200 * m * len(x) // percent)
                need = max(1, _ceil(excess + partner, 2 * k))
                listed = far - need + 1
                if listed > 0:
                    elements.append(np.concatenate([more, less])[:listed])
                    facts.append((i, of, far, len(x), inside))
            rows = []
            if near:
                links = np.array(near, np.int64)
                rows.append((int(mix(links[:1, 0].view(np.uint64))[0] % np.uint64(buckets)), pack({"a": links[:, 0], "b": links[:, 1]})))
            if facts:
                n = np.array([len(e) for e in elements])
                value = np.concatenate(elements)
                fact = np.array(facts, np.int64)
                of, place = np.repeat(fact[:, 1], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                key = mix(value + mix(of.view(np.uint64)))
                cols = {"key": key, "id": np.repeat(fact[:, 0], n), "place": place.astype(np.int32), "far": np.repeat(fact[:, 2], n).astype(np.int32), "n": np.repeat(fact[:, 3], n).astype(np.int32), "inside": np.repeat(fact[:, 4], n).astype(bool)}
                rows += [(at, pack(c)) for at, c in deal((key % np.uint64(buckets)).astype(np.int64), cols)]
            yield batch(rows)

    return work


def _shared(percent: int):
    """Links as they came, pairs that share an element, and lists that are left for the next round."""
    k, m = 100 + percent, 100 - percent

    def out(kind: int, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(value), pa.array(a), pa.array(b)], names=["kind", "value", "a", "b"])

    def listed(x: dict[str, np.ndarray], which: np.ndarray) -> pa.RecordBatch:
        return out(LISTED, x["key"][which].view(np.int64), x["id"][which], x["far"][which].astype(np.int64))

    def meet(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        entries, rows, most, over = [], 0, HELD, np.zeros(0, np.uint64)
        for p in parts:
            if "key" not in p:
                yield out(LINK, np.zeros(len(p["a"]), np.int64), p["a"], p["b"])
                continue
            if len(over):
                hot = np.isin(p["key"], over)
                yield listed(p, hot)
                p = {c: v[~hot] for c, v in p.items()}
            entries.append(p)
            rows += len(p["key"])
            if rows > most:
                x = joined(entries)
                kinds, inverse, n = np.unique(x["key"], return_inverse=True, return_counts=True)
                hot = (n > WIDE)[inverse]
                yield listed(x, hot)
                over = np.append(over, kinds[n > WIDE])
                entries = [{c: v[~hot] for c, v in x.items()}]
                rows = len(entries[0]["key"])
                most = max(HELD, 2 * rows)
        x = joined(entries)
        if x and len(x["key"]):
            for found in _pairs(x, percent, k, m):
                yield out(*found)

    return meet


def _pairs(x: dict[str, np.ndarray], percent: int, k: int, m: int) -> list[tuple]:
    order = np.lexsort((x["id"], x["inside"], x["key"]))  # a list's outsiders come first
    key = x["key"][order]
    head = np.append(True, key[1:] != key[:-1])
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(key)))
    open_ = (size > 1) & ~x["inside"][order][start]  # a list of insiders only has nothing to find
    keep = np.repeat(open_, size)
    order, size = order[keep], size[open_]
    if not len(order):
        return []
    x = {c: v[order] for c, v in x.items()}
    group = np.repeat(np.arange(len(size)), size)
    end = np.repeat(np.cumsum(size), size)
    excess = k * x["far"].astype(np.int64) - m * x["n"].astype(np.int64)
    room, n = x["far"].astype(np.int64) - x["place"], x["n"].astype(np.int64)
    wide = size > WIDE
    left, right = [], []
    made = np.where(wide, CROWDED + 1, 0)
    i = np.flatnonzero(~x["inside"])
    step = 1
    while len(i):
        i = i[(i + step < end[i]) & (made[group[i]] <= CROWDED)]
        j = i + step
        need = np.maximum(1, _ceil(excess[i] + excess[j], 2 * k))
        ok = (room[i] >= need) & (room[j] >= need) & (percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])) & (x["id"][i] != x["id"][j])
        left.append(i[ok])
        right.append(j[ok])
        made += np.bincount(group[i[ok]], minlength=len(size))
        step += 1
    i, j = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
    crowded = made > CROWDED
    few = ~crowded[group[i]]
    a, b = x["id"][i[few]], x["id"][j[few]]
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    on = crowded[group]
    return [(PAIR, np.zeros(len(both), np.int64), both[:, 0].copy(), both[:, 1].copy()), (LISTED, x["key"][on].view(np.int64), x["id"][on], x["far"][on].astype(np.int64))]


def connect(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of indices that connect all pairs of sets that reach percent: a leader is compared with all sets, and all outside the largest component lead."""
    m = len(sets)
    n = np.array([len(x) for x in sets], np.int64)
    owner, flat = np.repeat(np.arange(m), n), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    head = np.append(True, flat[1:] != flat[:-1])
    kinds, start = flat[head], np.flatnonzero(head)
    stop = np.append(start[1:], len(flat))
    size = stop - start
    at = [np.searchsorted(kinds, x) for x in sets]
    central = np.array([int(size[x].sum()) for x in at])
    part, links, led = np.arange(m), [], np.zeros(m, bool)
    while True:
        largest = np.bincount(part).argmax()
        waiting = np.flatnonzero(~led & (part != largest)) if led.any() else np.arange(m)
        if not len(waiting):
            return links
        i = int(waiting[central[waiting].argmax()])
        led[i] = True
        shared = at[i][size[at[i]] > 1]
        both = np.bincount(np.concatenate([owner[start[e] : stop[e]] for e in shared.tolist()]), minlength=m) if len(shared) else np.zeros(m, np.int64)
        for j in np.flatnonzero(100 * both >= percent * (n[i] + n - both)).tolist():
            if part[j] != part[i] and both[j]:
                links.append((i, j))
                part[part == part[j]] = part[i]


def _connected(percent: int):
    """Links (a, b) of rows (value, id, set) sorted by value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        at = None

        def out() -> pa.RecordBatch:
            links = connect([x for _, x in held], percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[k[c]][0] for k in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

        for b in batches:
            for value, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if value != at and held:
                    yield out()
                    held.clear()
                at = value
                held.append((i, np.frombuffer(x.as_py(), np.uint64)))
        yield out()

    return work


def _families(lists: DataFrame) -> DataFrame:
    """value, id: the members of lists(value, id, rank) by family, which has the name of a member of high rank."""
    central = F.struct("rank", (-F.col("id")).alias("back"), F.col("id").alias("head"))
    heads = lists.groupBy("value").agg(F.max(central).alias("h"))
    known = lists.join(heads, "value").groupBy("id").agg(F.max("h").alias("h"))
    votes = lists.join(known, "id").groupBy("value", "h").agg(F.count(F.lit(1)).alias("votes"))
    chosen = votes.groupBy("value").agg(F.max(F.struct("votes", "h")).alias("v")).select("value", F.col("v.h.head").alias("head"))
    named = lists.join(chosen, "value")
    return named.select(F.col("head").alias("value"), "id").unionByName(named.select(F.col("head").alias("value"), F.col("head").alias("id"))).distinct()


def _with_pivots(families: DataFrame, sketches: DataFrame, buckets: int) -> DataFrame:
    """value, id, pivot: each family(value, id) is led by the member whose values of sketches(id, sk) most of its members have.

    Of a family of more than RANKED members an even part is looked at; any pivot is right, a central one is fast."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, id_, values = b.column(0).to_numpy(), b.column(1).to_numpy(), [np.frombuffer(x, "<u4") for x in b.column(2).to_pylist()]
            n = np.array([len(x) for x in values], np.int64)
            if len(n):
                value, id_ = np.repeat(value, n), np.repeat(id_, n)
                key = mix(np.concatenate(values).astype(np.uint64) + mix(value.view(np.uint64)))
                yield batch([(k, pack(c)) for k, c in deal((key % np.uint64(buckets)).astype(np.int64), {"key": key, "value": value, "id": id_})])

    def summed(x: dict[str, np.ndarray], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((x["id"], x["value"]))
        value, id_ = x["value"][order], x["id"][order]
        new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (id_[1:] != id_[:-1])))
        return value[new], id_[new], np.add.reduceat(times[order], new)

    def count(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = joined(list(parts))
        _, inverse, times = np.unique(x["key"], return_inverse=True, return_counts=True)
        value, id_, rank = summed(x, times[inverse])
        yield batch([(k, pack(c)) for k, c in deal((mix(id_.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), {"value": value, "id": id_, "rank": rank})])

    def add(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = joined(list(parts))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in summed(x, x["rank"])], names=["value", "id", "rank"])

    part = F.ceil(F.col("n") / RANKED)
    ranked = families.join(families.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value").where(F.pmod(F.xxhash64("id"), part) == 0)
    sent = ranked.join(sketches, "id").select("value", "id", "sk").mapInArrow(lean(send), ROWS)
    ranks = by_bucket(by_bucket(sent, buckets, count, ROWS), buckets, add, "value long, id long, rank long")
    best = ranks.groupBy("value").agg(F.max(F.struct("rank", (-F.col("id")).alias("back"), "id")).alias("h")).select("value", F.col("h.id").alias("pivot"))
    return families.join(best, "value", "left").withColumn("pivot", F.coalesce("pivot", "value")).where("id <> pivot")


def _crowded(lists: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of lists(value, id, far): value, id, set of those to compare in memory; value, id, pivot of those that are too large. Of lists with the same members one is left."""
    sized = lists.join(sets.select("id", F.length("set").cast("long").alias("size")), "id")
    heads = sized.groupBy("value").agg(F.min(F.struct("far", "id")).alias("h"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members"))
    one = table(heads.groupBy("mark", "members", "bytes").agg(F.min(F.struct("value", F.col("h.id").alias("pivot"))).alias("v")).select("v.value", "v.pivot", "bytes"), "crowded")
    chosen = lists.join(one, "value")
    small = chosen.where(F.col("bytes") <= SETS_BYTES).select("value", "id").join(sets, "id").select("value", "id", "set")
    return small, chosen.where((F.col("bytes") > SETS_BYTES) & (F.col("id") != F.col("pivot"))).select("value", "id", "pivot")


def long_list_pairs(lists: DataFrame, sets: DataFrame, sketches: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and pairs (a, b) to verify, which together connect what the pairs within lists(value, id, rank) connect.

    rank: about how central a member is; sets(id, set) and sketches(id, sk) have every member."""
    percent, links, pairs = round(limit * 100), [], []
    n = partitions(lists.sparkSession)
    listings = lists.count()  # lists is a table
    lists = _with_pivots(table(_families(lists), "families", 2 * listings), sketches, n)
    while True:
        lists = table(lists, "pivots", 2 * listings)
        volume = lists.join(sets.select("id", F.length("set").cast("long").alias("size")), "id").agg(F.sum("size")).first()[0] or 0
        buckets = max(n, -(-volume // BUCKET_BYTES))
        both = lists.join(sets, "id").join(sets.select(F.col("id").alias("pivot"), F.col("set").alias("other")), "pivot")
        sent = both.select("value", "id", "pivot", "set", "other").mapInArrow(lean(_differences(percent, buckets)), ROWS)
        out = table(by_bucket(sent, buckets, _shared(percent), MET), "pivot-links")
        links.append(out.where(F.col("kind") == LINK).select("a", "b"))
        pairs.append(out.where(F.col("kind") == PAIR).select("a", "b"))
        again = out.where(F.col("kind") == LISTED).select("value", F.col("a").alias("id"), F.col("b").alias("far"))
        if again.isEmpty():
            break
        listings = again.count()
        small, lists = _crowded(again, sets)
        links.append(table(small.repartition("value").sortWithinPartitions("value").mapInArrow(lean(_connected(percent)), "a long, b long"), "crowded-links"))
        if lists.isEmpty():
            break
    return reduce(DataFrame.unionByName, links), reduce(DataFrame.unionByName, pairs).distinct()
