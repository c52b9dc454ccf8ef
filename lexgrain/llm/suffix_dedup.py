"""Suffix-array dedup: removes what a WINDOW-byte string covers that also starts earlier.

Only suffixes at anchors are moved.  A window's anchor is the leftmost of its GRAM-byte
grams with the least hash, so equal windows have their anchors at the same place, and a
gram's windows are a stretch of starts around it.  Four steps:

1. Anchors whose gram occurs once in the corpus can't have equal windows: gram hashes are
   counted over all documents and the repeated ones go back to their documents.
2. Splitters from a sample of grams range-partition the suffixes at repeated anchors by
   their leading bytes; a suffix takes along the bytes of all its windows.  Suffixes that
   repeat within a task with all their bytes are settled there, and only the first is sent.
3. Buckets sort suffixes by their leading gram.  Of suffixes equal in all their bytes only
   the first stays in the sort.  Where different suffixes share a gram, their windows are
   sorted by multikey quicksort, eight bytes a key, tied windows on to the next key.  Windows
   still tied are equal; all but the first in (doc_id, hash of the text, start) order are removed.
   Splitters are whole grams, so neighbours across a boundary differ in their gram.
4. Each document gets its removed stretches and is cut.

A gram that the sample shows to fill a good part of a bucket is split: its windows are
dealt one by one, by two independent 64-bit hashes, which then decide equality.

Results for odd input: a null or empty text has no bytes and loses none; texts shorter
than a window lose none; an empty table gives an empty result; rows that share an
identifier are documents of their own, in order of a hash of their text, and rows that repeat
both are one and cut alike; null identifiers are before all others; very long texts go in
overlapping pieces; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, marked, partitions, table
from .packed import ROWS, batch, by_bucket, deal, joined, pack
from .shingles import _ODD, mix

WINDOW, GRAM = 100, 32
#: Bytes of text worked on at once (their hashes stay in a core's cache), and of a long text's pieces; text behind one bucket, and behind one that gathers by row.
AT_ONCE, PIECE, BUCKET_BYTES, ROW_BYTES = 1 << 16, 1 << 20, 6 << 20, 24 << 20
#: Anchors, and bytes of suffixes, that a task collects before it deals them: with many buckets a packed row still holds many.
ASKED, HELD = 1_000_000, 8 << 20
#: Grams sampled for each bucket, and how many of them make a gram heavy.
SAMPLE, HEAVY = 96, 24
#: Windows that are sorted at once.
SORTED = 400_000
NULL_ID = -(1 << 63)

_BYTE = [mix(np.arange(256, dtype=np.uint64) * np.uint64(2) + np.uint64(s)) for s in (11, 0x5EED0000)]
_BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_PLACE = np.uint64((1 << 28) - 1)


def _double(h: np.ndarray, n: int, m: int, tail: np.ndarray, base: int) -> np.ndarray:
    """Hashes of n + m bytes from those of n and of m; none if there are fewer bytes."""
    return h[: max(len(tail) - n, 0)] * np.uint64(pow(base, m, 1 << 64)) + tail[n:]


@dataclass
class Chunk:
    """Texts, or a piece of one, laid end to end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # row of the batch
    base: int = 0  # where the piece starts in its text

    def grams(self, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of each gram, and of each four bytes; spread well in the high bits only."""
        b = _BASE[which]
        h = four = _BYTE[which][self.data]
        n = 1
        while n < GRAM:
            h = _double(h, n, n, h, b)
            n *= 2
            if n == 4:
                four = h
        return h, four

    def hashes(self, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of each gram and of each window."""
        b = _BASE[which]
        h, four = self.grams(which)
        two = _double(h, 32, 32, h, b)
        three = _double(two, 64, 32, h, b) if len(h) > 64 else h[:0]
        whole = _double(three, 96, 4, four, b) if len(four) > 96 else h[:0]
        return mix(h), mix(whole)

    def runs(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of windows with one anchor: anchor, first window, last window, text."""
        if len(self.data) < WINDOW:
            return (np.zeros(0, np.int64),) * 4
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        span, n = WINDOW - GRAM + 1, 1
        while n * 2 <= span:
            key = np.minimum(key[: len(key) - n], key[n:])
            n *= 2
        if span > n:
            key = np.minimum(key[: len(key) - (span - n)], key[span - n :])
        anchor = (key & _PLACE).astype(np.int64)  # of every window
        # runs end where the anchor changes, and where a text's windows begin and end
        edges = np.concatenate([self.starts, np.maximum(self.ends - WINDOW + 1, self.starts)])
        new = np.zeros(len(anchor) + 1, bool)
        new[1:-1] = anchor[1:] != anchor[:-1]
        new[edges[edges < len(anchor)]] = True
        new[0] = new[-1] = True
        first = np.flatnonzero(new)
        first, last = first[:-1], first[1:] - 1
        text = np.searchsorted(self.starts, first, "right") - 1
        inside = first + WINDOW <= self.ends[text]
        first, last, text = first[inside], last[inside], text[inside]
        return anchor[first], first, last, text


def chunks(texts: pa.Array) -> Iterator[Chunk]:
    texts = texts.cast(pa.large_binary()) if texts.null_count == 0 else pa.array([x or b"" for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        to = min(to, len(texts))
        a, b = int(offsets[at]), int(offsets[to])
        if b - a <= PIECE:
            yield Chunk(data[a:b], offsets[at:to] - a, offsets[at + 1 : to + 1] - a, np.arange(at, to))
        else:
            for s in range(a, b - WINDOW + 1, PIECE):
                e = min(s + PIECE + WINDOW - 1, b)
                yield Chunk(data[s:e], np.array([0]), np.array([e - s]), np.array([at]), s - a)
        at = to


def _grams_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The grams at places, as byte strings that sort as bytes do."""
    if not len(at):
        return np.zeros(0, f"S{GRAM}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)[at]).view(f"S{GRAM}").ravel()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash; ascending hashes have ascending buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _spread(row: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that gathers what is known of a row."""
    return (mix(row.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _spans(doc: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Removed stretches of bytes, of stretches of windows, packed by row."""
    return [(k, pack(c)) for k, c in deal(_spread(row, buckets), {"doc": doc, "row": row, "a": first.astype(np.int64), "b": last.astype(np.int64) + WINDOW})]


def _stretches(keep: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of kept rows whose `at` counts up by one within a group."""
    i = np.flatnonzero(keep)
    if not len(i):
        return i, i
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (at[i[1:]] != at[i[:-1]] + 1) | (group[i[1:]] != group[i[:-1]])
    first = np.flatnonzero(new)
    return i[first], i[np.append(first[1:], len(i)) - 1]


def repeated_grams(docs: DataFrame, buckets: int, by_row: int) -> DataFrame:
    """row, blob (hashes h of the anchors of docs(row, text) whose gram occurs elsewhere too), in by_row parts."""

    def asked(h: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h)
        h, row = h[order], row[order]
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(heads, len(h)))
        rows = [(k, pack(cols)) for k, cols in deal(_bucket(h[heads], buckets), {"h": h[heads], "row": row[heads], "many": n > 1})]
        here = np.repeat(n > 1, n)  # known to repeat without asking
        return batch(rows + [(k, pack(cols)) for k, cols in deal(_spread(row[here], buckets), {"row": row[here], "known": h[here]})])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for c in chunks(b.column(1)):
                grams, _ = c.grams()
                anchor, _, _, text = c.runs(grams)
                if len(anchor):
                    held.append((mix(grams[anchor]), ids[c.rows[text]]))
                    n += len(anchor)
                if n >= ASKED:
                    yield asked(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            yield asked(*map(np.concatenate, zip(*held, strict=True)))

    def meet(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        firsts, known = [], []
        for p in parts:
            (known if "known" in p else firsts).append(p)
        if firsts:
            a = joined(firsts)
            order = np.argsort(a["h"])
            h, row, many = a["h"][order], a["row"][order], a["many"][order]
            same = h[1:] == h[:-1]
            twice = np.zeros(len(h), bool)
            twice[1:] |= same
            twice[:-1] |= same
            keep = twice & ~many
            known.append({"row": row[keep], "known": h[keep]})
        if known:
            x = joined(known)
            yield batch([(k, pack(cols)) for k, cols in deal(_spread(x["row"], by_row), x)])

    def gather(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = joined(list(parts))
        out = [(r, np.unique(cols["known"]).tobytes()) for r, cols in deal(x["row"], {"known": x["known"]})]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([y for _, y in out], pa.binary())], names=["row", "blob"])

    return by_bucket(by_bucket(docs.mapInArrow(lean(send), ROWS), buckets, meet, ROWS), by_row, gather, "row long, blob binary")


def splitters(docs: DataFrame, buckets: int, total: int) -> tuple[np.ndarray, set[bytes]]:
    """Leading grams that part the buckets, and heavy grams, of at most about SAMPLE * buckets sampled grams."""
    want = SAMPLE * buckets
    share = min(1.0, want * (WINDOW - GRAM + 2) / 2 / max(total, 1))
    rate = share * 4 if share < 0.25 else share

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy().view(np.uint64)
            for c in chunks(b.column(1)):
                anchor = c.runs(c.grams()[0])[0]
                # a gram's place in the sample rests on where it lies, so that frequent grams are drawn often
                drawn = mix(anchor.astype(np.uint64) + mix(keys[c.rows[:1]] + np.uint64(c.base))) >> np.uint64(32) < np.uint64(rate * (1 << 32))
                yield pa.RecordBatch.from_arrays([pa.array(_grams_at(c.data, anchor[drawn]).tolist(), pa.binary())], names=["g"])

    # of a small share, a quarter of the documents is read, and more of each
    part = docs.where(F.pmod(F.xxhash64(F.lit("grams"), "row"), F.lit(4)) == 0) if share < 0.25 else docs
    got = np.array(sorted(r["g"] for r in part.mapInArrow(lean(take), "g binary").collect()), f"S{GRAM}")
    if not len(got):
        return got, set()
    kinds, n = np.unique(got, return_counts=True)
    cuts = np.unique(got[(np.arange(1, buckets) * len(got)) // buckets])
    return cuts, {bytes(k).ljust(GRAM, b"\0") for k in kinds[n >= max(4, HEAVY * len(got) / want)]}


def _run_hash(grams: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Of all bytes of stretches of windows, and of their anchors' places."""
    h = ((last - first) * WINDOW + anchor - first).astype(np.uint64)
    for i, at in enumerate((0, GRAM, 2 * GRAM, WINDOW - GRAM)):  # a window's grams cover it, its first and last window a stretch
        h += grams[first + at] * _ODD[2 * i] + grams[last + at] * _ODD[2 * i + 1]
    return mix(h)


def _repeated(x: dict[str, np.ndarray], begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that equal an earlier one in all their bytes, and those that are another one in a repeated row."""
    order = np.argsort(x["hash"])
    h = x["hash"][order]
    tied = np.zeros(len(h), bool)
    tied[1:] = h[1:] == h[:-1]
    tied[:-1] |= tied[1:]
    who = order[tied]
    who = who[np.lexsort((x["start"][who], x["row"][who], x["doc"][who], x["hash"][who]))]
    head = np.append(True, x["hash"][who[1:]] != x["hash"][who[:-1]])[: len(who)]
    least = who[head][np.cumsum(head) - 1]
    who, least = who[~head], least[~head]
    ok = (size[who] == size[least]) & (x["anchor"][who] == x["anchor"][least])
    who, least = who[ok], least[ok]
    if not len(who):
        return who, who
    a, b, last = begin[who], begin[least], size[who] - WINDOW
    ok = _same(x["bytes"], a, b) & _same(x["bytes"], a + last, b + last)  # the first and the last window cover all
    who, least = who[ok], least[ok]
    itself = (x["row"][who] == x["row"][least]) & (x["start"][who] == x["start"][least])
    return who[~itself], who[itself]


def _dealt_windows(x: dict[str, np.ndarray], begin: np.ndarray, some: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Windows of some suffixes, each by its hash; equal ones but the first are settled."""
    n = x["n"][some].astype(np.int64)
    long = n + WINDOW - 1
    data = _slices(x["bytes"], begin[some], long)
    c = Chunk(data, np.cumsum(long) - long, np.cumsum(long), some)
    at = _expand(c.starts, n)
    place, doc, row = _expand(x["start"][some], n), np.repeat(x["doc"][some], n), np.repeat(x["row"][some], n)
    h, h2 = c.hashes()[1][at], c.hashes(1)[1][at]
    order = np.lexsort((place, row, doc, h2, h))
    at, place, doc, row, h, h2 = (y[order] for y in (at, place, doc, row, h, h2))
    head = np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))
    least = np.flatnonzero(head)[np.cumsum(head) - 1]
    same = ~head
    same[same] = _same(data, at[same], at[least[same]])
    later = np.flatnonzero(same & ((row != row[least]) | (place != place[least])))
    later = later[np.lexsort((place[later], row[later]))]
    s, e = _stretches(np.ones(len(later), bool), place[later], row[later])
    rows = _spans(doc[later[s]], row[later[s]], place[later[s]], place[later[e]], buckets)
    cols = {"h": h[~same], "h2": h2[~same], "doc": doc[~same], "row": row[~same], "at": place[~same].astype(np.int64)}
    return rows + [(k, pack(y)) for k, y in deal(_bucket(cols["h"], buckets), cols)]


def suffixes(docs: DataFrame, cuts: np.ndarray, heavy: set[bytes], buckets: int) -> DataFrame:
    """Packed suffixes of docs(doc, text, row, blob) at repeated anchors, by bucket; and what a task has settled itself."""
    shared = docs.sparkSession.sparkContext.broadcast((cuts, np.array(sorted(heavy), f"S{GRAM}")))  # SAMPLE * buckets grams at most

    def dealt(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        cuts, heavy = shared.value
        size = x["n"].astype(np.int64) + WINDOW - 1
        begin = np.cumsum(size) - size
        # of equal suffixes all but the first are settled
        later, same = _repeated(x, begin, size)
        rows = _spans(x["doc"][later], x["row"][later], x["start"][later], x["start"][later] + x["n"][later] - 1, buckets)
        left = np.ones(len(size), bool)
        left[later] = left[same] = False
        left = np.flatnonzero(left)
        leads = _grams_at(x["bytes"], begin[left] + x["anchor"][left])
        hot = np.isin(leads, heavy)
        if hot.any():
            rows += _dealt_windows(x, begin, left[hot], buckets)
        left, leads = left[~hot], leads[~hot]
        k = np.searchsorted(cuts, leads, "right")
        order = np.argsort(k, kind="stable")
        left, k = left[order], k[order]
        cols = {name: x[name][left] for name in ("doc", "row", "start", "n", "anchor", "hash")}
        data = _slices(x["bytes"], begin[left], size[left])
        ends = np.append(0, np.cumsum(size[left]))
        cut = [*np.flatnonzero(np.append(True, k[1:] != k[:-1])).tolist(), len(k)] if len(k) else []
        for s, e in pairwise(cut):
            rows.append((int(k[s]), pack({name: y[s:e] for name, y in cols.items()} | {"bytes": data[ends[s] : ends[e]]})))
        return batch(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ids, keys, blobs = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
            for c in chunks(b.column(1)):
                grams, _ = c.grams()
                anchor, first, last, text = c.runs(grams)
                # a gram that repeats is known to all its documents
                keep = np.isin(mix(grams[anchor]), np.frombuffer(b"".join(blobs[c.rows[0] : c.rows[-1] + 1]), np.uint64))
                if not keep.any():
                    continue
                anchor, first, last, text = anchor[keep], first[keep], last[keep], text[keep]
                many = last - first + 1
                of = c.rows[text]
                data = _slices(c.data, first, many + WINDOW - 1)
                cols = {"doc": ids[of], "row": keys[of], "start": first - c.starts[text] + c.base, "n": many.astype(np.int32), "anchor": (anchor - first).astype(np.int32)}
                held.append(cols | {"hash": _run_hash(grams, first, last, anchor), "bytes": data})
                n += len(data)
                if n >= HELD:
                    yield dealt(joined(held))
                    held, n = [], 0
        if held:
            yield dealt(joined(held))

    return docs.mapInArrow(lean(send), ROWS)


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n places for each."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _slices(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bytes from each start, end to end."""
    raw = data.tobytes()
    return np.frombuffer(b"".join([raw[a:b] for a, b in zip(start.tolist(), (start + n).tolist(), strict=True)]), np.uint8)


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at each place, as a number that sorts as they do."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8").ravel().astype(np.uint64)


def _same(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two windows are equal in all their bytes."""
    out = np.ones(len(x), bool)
    for at in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        out &= _word(data, x + at) == _word(data, y + at)
    return out


def multikey_sort(data: np.ndarray, at: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (indices of at) that have an equal one, and the group of each, ascending; lead is a key that equal windows share.

    Multikey quicksort by lead, then by eight bytes at a time: ties go on to the next key, and only groups that a key divides are sorted by it."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(">u8").ravel().astype(np.uint64) if len(data) >= 8 else np.zeros(0, np.uint64)
    who = np.argsort(lead)
    new = np.ones(len(who), bool)
    new[1:] = lead[who[1:]] != lead[who[:-1]]
    for off in [None, WINDOW - 8, *range(0, WINDOW - 8, 8)]:
        if off is not None:
            key = words[at[who] + off]
            group = np.cumsum(new) - 1
            odd = key != key[np.flatnonzero(new)][group]
            if not odd.any():
                continue
            flag = np.zeros(group[-1] + 1, bool)
            flag[group[odd]] = True
            part = np.flatnonzero(flag[group])
            order = part[np.lexsort((key[part], group[part]))]
            who[part], key[part] = who[order], key[order]  # groups keep their places
            new[1:] |= key[1:] != key[:-1]
        alone = new & np.append(new[1:], True)
        who, new = who[~alone], new[~alone]
        if not len(who):
            break
    return who, np.cumsum(new) - 1


def _later(group: np.ndarray, index: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows of each group (ascending) after the one with the least index; a repeated place isn't later than itself."""
    if not len(group):
        return np.zeros(0, bool)
    first = np.minimum.reduceat(index, np.flatnonzero(np.append(True, group[1:] != group[:-1])))[group]
    return (row[index] != row[first]) | (place[index] != place[first])


def _sort_bucket(parts: Iterator[dict[str, np.ndarray]], by_row: int) -> Iterator[pa.RecordBatch]:
    settled, sent, hot = [], [], []
    for p in parts:
        (settled if "a" in p else hot if "h2" in p else sent).append(p)

    def remove(doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        order = np.lexsort((place, row))
        doc, row, place = doc[order], row[order], place[order]
        s, e = _stretches(np.ones(len(row), bool), place, row)
        settled.append({"doc": doc[s], "row": row[s], "a": place[s].astype(np.int64), "b": place[e].astype(np.int64) + WINDOW})

    if hot:
        x = joined(hot)
        x = {k: v[np.lexsort((x["at"], x["row"], x["doc"]))] for k, v in x.items()}
        order = np.lexsort((x["h2"], x["h"]))
        h, h2 = x["h"][order], x["h2"][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        later = order[_later(np.cumsum(new) - 1, order, x["row"], x["at"])]
        remove(x["doc"][later], x["row"][later], x["at"][later])
    if sent:
        x = joined(sent)
        size = x["n"].astype(np.int64) + WINDOW - 1
        begin = np.cumsum(size) - size
        # equal suffixes are one in the sort
        later, same = _repeated(x, begin, size)
        settled.append({"doc": x["doc"][later], "row": x["row"][later], "a": x["start"][later], "b": x["start"][later] + x["n"][later] - 1 + WINDOW})
        order = np.ones(len(size), bool)
        order[later] = order[same] = False
        order = np.flatnonzero(order)
        leads = _grams_at(x["bytes"], begin[order] + x["anchor"][order])
        by = np.lexsort((x["start"][order], x["row"][order], x["doc"][order], leads))
        order, leads = order[by], leads[by]
        new = np.ones(len(order), bool)
        new[1:] = leads[1:] != leads[:-1]
        alone = new & np.append(new[1:], True)
        order, new = order[~alone], new[~alone]
        cut = np.append(np.flatnonzero(new), len(order))
        windows = np.append(0, np.cumsum(x["n"][order]))
        at = 0
        while at < len(cut) - 1:  # whole groups of equal grams, about SORTED windows
            to = max(at + 1, int(np.searchsorted(windows[cut], windows[cut[at]] + SORTED, "right")) - 1)
            some = order[cut[at] : cut[to]]
            n, long = x["n"][some].astype(np.int64), size[some]
            place, doc, row = _expand(x["start"][some], n), np.repeat(x["doc"][some], n), np.repeat(x["row"][some], n)
            gram = np.repeat(np.cumsum(new[cut[at] : cut[to]]), n)
            offset = np.repeat(x["anchor"][some].astype(np.int64), n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            # windows come in (gram, doc, row, start) order; equal ones have their gram at one offset
            who, group = multikey_sort(x["bytes"][_expand(begin[some], long)], _expand(np.cumsum(long) - long, n), gram * WINDOW + offset)
            later = who[_later(group, who, row, place)]
            remove(doc[later], row[later], place[later])
            at = to
    if settled:
        x = joined(settled)
        yield batch([(k, pack(c)) for k, c in deal(_spread(x["row"], by_row), x)])


def _of_rows(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """doc, row, blob: all stretches of a row that go."""
    x = joined(list(parts))
    out = [(d, r, pack(y)) for r, c in deal(x["row"], {k: x[k] for k in ("doc", "a", "b")}) for d, y in deal(c.pop("doc"), c)]
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc", "row", "blob"])


def cut_texts(docs: DataFrame, spans: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of docs(doc_id, text, doc, row), and with texts the kept bytes; spans(doc, row, blob) say what goes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .packed import unpack

        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, blob in zip(b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                data = text.as_py() or b""
                n, removed = len(data), []
                if blob:
                    x = unpack(blob)
                    order = np.argsort(x["a"], kind="stable")
                    s, e = x["a"][order], np.maximum.accumulate(x["b"][order])
                    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                    removed = list(zip(s[new].tolist(), e[np.append(new[1:], len(e)) - 1].tolist(), strict=True))
                    parts, at = [], 0
                    for a, z in removed:
                        parts.append(data[at:a])
                        at = z
                    data = b"".join([*parts, data[at:]])
                for c, v in zip(cols, (n, n - len(data), len(removed), hashlib.sha256(data).hexdigest(), data), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays if texts else arrays[:-1], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if texts else 5])

    spans = table(spans, "suffix-spans")
    parted = marked(docs, spans.select("row"), "row")  # rows that lose nothing stay where they are
    whole = parted.where(~F.col("maybe")).select("doc_id", "text", F.lit(None).cast("binary").alias("blob"))
    touched = parted.where("maybe").join(spans, ["doc", "row"], "left").select("doc_id", "text", "blob")
    return whole.unionByName(touched).mapInArrow(lean(work), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def suffix_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with texts the kept bytes) of every row."""
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("doc_id"), "text", F.coalesce(id_, F.lit(NULL_ID)).alias("doc"), F.xxhash64(id_, "text").alias("row"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, by_row = (max(partitions(docs.sparkSession), -(-total // n)) for n in (BUCKET_BYTES, ROW_BYTES))
    cuts, heavy = splitters(rows.select("row", "text"), buckets, total)
    again = table(repeated_grams(rows.select("row", "text"), buckets, by_row), "suffix-grams")
    able = marked(rows.select("doc", "text", "row"), again.select("row"), "row").where("maybe").join(again, "row").select("doc", "text", "row", "blob")
    settled = by_bucket(suffixes(able, cuts, heavy, buckets), buckets, lambda parts: _sort_bucket(parts, by_row), ROWS)
    return cut_texts(rows, by_bucket(settled, by_row, _of_rows, "doc long, row long, blob binary"), texts)
