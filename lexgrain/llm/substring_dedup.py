"""Substring dedup by MinHash banding of paragraphs.

Paragraphs are the lines of LEAST words or more, and every stretch of `passage` words.

Lines get BANDS bands of ROWS_A_BAND minima over their word shingles: two of Jaccard
similarity 0.8 share a band with a probability of 0.9997.  Equal lines, by 128 bits of
digest, are one class; classes that share a band are joined (short lists in memory, long
ones by their differences from a pivot, as near_dedup does), verified by exact Jaccard over
full sets of shingles, and clustered by connected components, of which the first line stays.

Stretches overlap, so they get one minimum: that of the GRAM-word grams in them, leftmost of
ties, which equal stretches have at the same place.  Minima that occur once can't have equal
stretches and are dropped; stretches at the others are joined and compared by digest of all
their words, and all but the first of equal ones go; those within a line that goes anyway are not
compared.  So repeated passages of `passage` words
or more go whole, wherever they begin and end, also within longer lines and across lines.

"First" is by (doc_id, hash of the text, place).  Words are compared with A-Z lower-cased; a
removed stretch goes from its first word to its last, with the spaces that follow.  Shorter
repeats are left alone: of invented prose with common short lines they would touch a third
of the documents.

Results for odd input: null, empty and blank texts have no paragraphs and come back as they
are (null as empty); an empty table gives an empty result; rows that share an identifier are
documents of their own, in order of a hash of their text, and rows that repeat both are one
and cut alike; null identifiers are before all others; any identifier and any number of
lines will do; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lean, marked, partitions, table
from .components import components
from .near_dedup import link_lists, packed_sketch
from .packed import ROWS, batch, by_bucket, deal, joined, pack, unpack
from .packing import slices
from .shingles import _ODD, mix, word_hashes

LEAST, BANDS, ROWS_A_BAND = 16, 8, 2
#: Words of the grams whose minimum stands for a stretch.
GRAM = 16
#: Text worked on at once, and text behind one bucket.
AT_ONCE, BUCKET_BYTES = 2 << 20, 8 << 20
#: Order of null identifiers.
NULL_ID = -(1 << 63)
_PLACE = np.uint64((1 << 32) - 1)
_FACTOR = [mix(np.array([i + 1], np.uint64))[0] | np.uint64(1) for i in range(BANDS * ROWS_A_BAND)]
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Kinds of rows that meetings yield.
GONE, MEMBER, AGAIN = 0, 1, 2
MET = "kind int, bucket int, blob binary, doc long, row long, value long, unit int"


@dataclass
class Lines:
    """Lines of some texts: text, number in it, first word and the one after the last."""

    words: np.ndarray
    start: np.ndarray  # first word of each text, one more at the end
    text: np.ndarray
    number: np.ndarray
    a: np.ndarray
    b: np.ndarray


def lines_of(texts: pa.Array) -> Lines:
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    of = lines.offsets.to_numpy().astype(np.int64)
    of -= of[0]
    words, first = word_hashes(lines.flatten())
    text = np.repeat(np.arange(len(texts)), np.diff(of))
    return Lines(words, first[of], text, np.arange(len(text)) - of[:-1][text], first[:-1], first[1:])


def _digests(words: np.ndarray, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """Of the words from each a to b in order, from differences of one running polynomial."""
    n, base = len(words), _BASE[which]
    inverse = np.uint64(pow(base, -1, 1 << 64))
    power = np.cumprod(np.full(n + 1, np.uint64(base), np.uint64)) if n else np.ones(1, np.uint64)
    back = np.cumprod(np.full(n + 1, inverse, np.uint64)) if n else np.ones(1, np.uint64)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(which)) * power[:n], out=run[1:])
    return mix((run[b] - run[a]) * back[a] + (b - a).astype(np.uint64) * _ODD[3])


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        out += words[i : i + len(out)] * _ODD[i % len(_ODD)] + np.uint64(i // len(_ODD))
    return mix(out)


def _windows(words: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, gram's place and text of each window of size words within a text; and the grams."""
    grams, n = _shingles(words, GRAM), len(words) - size + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3 + (grams,)
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, k = size - GRAM + 1, 1
    while k * 2 <= span:
        key = np.minimum(key[: len(key) - k], key[k:])
        k *= 2
    if span > k:
        key = np.minimum(key[: len(key) - (span - k)], key[span - k :])
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return at, (key[at] & _PLACE).astype(np.int64), owner[at], grams


def _bands(u: Lines, which: np.ndarray, n: int) -> np.ndarray:
    """Band keys (lines x BANDS) of the given lines of n words or more."""
    a, size = u.a[which], u.b[which] - u.a[which] - n + 1
    if len(which) == 0:
        return np.zeros((0, BANDS), np.uint64)
    take = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
    s, at = _shingles(u.words, n)[take], np.cumsum(size) - size
    out = np.zeros((len(which), BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(len(which), np.uint64(k + 1))
        for r in range(ROWS_A_BAND):
            low = np.minimum.reduceat(s * _FACTOR[k * ROWS_A_BAND + r], at)
            key = mix(key * _ODD[2] + low)
        out[:, k] = key
    return out


def _spread(row: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that gathers what is known of a row."""
    return (mix(row.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _to_rows(columns: dict[str, np.ndarray], buckets: int, by: str = "row") -> list[tuple[int, bytes]]:
    return [(k, pack(c)) for k, c in deal(_spread(columns[by], buckets), columns)]


def _first_and_later(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each digest, and of the later ones; a repeated place isn't later than itself."""
    order = np.lexsort((at, row, doc, h2, h))
    head = np.append(True, (h[order[1:]] != h[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]]))[: len(order)]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return order[head], order[(doc[order] != doc[first]) | (row[order] != row[first]) | (at[order] != at[first])]


def _gram_rows(u: Lines, row: np.ndarray, size: int, buckets: int) -> list[tuple[int, bytes]]:
    """Minima of a slice's stretches by bucket, each once, and to its rows those that repeat in it."""
    _, anchor, text, grams = _windows(u.words, u.start, size)
    anchor, one = np.unique(anchor, return_index=True)
    g, of = grams[anchor], row[text[one]]
    kind, first, inv, n = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
    here = n[inv] > 1
    return _to_rows({"row": of[here], "again": g[here]}, buckets) + [(k, pack(c)) for k, c in deal((kind % np.uint64(buckets)).astype(np.int64), {"gram": kind, "row": of[first], "many": n > 1})]


def _send(docs: DataFrame, buckets: int, n: int, passage: int, line: int) -> DataFrame:
    """Packed digests and bands of lines, and minima of stretches, of docs(doc, row, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, AT_ONCE, 2):
                docs_, rows_ = (part.column(c).to_numpy() for c in (0, 1))
                u = lines_of(part.column(2))
                able = np.flatnonzero(u.b - u.a >= line)
                h, h2 = (_digests(u.words, u.a[able], u.b[able], w) for w in (0, 1))
                doc, row, unit = docs_[u.text[able]], rows_[u.text[able]], u.number[able].astype(np.int32)
                # of equal lines in this slice only the first is sent
                one, later = _first_and_later(h, h2, doc, row, unit)
                out = _to_rows({"doc": doc[later], "row": row[later], "gone": unit[later]}, buckets)
                out += _gram_rows(u, rows_, passage, buckets)
                cols = {"h": h, "h2": h2, "doc": doc, "row": row, "unit": unit}
                out += [(k, pack(c)) for k, c in deal((h[one] % np.uint64(buckets)).astype(np.int64), {c: v[one] for c, v in cols.items()})]
                para = one[(u.b - u.a)[able[one]] >= n]
                key = _bands(u, able[para], n).ravel()
                cols = {"key": key, **{c: np.repeat(v[para], BANDS) for c, v in cols.items() if c != "h2"}}
                for k, c in deal((key % np.uint64(buckets)).astype(np.int64), cols):
                    c["key"] = (c["key"] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].copy()
                    out.append((k, pack(c)))
                yield batch(out)

    return docs.mapInArrow(lean(work), ROWS)


def _met(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"kind": pa.int32(), "bucket": pa.int32(), "blob": pa.binary(), "doc": pa.int64(), "row": pa.int64(), "value": pa.int64(), "unit": pa.int32()}
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def _packed(kind: int, blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if blobs:
        yield _met(kind, bucket=[k for k, _ in blobs], blob=[x for _, x in blobs])


def _meet(buckets: int):
    """Lines that go (GONE, by row, packed), members of bands that more than one class shares (MEMBER), repeated minima (AGAIN, by row, packed)."""

    def meet(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        exact, bands, gone, again, asked = [], [], [], [], []
        for p in parts:
            (gone if "gone" in p else again if "again" in p else asked if "gram" in p else bands if "key" in p else exact).append(p)
        if exact:
            x = joined(exact)
            _, later = _first_and_later(x["h"], x["h2"], x["doc"], x["row"], x["unit"])
            gone.append({"doc": x["doc"][later], "row": x["row"][later], "gone": x["unit"][later]})
        if gone:
            yield from _packed(GONE, _to_rows(joined(gone), buckets))
        if asked:
            x = joined(asked)
            order = np.argsort(x["gram"], kind="stable")
            g = x["gram"][order]
            twice = np.zeros(len(g), bool)
            twice[1:] |= g[1:] == g[:-1]
            twice[:-1] |= g[1:] == g[:-1]
            keep = order[twice & ~x["many"][order]]
            again.append({"row": x["row"][keep], "again": x["gram"][keep]})
        if again:
            yield from _packed(AGAIN, _to_rows(joined(again), buckets))
        if bands:
            yield _members(joined(bands))

    return meet


def _members(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    wide = np.zeros((len(x["h"]), 8), np.uint8)
    wide[:, :5] = x["key"].reshape(-1, 5)
    key = wide.view(np.uint64).ravel()
    order = np.lexsort((x["unit"], x["row"], x["doc"], x["h"], key))
    key, h, doc, row, unit = (v[order] for v in (key, x["h"], x["doc"], x["row"], x["unit"]))
    new_key = np.append(True, key[1:] != key[:-1])
    new = new_key | np.append(True, h[1:] != h[:-1])
    classes = np.bincount(np.cumsum(new_key) - 1, new)
    keep = new & (classes[np.cumsum(new_key) - 1] > 1)  # the first line of each class
    return _met(MEMBER, doc=doc[keep], row=row[keep], value=key[keep].view(np.int64), unit=unit[keep])


def _grams_of_rows(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """row, blob: the repeated minima of a row, each once."""
    x = joined(list(parts))
    out = [(r, np.unique(c["again"]).tobytes()) for r, c in deal(x["row"], {"again": x["again"]})]
    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([g for _, g in out], pa.binary())], names=["row", "blob"])


def _removals_of_rows(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """doc, row, blob: what goes of a row, lines by number or stretches."""
    x = joined(list(parts))
    out = [(d, r, pack(y)) for r, c in deal(x["row"], {k: v for k, v in x.items() if k != "row"}) for d, y in deal(c.pop("doc"), c)]
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc", "row", "blob"])


def _stretches(doc: np.ndarray, row: np.ndarray, at: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The stretches of words of each row, from a to b, of windows that begin at `at`."""
    order = np.lexsort((at, doc, row))
    doc, row, at = doc[order], row[order], at[order].astype(np.int64)
    apart = np.append(True, (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(at) > 1))[: len(at)]
    new = np.flatnonzero(apart)
    return {"doc": doc[new], "row": row[new], "a": at[new], "b": at[np.append(new[1:], len(at))[: len(new)] - 1] + size}


PLACED = "bucket int, blob binary, doc long, row long, id long, unit int, n long, sk binary, set binary"


def _second(docs: DataFrame, asks: DataFrame, buckets: int, size: int, n: int) -> DataFrame:
    """Of docs(doc, row, text): packed windows at the repeated minima, and sets of the wanted lines; asks(row, blobs, gone, lines) has both, and the lines that go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, AT_ONCE, 2):
                docs_, rows_ = (part.column(c).to_numpy() for c in (0, 1))
                blobs, gone, wanted = (part.column(c).to_pylist() for c in (3, 4, 5))
                u = lines_of(part.column(2))
                line_at = np.searchsorted(u.text, np.arange(part.num_rows))
                going = np.zeros(len(u.text), bool)
                for t, some in enumerate(gone):
                    for x in some:
                        going[line_at[t] + unpack(x)["gone"]] = True
                at, anchor, text, g = _windows(u.words, u.start, size)
                keep, cut = np.zeros(len(at), bool), np.searchsorted(text, np.arange(part.num_rows + 1))
                for t, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if y > x and blobs[t]:
                        keep[x:y] = np.isin(g[anchor[x:y]], np.frombuffer(b"".join(blobs[t]), np.uint64))
                line = np.repeat(np.arange(len(u.a)), u.b - u.a)
                if len(at):
                    keep &= ~(going[line[at]] & (line[at] == line[at + size - 1]))
                at, text = at[keep], text[keep]
                h, h2 = _digests(u.words, at, at + size), _digests(u.words, at, at + size, 1)
                doc, row, place = docs_[text], rows_[text], (at - u.start[text]).astype(np.int32)
                one, later = _first_and_later(h, h2, doc, row, place)
                out = _to_rows(_stretches(doc[later], row[later], place[later], size), buckets)
                cols = {"h": h[one], "h2": h2[one], "doc": doc[one], "row": row[one], "at": place[one]}
                out += [(k, pack(c)) for k, c in deal((h[one] % np.uint64(buckets)).astype(np.int64), cols)]
                s = _shingles(u.words, n)
                for t, some in enumerate(wanted):
                    for x in some:
                        i = int(line_at[t]) + x["unit"]
                        if i < len(u.text) and u.text[i] == t and u.b[i] - u.a[i] >= n:
                            v = np.unique(s[u.a[i] : u.b[i] - n + 1])
                            out.append((x["id"] % buckets, pack({"line": np.array([docs_[t], rows_[t], x["id"], x["unit"]]), "set": v})))
                yield batch(out)

    return docs.join(asks, "row").select("doc", "row", "text", "blobs", "gone", "lines").mapInArrow(lean(work), ROWS)


def _meet_windows(size: int, buckets: int):
    """Stretches that go, by row and packed, and the wanted lines with their sets as they came."""

    def meet(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        gone, sent, sets = [], [], []
        for p in parts:
            if "line" in p:
                d, r, i, k = p["line"].tolist()
                sets.append((None, None, d, r, i, k, len(p["set"]), packed_sketch(p["set"]), p["set"].tobytes()))
            else:
                (gone if "a" in p else sent).append(p)
        if sent:
            x = joined(sent)
            _, later = _first_and_later(x["h"], x["h2"], x["doc"], x["row"], x["at"])
            gone.append(_stretches(x["doc"][later], x["row"][later], x["at"][later], size))
        rows = [(k, x, *[None] * 7) for k, x in _to_rows(joined(gone), buckets)] if gone else []
        kinds = [pa.int32(), pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows + sets], t) for c, t in enumerate(kinds)], names=["bucket", "blob", "doc", "row", "id", "unit", "n", "sk", "set"])

    return meet


def _cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    word = re.compile(WORD)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, AT_ONCE):
                u = lines_of(part.column(1))
                total, lines = np.diff(u.start), np.bincount(u.text, minlength=part.num_rows)
                line_at = np.cumsum(lines) - lines
                rows: list[list] = [[], [], [], []]
                texts = part.column(1).to_pylist()
                for t, blobs in enumerate(part.column(2).to_pylist()):
                    text, dropped, spans, chars = texts[t] or "", 0, 0, 0
                    if blobs:
                        mark, s = np.zeros(int(total[t]) + 1, np.int32), int(u.start[t])
                        for x in map(unpack, blobs):
                            a, z = (x["a"], x["b"]) if "a" in x else (u.a[line_at[t] + x["gone"]] - s, u.b[line_at[t] + x["gone"]] - s)
                            np.add.at(mark, a, 1)
                            np.add.at(mark, z, -1)
                        gone_ = np.cumsum(mark)[:-1] > 0
                        dropped = int(gone_.sum())
                        at = [m.span() for m in word.finditer(text)]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone_.astype(np.int8), [0]])))
                        parts, done = [], 0
                        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                            a, z = at[x][0], at[y - 1][1]
                            while z < len(text) and text[z] == " ":
                                z += 1
                            parts.append(text[done:a])
                            chars += z - a
                            done, spans = z, spans + 1
                        text = "".join([*parts, text[done:]])
                    for c, v in zip(rows, (dropped, spans, chars, text), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lines, pa.int64()), pa.array(total, pa.int64()), *[pa.array(c, pa.int64()) for c in rows[:3]], pa.array(rows[3], pa.string())], names=["doc_id", "n_paragraphs", "n_words", "n_removed_words", "n_spans", "n_removed_chars", "text"])

    held = gone.groupBy("doc", "row").agg(F.collect_list("blob").alias("blobs"))
    parted = marked(docs, gone.select("row"), "row")  # rows that lose nothing stay where they are
    whole = parted.where(~F.col("maybe")).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("blobs"))
    touched = parted.where("maybe").join(held, ["doc", "row"], "left").select("doc_id", "text", "blobs")
    return whole.unionByName(touched).mapInArrow(lean(work), "doc_id long, n_paragraphs long, n_words long, n_removed_words long, n_spans long, n_removed_chars long, text string")


def _pack_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = [pack({"gone": np.array(x, np.int32)}) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], names=["doc", "row", "blob"])


def _near_lines(members: DataFrame, wanted: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """doc, row, blob (line numbers) of the lines that have a near copy before them; members(value, row, unit) share bands."""
    listed = members.join(wanted, ["row", "unit"]).select("value", "id")
    sizes = listed.groupBy("value").agg(F.count(F.lit(1)).alias("members"))
    ranks = listed.join(sizes, "value").groupBy("id").agg(F.sum("members").alias("rank"))
    full = listed.join(sets.select("id", "n", "sk"), "id").join(ranks, "id")
    groups = components(link_lists(full, limit, lambda ids: sets.join(ids, "id").select("id", "set")))
    placed = groups.join(sets.select("id", F.struct("doc", "row", "unit").alias("place")), "id")
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    later = placed.join(first, "component").where("place <> first")
    return later.groupBy("place.doc", "place.row").agg(F.collect_list("place.unit").alias("units")).mapInArrow(_pack_units, "doc long, row long, blob binary")


def substring_dedup(docs: DataFrame, words: int = 5, limit: float = 0.8, passage: int = 32, line: int = LEAST) -> DataFrame:
    """doc_id, n_paragraphs (lines), n_words, n_removed_words, n_spans, n_removed_chars, text (what is left) of every row.

    passage: repeated passages of so many words or more go whole; line: words of the shortest line that is compared."""
    if line < 1 or words < 1:
        raise ValueError("lines and shingles have a word at least")
    if passage < GRAM:
        raise ValueError(f"passages have {GRAM} words or more")
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("doc_id"), "text", F.coalesce(id_, F.lit(NULL_ID)).alias("doc"), F.xxhash64(id_, "text").alias("row"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-total // BUCKET_BYTES))
    read = rows.select("doc", "row", "text")
    met = table(by_bucket(_send(read, buckets, words, passage, line), buckets, _meet(buckets), MET), "units")
    kind = lambda k: met.where(F.col("kind") == k)
    members = kind(MEMBER).select("value", "row", "unit")
    wanted = table(members.select("row", "unit").distinct().withColumn("id", F.monotonically_increasing_id()), "unit-ids")
    grams = by_bucket(kind(AGAIN).select("bucket", "blob"), buckets, _grams_of_rows, "row long, blob binary")
    gone = table(by_bucket(kind(GONE).select("bucket", "blob"), buckets, _removals_of_rows, "doc long, row long, blob binary"), "unit-gone")
    ask = lambda df, **c: df.select("row", *[c.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("blob", "binary"), ("gone", "binary"), ("line", "struct<unit:int,id:bigint>"))])
    asks = ask(grams, blob=F.col("blob")).unionByName(ask(wanted, line=F.struct("unit", "id"))).unionByName(ask(gone, gone=F.col("blob")))
    asks = asks.groupBy("row").agg(*[F.collect_list(c).alias(a) for c, a in (("blob", "blobs"), ("gone", "gone"), ("line", "lines"))])
    # what a row loses with its lines is no reason to read it again
    asks = table(asks.where((F.size("blobs") > 0) | (F.size("lines") > 0)), "unit-asks")
    again = marked(read, asks.select("row"), "row").where("maybe").drop("maybe")
    placed = table(by_bucket(_second(again, asks, buckets, passage, words), buckets, _meet_windows(passage, buckets), PLACED), "unit-places")
    sets = placed.where("id is not null").drop("bucket", "blob").dropDuplicates(["id"])
    near = _near_lines(members, wanted, sets, limit)
    stretches = by_bucket(placed.where("id is null").select("bucket", "blob"), buckets, _removals_of_rows, "doc long, row long, blob binary")
    gone = table(gone.unionByName(stretches).unionByName(near), "unit-removals")
    return _cut(rows, gone)
