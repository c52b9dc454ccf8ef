"""Packing tokenised documents into fixed windows by sum-of-squares online packing.

Each task packs the documents of its own partition in one pass, so nothing is
shuffled.  A document's ids (the tokenizer's, then an end id) are cut into whole
windows and a rest; a rest of s ids goes to the fill level h, 0 for a new window, that
least raises the sum over levels of squared counts of partly filled windows, which a
level array tracks.  When the input ends, the windows still open are drained: the
emptiest are cut to fill the fullest, so at most one partial window a task is left,
and its ids are cut into windows of powers of two, which need no padding.

Tokenising works on distinct chunks: a text is cut before each space that stands
between two other characters that are not white space, where a byte-level BPE with a
" ?word" pattern never joins tokens; each chunk is tokenised once while it is remembered.
Texts with other white space around a space, or with a special token's string, are
tokenised whole.

Results for odd input: a null or empty text is one end id; an empty table gives an
empty result; rows that repeat an identifier are documents of their own; very long
texts span windows; extra columns are ignored.  A rerun over the same input files
agrees.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of the chunks that a task remembers (each counted with 150 more), and of text that it tokenises at once.
REMEMBERED, AT_ONCE = 96 << 20, 2_000_000


#: Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point both libraries agree on what is a letter, a number and white space.
PLAIN = 0x0180


def byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary's tokens as bytes: printable Latin-1 characters stand for themselves, U+0100 and on for the others in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(rest)}
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class ChunkTokenizer:
    """Ids of texts by a byte-level BPE file of tokenizers, each distinct chunk tokenised once while it is remembered.

    Chunks of plain characters are merged by tiktoken with the same file's vocabulary, which is faster for short strings."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        names = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ranks = byte_ranks({t: i for t, i in self.tok.get_vocab().items() if t not in names})
        self.fast = tiktoken.Encoding("chunks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = "|".join([r"\s ", r" \s", r" $", r"^ ", *map(re.escape, names)])
        self.forget()

    def forget(self) -> None:
        self.heads: dict[str, int] = {}  # chunks that start a text, and those after a space
        self.bodies: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.n = np.zeros(1 << 14, np.int64), 0
        self.bytes = 0

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        plain = [max(c, default="") < chr(PLAIN) for c in chunks]
        others = iter(self.tok.encode_batch_fast([c for c, ok in zip(chunks, plain, strict=True) if not ok], add_special_tokens=False))
        return [self.fast(c) if ok else next(others).ids for c, ok in zip(chunks, plain, strict=True)]

    def _learn(self, at: dict[str, int], words: list[str], before: str) -> None:
        new = [w for w in words if w not in at]
        if not new:
            return
        got = self._ids([before + w for w in new])
        lens = np.fromiter(map(len, got), np.int64, len(got))
        more = int(lens.sum())
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(new) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(got), np.uint32, more)
        self.starts[self.n + 1 : self.n + 1 + len(new)] = self.used + np.cumsum(lens)
        at.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.used += more
        self.n += len(new)
        self.bytes += sum(map(len, new)) + 150 * len(new)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's count."""
        if self.bytes > REMEMBERED:
            self.forget()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        chunks = parts.flatten().dictionary_encode()
        words, which = chunks.dictionary.to_pylist(), chunks.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(which), bool)
        first[ends[:-1]] = True
        heads = [words[i] for i in which[first].tolist()]
        self._learn(self.heads, list(dict.fromkeys(heads)), "")
        self._learn(self.bodies, words, " ")
        slot = np.fromiter(map(self.bodies.__getitem__, words), np.int64, len(words))[which]
        slot[first] = np.fromiter(map(self.heads.__getitem__, heads), np.int64, len(heads))
        lens = self.starts[slot + 1] - self.starts[slot]
        total = np.concatenate([[0], np.cumsum(lens)])
        pick = np.repeat(self.starts[slot] - total[:-1], lens) + np.arange(total[-1])
        ids, counts = self.flat[pick], total[ends[1:]] - total[ends[:-1]]
        if odd.any():
            out, at_, c = [], 0, counts.tolist()
            whole = iter(self.tok.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False))
            for i, is_odd in enumerate(odd.tolist()):
                out.append(np.asarray(next(whole).ids, np.uint32) if is_odd else ids[at_ : at_ + c[i]])
                at_ += c[i]
            ids, counts = np.concatenate(out), np.array([len(x) for x in out], np.int64)
        return ids, counts


class Packer:
    """Sum-of-squares packing of one partition; `out` gathers rows (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, window: int):
        self.window, self.next = window, 0
        self.levels = np.zeros(window + 1, np.int64)  # open windows by fill
        self.open: list[list[list]] = [[] for _ in range(window)]  # by fill: windows, each a list of pieces
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        w, n = self.window, len(ids)
        whole = n - n % w
        for s in range(0, whole, w):
            self.emit([(doc_id, s, ids[s : s + w], n)])
        if whole < n:
            self.place((doc_id, whole, ids[whole:].copy(), n))

    def place(self, piece: tuple) -> None:
        w, s = self.window, len(piece[2])
        # raise of the sum of squares when a window goes from level h to h + s; level 0 and a full window aren't counted
        rise = 2 * (self.levels[s : w + 1] - self.levels[: w + 1 - s]) + 2
        rise[self.levels[: w + 1 - s] == 0] = np.iinfo(np.int64).max
        rise[0] = 2 * self.levels[s] + 1
        if self.levels[w - s]:
            rise[w - s] = 1 - 2 * self.levels[w - s]
        h = int(rise.argmin())
        pieces = [piece]
        if h:
            self.levels[h] -= 1
            pieces = self.open[h].pop()
            pieces.append(piece)
        if h + s == w:
            self.emit(pieces)
        else:
            self.levels[h + s] += 1
            self.open[h + s].append(pieces)

    def drain(self) -> None:
        """Fills the fullest open windows with what the emptiest hold; the last ids go to windows of powers of two."""
        left = [(h, p) for h in range(1, self.window) for p in self.open[h]]  # emptiest first
        stock, have = [], 0
        lo, hi = 0, len(left) - 1
        while lo <= hi:
            h, pieces = left[hi]
            need = self.window - h
            while have < need and lo < hi:
                stock += left[lo][1]
                have += left[lo][0]
                lo += 1
            if have < need:
                stock += pieces
                have += h
                break
            fill, stock = self.cut(stock, need)
            have -= need
            self.emit(pieces + fill)
            hi -= 1
        while have:
            take = min(self.window, 1 << (have.bit_length() - 1)) if have < self.window else self.window
            fill, stock = self.cut(stock, take)
            have -= take
            self.emit(fill)

    @staticmethod
    def cut(pieces: list, n: int) -> tuple[list, list]:
        """The first n ids of pieces, and the rest."""
        took = []
        while n:
            doc_id, start, ids, total = pieces[0]
            if len(ids) <= n:
                took.append(pieces[0])
                pieces = pieces[1:]
                n -= len(ids)
            else:
                took.append((doc_id, start, ids[:n], total))
                pieces = [(doc_id, start + n, ids[n:], total), *pieces[1:]]
                n = 0
        return took, pieces


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece of every document of docs(doc_id, text): SCHEMA. A window's sequence_id holds its task's number in the upper bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = _tokenizer(tokenizer), Packer(window)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch):
                ids, counts = tok(part.column(1).cast(pa.string()))
                at = 0
                for doc_id, c in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    packer.add(doc_id, np.append(ids[at : at + c], np.uint32(end_id)).astype("<u4"))
                    at += c
                yield rows(packer, base)
        packer.drain()
        yield rows(packer, base)
        tok.forget()  # the worker lives on

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lean(work), SCHEMA)


_KEPT: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _KEPT:
        _KEPT[path] = ChunkTokenizer(path)
    return _KEPT[path]


def slices(batch: pa.RecordBatch, at_once: int = AT_ONCE, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about at_once bytes of text, in the given column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + at_once)))
        yield batch.slice(at, to - at)
        at = to


def rows(packer: Packer, base: int) -> pa.RecordBatch:
    cols = list(zip(*packer.out, strict=True)) or [()] * 7
    packer.out = []
    arrays = [pa.array(c, pa.int64()) for c in cols]
    arrays[5] = pc.add(arrays[5], base)
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
