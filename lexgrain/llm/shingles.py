"""Sets of hashed word shingles of whole texts, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits evenly (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of anything but ASCII white space) of all texts, and each text's first word (one more at the end)."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    first = parts.offsets.to_numpy().astype(np.int64)
    first = first - first[0]
    words = parts.flatten().dictionary_encode()
    which = words.indices.to_numpy()
    kinds = words.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))
    out = hashes[which] if len(which) else np.zeros(0, np.uint64)
    if b"" in kinds:  # white space at a text's end stands beside an empty word
        real = which != kinds.index(b"")
        first = np.concatenate([[0], np.cumsum(real)])[first]
        out = out[real]
    return out, first


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words, the whole sequence as one; empty without words."""
    words, first = word_hashes(texts)
    size = np.diff(first)
    full = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        full += words[i : i + len(full)] * _ODD[i % len(_ODD)] + np.uint64(i // len(_ODD))
    full = mix(full)
    for a, k in zip(first[:-1].tolist(), size.tolist(), strict=True):
        if k >= n:
            yield np.unique(full[a : a + k - n + 1])
        elif k:
            yield np.array([xxhash.xxh3_64_intdigest(words[a : a + k].tobytes(), seed=k)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
