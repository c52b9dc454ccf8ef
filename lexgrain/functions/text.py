"""Column functions over file contents; all but `line_starts` stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes looked at to tell binary content, and of the longest line that is shown whole.
HEAD, SHOWN = 512, 200


def is_binary(content: Column) -> Column:
    """More than 30 % of the first bytes are other than tab, line ends and 20..7E; empty content isn't."""
    head = F.substring(content, 1, HEAD)
    odd = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[\t\n\r -~]+", "")
    return F.length(odd) * 10 > F.octet_length(head) * 3


def lines(text: Column) -> Column:
    """Array of lines with their ends; none after a final line end."""
    return F.regexp_extract_all(text, F.lit("[^\\n]*\\n|[^\\n]+"), F.lit(0))


def line_starts(text: Column, numbers: Column) -> Column:
    """Array of the bytes of text before each line of the array numbers (from 0): one pass over the line ends of a batch."""

    @F.arrow_udf("array<bigint>")
    def starts(texts: pa.Array, lines_: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        step = 1 << 20  # what marks line ends is as small as that, however large the batch
        ends = np.concatenate([*(np.flatnonzero(data[i : min(i + step, at[-1])] == 10) + i for i in range(at[0], at[-1], step)), np.zeros(1, np.int64)])
        first = np.searchsorted(ends[:-1], at[:-1])  # each text's first line end
        ask, n = lines_.flatten().to_numpy().astype(np.int64), lines_.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(texts)), n)
        out = np.where(ask > 0, ends[np.minimum(first[of] + ask - 1, len(ends) - 1)] + 1 - at[of], 0)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(out, pa.int64()))

    return starts(text, numbers)


def trim_end(line: Column) -> Column:
    """Without trailing Unicode white space."""
    return F.regexp_replace(line, r"(?U)\s+\z", "")


def extension(path: Column) -> Column:
    """After the last dot of the name; none if the dot leads it."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def shown(line: Column) -> Column:
    """The longest start of whole characters within SHOWN bytes and "...", if the line has more bytes."""
    return F.when(F.octet_length(line) > SHOWN, F.concat(_cut(line), F.lit("..."))).otherwise(line)


def _cut(line: Column) -> Column:
    head = F.substring(F.encode(line, "UTF-8"), 1, SHOWN)
    # a cut character leaves a malformed end of one to three bytes
    tries = [F.substring(head, 1, SHOWN - k) for k in range(4)]
    good = F.coalesce(*[F.when(F.is_valid_utf8(t), t) for t in tries])
    return F.decode(good, "UTF-8")


def under(path: Column, prefix: str) -> Column:
    """Whether path is prefix or lies below it, component by component."""
    p = prefix.rstrip("/")
    return F.lit(True) if p in ("", ".") else (path == p) | F.startswith(path, F.lit(p + "/"))
