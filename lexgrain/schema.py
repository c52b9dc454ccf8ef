"""Schemas and options. Nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

from .errors import InvalidOptions

VERSION = (1, 1)
MAX_FILE_BYTES = 100 * 1024 * 1024
#: Fixed value: results of the command line unless told otherwise; the library has no limit.
CLI_MAX_RESULTS = 100

SOURCE = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("ext", T.StringType()),
    T.StructField("mtime_ns", T.LongType()), T.StructField("size_bytes", T.LongType()), T.StructField("content", T.BinaryType()),
])
FILES = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("mtime_ns", T.LongType()),
    T.StructField("size_bytes", T.LongType()), T.StructField("content_hash", T.StringType()), T.StructField("trigram_count", T.IntegerType()),
    T.StructField("is_binary", T.BooleanType()), T.StructField("status", T.StringType()),
])
POSTINGS = T.StructType([T.StructField("trigram", T.IntegerType()), T.StructField("file_id", T.LongType()), T.StructField("tf", T.IntegerType())])
DICTIONARY = T.StructType([T.StructField("trigram", T.IntegerType()), T.StructField("doc_frequency", T.LongType())])
BLOOMS = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("bloom", T.BinaryType())])

@dataclass(frozen=True)
class SearchOptions:
    """How to search. `multiline` is "line" (dot also matches a line end, still one line at a time), "document" (the whole text is one unit) or off."""

    regex: bool = False
    ignore_case: bool = False
    multiline: str | None = None
    types: tuple[str, ...] = ()
    path_prefix: str | None = None
    context: int = 0
    max_results: int = 0
    count_only: bool = False
    include_binary: bool = False
    decompress: bool = False
    archives: bool = False
    stream: bool = False

    def checked(self) -> SearchOptions:
        if self.multiline not in (None, "line", "document"):
            raise InvalidOptions("multiline is 'line', 'document' or None")
        if self.multiline and not self.regex:
            raise InvalidOptions("multiline needs a regular expression")
        if self.context < 0 or self.max_results < 0:
            raise InvalidOptions("context and max_results start at 0")
        return replace(self, types=expand_types(self.types))


#: Type names that stand for several extensions; any other name is an extension itself.
TYPE_ALIASES = {"cpp": ("cpp", "cc", "cxx"), "h": ("h", "hpp"), "yaml": ("yaml", "yml")}


def expand_types(types: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(e for t in types for e in TYPE_ALIASES.get(t, (t,))))
