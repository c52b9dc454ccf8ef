"""The engine: search with or without a stored index."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import WatcherRunning
from .operators import index as index_ops
from .operators.candidates import candidates
from .operators.index import StoredIndex
from .operators.matching import as_text, eligible, limited, matches
from .plans.planner import QueryPlan, plan
from .schema import SearchOptions
from .sources.files import list_files, listing, load_files, read_files
from .streaming.state import WatcherState

INDEX_FOLDER = ".lexgrain"
#: Candidates that are named in a filter, and those that are broadcast; more are joined with a shuffle of the texts.
FEW, SENT = 1000, 1 << 20


@dataclass
class SearchResult:
    """A lazy search; `stats` and `capped` run it."""

    found: DataFrame
    all_found: DataFrame
    verified: DataFrame
    candidate_files: DataFrame
    lookup: dict[str, int]
    options: SearchOptions
    plan: QueryPlan

    def stats(self) -> DataFrame:
        """One row: trigrams_queried, posting_lists_decoded, candidate_files, files_verified, bytes_verified, total_matches."""
        cand = self.candidate_files.agg(F.count(F.lit(1)).alias("candidate_files"))
        ver = self.verified.agg(F.count(F.lit(1)).alias("files_verified"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).cast("long").alias("bytes_verified"))
        total = self.found.agg(F.count(F.lit(1)).alias("total_matches"))
        look = self.found.sparkSession.createDataFrame([(self.lookup["trigrams_queried"], self.lookup["posting_lists_decoded"])], "trigrams_queried long, posting_lists_decoded long")
        return look.crossJoin(cand).crossJoin(ver).crossJoin(total)  # one row each

    def capped(self) -> bool:
        """Whether the limit was reached."""
        n = self.options.max_results
        return bool(n) and self.found.count() >= n


def plan_for(pattern: str, o: SearchOptions, strict: bool = True) -> QueryPlan:
    return plan(pattern, o.regex, o.ignore_case, dot_all=o.multiline is not None, strict=strict)


def search(files: DataFrame, pattern: str, options: SearchOptions | None = None, index: StoredIndex | None = None, strict: bool = True, load: Callable[[DataFrame], DataFrame] | None = None, filters: bool = False) -> SearchResult:
    """Searches files(file_id, path, ext, content or text); with an index, only its candidates are read further.

    filters: the index's stored filters narrow its candidates further.
    load: gives the content of those of files that the index and the filters let through; files needs none then.
    Filters come before the limit, and results are in (path, line_number) order where a limit holds."""
    o = (options or SearchOptions()).checked()
    p = plan_for(pattern, o, strict)
    lookup = {"trigrams_queried": 0, "posting_lists_decoded": 0}
    scope = all_files = files
    if index is not None and not o.include_binary:
        ids, lookup = candidates(p, index, filters)
        all_files = index.files.select("file_id") if ids is None else ids
        few = None if ids is None else [r["file_id"] for r in ids.limit(FEW + 1).collect()]
        if few is not None and len(few) <= FEW:  # reaches the scan of files, which skips what holds none of them
            scope = files.where(F.col("file_id").isin(few))
        else:
            n = index.meta["file_count"] if ids is None else ids.count()
            scope = files.join(F.broadcast(all_files) if n <= SENT else all_files, "file_id", "left_semi")
    scope = eligible(scope, o)
    scope = load(scope) if load else scope
    scope = as_text(scope, o.include_binary or o.stream) if "text" not in scope.columns else scope
    found = matches(scope, p, o)
    return SearchResult(limited(found, o), found, scope, all_files.select("file_id"), lookup, o, p)


def find_index(path: str) -> str | None:
    """The folder of the nearest index at or above path."""
    at = os.path.abspath(path)
    while True:
        folder = os.path.join(at, INDEX_FOLDER)
        if os.path.isdir(os.path.join(folder, "index")) or WatcherState.read(folder):
            return folder
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


class Engine:
    """Folders, indexed or not."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def build(self, root: str, force: bool = False, decompress: bool = False) -> dict:
        folder = os.path.join(root, INDEX_FOLDER)
        state = WatcherState.read(folder)
        if state and state.is_live() and not force:
            raise WatcherRunning(f"a watcher (process {state.pid}) keeps the index of {root}")
        os.makedirs(folder, exist_ok=True)
        return index_ops.build(read_files(self.spark, root, decompress), f"file://{os.path.abspath(folder)}/index")

    def update(self, root: str, decompress: bool = False) -> dict[str, int]:
        return index_ops.update(list_files(self.spark, root), f"file://{os.path.abspath(os.path.join(root, INDEX_FOLDER))}/index", lambda listed: load_files(listed, root, decompress))

    def stale(self, root: str) -> bool:
        """Whether files changed since the index was built; a live watcher keeps it fresh."""
        folder = os.path.join(root, INDEX_FOLDER)
        state = WatcherState.read(folder)
        if state and state.is_live():
            return False
        return index_ops.is_stale(listing(self.spark, root), StoredIndex(self.spark, f"file://{os.path.abspath(folder)}/index"))

    def search(self, pattern: str, path: str = ".", options: SearchOptions | None = None, use_index: bool = True, fresh: bool = False, warn=None) -> SearchResult:
        """Searches path; an index above it is used with path as a prefix filter."""
        o = options or SearchOptions()
        folder = find_index(path) if use_index and not o.archives else None
        if fresh:
            root = os.path.dirname(folder) if folder else path
            self.build(root, force=True, decompress=o.decompress)
            folder = os.path.join(root, INDEX_FOLDER)
        if folder is None:
            return search(read_files(self.spark, path, o.decompress, o.archives, warn), pattern, o)
        root = os.path.dirname(folder)
        index = StoredIndex(self.spark, f"file://{os.path.abspath(folder)}/index")
        rel = os.path.relpath(os.path.abspath(path), root)
        if rel != "." and not o.path_prefix:
            o = replace(o, path_prefix=rel)
        known = index.files.select("file_id", "path")
        now = list_files(self.spark, root, warn=warn).drop("file_id").join(known, "path")
        return search(now, pattern, o, index, load=lambda listed: load_files(listed, root, o.decompress), filters=True)

    def search_text(self, texts: DataFrame, pattern: str, options: SearchOptions | None = None) -> SearchResult:
        """Searches a stream of texts(path, text): line ends are no part of lines, offsets are 0, type, binary and multiline options don't count."""
        o = replace(options or SearchOptions(), stream=True, types=(), multiline=None, include_binary=False)
        return search(texts.withColumns({"file_id": F.lit(0).cast("long"), "ext": F.lit("")}), pattern, o)
