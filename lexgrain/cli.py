"""Command line: python -m lexgrain PATTERN [PATH] [flags]."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from .engine import INDEX_FOLDER, Engine, find_index
from .errors import LexgrainError
from .operators import matching, render
from .operators.index import StoredIndex
from .schema import CLI_MAX_RESULTS, SearchOptions
from .streaming.changes import run_watcher


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexgrain", description="Searches text by literals and regular expressions, with a trigram index where there is one.")
    p.add_argument("pattern", nargs="?")
    p.add_argument("path", nargs="?")
    p.add_argument("--build", metavar="PATH", nargs="?", const=".", help="build the index of a folder")
    p.add_argument("--daemon", metavar="PATH", help="keep the index of a folder up to date")
    p.add_argument("--force", action="store_true", help="build although a watcher is live")
    p.add_argument("--fresh", action="store_true", help="rebuild the index before searching")
    p.add_argument("--no-index", action="store_true")
    p.add_argument("-r", "--regex", action="store_true")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-U", "--multiline", action="store_true", help="dot also matches a line end")
    p.add_argument("--document", action="store_true", help="with --multiline: a match may span lines")
    p.add_argument("-t", "--type", action="append", default=[])
    p.add_argument("-C", "--context", type=int, default=0)
    p.add_argument("-n", "--max-results", type=int, default=CLI_MAX_RESULTS, help="0 for all")
    p.add_argument("-c", "--count", action="store_true")
    p.add_argument("-l", "--files-only", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("-z", "--decompress", action="store_true")
    p.add_argument("--archive", action="store_true")
    p.add_argument("--binary", action="store_true")
    p.add_argument("-j", "--threads", type=int, default=0, help="cores of a local session")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin=None, out=None, err=None) -> int:
    a = parser().parse_args(argv)
    out, err = out or sys.stdout, err or sys.stderr
    own = spark is None
    spark = spark or SparkSession.builder.master(f"local[{a.threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    try:
        return _run(a, spark, stdin, out, err)
    except LexgrainError as e:
        print(f"lexgrain: {e}", file=err)
        return 1
    finally:
        if own:
            spark.stop()


def _run(a: argparse.Namespace, spark: SparkSession, stdin, out, err) -> int:
    engine = Engine(spark)
    if a.build is not None:
        stats = engine.build(a.build, a.force, a.decompress)
        print(" ".join(f"{k}={v}" for k, v in stats.items()), file=out)
        return 0
    if a.daemon:
        run_watcher(spark, a.daemon, os.path.join(a.daemon, INDEX_FOLDER), decompress=a.decompress)
        return 0
    if a.pattern is None:
        parser().print_usage(err)
        return 1
    began = time.time()
    multiline = ("document" if a.document else "line") if a.multiline else None
    # a count is of all matches
    o = SearchOptions(a.regex, a.ignore_case, multiline, tuple(a.type), None, a.context, 0 if a.count else a.max_results, a.count, a.binary, a.decompress, a.archive).checked()
    warn = lambda path, e: print(f"lexgrain: skipping {path}: {e}", file=err)
    if a.path is None and stdin is not None:
        text = stdin.read()
        result = engine.search_text(spark.createDataFrame([("(stdin)", text)], "path string, text string"), a.pattern, o)
    else:
        path = a.path or "."
        folder = None if a.no_index or a.fresh or a.archive else find_index(path)
        if folder and engine.stale(os.path.dirname(folder)):
            built = StoredIndex(spark, f"file://{os.path.abspath(folder)}/index", check=False).meta["created_at_us"] / 1e6
            print(f"lexgrain: files changed since the index was built at {time.strftime('%Y-%m-%d %H:%M:%S', time.localtime(built))}; --fresh rebuilds it", file=err)
        result = engine.search(a.pattern, path, o, not a.no_index, a.fresh, warn)
    _print(a, o, result, out)
    if o.max_results and not a.count and result.capped():
        print(f"lexgrain: output capped at {o.max_results} results (use -n 0 for all)", file=err)
    if a.stats:
        row = result.stats().first().asDict()
        for k, v in (row | {"search_time_ms": round((time.time() - began) * 1000)}).items():
            print(f"{k}: {v}", file=err)
    return 0


def _print(a: argparse.Namespace, o: SearchOptions, result, out) -> None:
    if a.count:
        counted = matching.count(result.found)
        print(render.count_json(counted).first()["value"] if a.json else counted.first()["count"], file=out)
        return
    if a.files_only:
        files = matching.files_with_matches(result.found)
        rows = [render.files_json(files).first()["value"]] if a.json else (r["path"] for r in files.toLocalIterator())
    elif a.json:
        rows = (r["value"] for r in render.jsonl(result.found.orderBy("path", "line_number")).toLocalIterator())
    elif o.context:
        rows, last = [], None
        for r in render.grep_context(result.found, o.context).orderBy("path", "line_number").toLocalIterator():
            if last not in (None, (r["path"], r["block"])):
                rows.append("--")
            last = (r["path"], r["block"])
            rows.append(r["value"])
    else:
        rows = (r["value"] for r in render.grep(result.found.orderBy("path", "line_number")).toLocalIterator())
    for line in rows:
        print(line, file=out)
