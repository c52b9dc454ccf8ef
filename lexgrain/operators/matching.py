"""Lines, matches, context and limits.

A file's lines stay one array in its row; a filter over that array finds the matching
ones.  What is told of them is made within the row, and only that is exploded, so neither
positions nor context need a shuffle and no text is copied for each of its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_binary, line_starts, lines, trim_end, under
from ..plans.planner import QueryPlan
from ..schema import SearchOptions


def all_lines(files: DataFrame) -> DataFrame:
    """file_id, path, line_number, line_content, byte_offset of every line of files(file_id, path, text)."""
    rows = files.select("file_id", "path", F.coalesce("text", F.lit("")).alias("text")).withColumn("units", lines(F.col("text")))
    numbers = F.when(F.size("units") > 0, F.sequence(F.lit(0), F.size("units") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("starts", line_starts(F.col("text"), numbers))
    rows = rows.select("file_id", "path", F.posexplode(F.arrays_zip("units", "starts")).alias("i", "l"))
    return rows.select("file_id", "path", (F.col("i") + 1).cast("int").alias("line_number"), trim_end(F.col("l.units")).alias("line_content"), F.col("l.starts").alias("byte_offset"))


def eligible(files: DataFrame, o: SearchOptions) -> DataFrame:
    """Type and path filters, which reach the scan."""
    if o.types:
        files = files.where(F.col("ext").isin(*o.types))
    if o.path_prefix:
        files = files.where(under(F.col("path"), o.path_prefix))
    return files


def as_text(files: DataFrame, include_binary: bool) -> DataFrame:
    """files(content) with text: binary files and those that aren't UTF-8 are left out."""
    if not include_binary:
        files = files.where(~is_binary(F.col("content")))
    return files.where(F.is_valid_utf8("content")).withColumn("text", F.decode("content", "UTF-8"))


def _hit(line: Column, plan: QueryPlan) -> Column:
    """Whether a line matches: a literal needs no regular expression."""
    text = getattr(plan, "text", None)
    return F.contains(line, F.lit(text)) if text else F.rlike(line, F.lit(plan.java))


def _place(line: Column, plan: QueryPlan) -> Column:
    text = getattr(plan, "text", None)
    return F.instr(line, F.lit(text)) if text else F.regexp_instr(line, F.lit(plan.java), F.lit(0))


def matches(files: DataFrame, plan: QueryPlan, o: SearchOptions) -> DataFrame:
    """path, line_number, col, line_content, byte_offset, context_before, context_after, is_binary: the first match of each matching line of files(path, text).

    A search that only counts has no contents and no offsets; of each file, as many matches as the limit has are enough."""
    for part in plan.contains:
        files = files.where(F.contains("text", F.lit(part)))
    whole = F.col("text")
    if o.multiline == "document":
        units = F.array(whole)
    elif o.stream:  # line ends are no part of a line here
        units = F.transform(lines(whole), lambda x: F.regexp_replace(x, r"\r?\n\z", ""))
    else:
        units = lines(whole)
    rows = files.select("path", "text", units.alias("units"))
    numbered = F.transform("units", lambda x, i: F.struct(i.alias("i"), x.alias("raw")))
    hits = F.filter(numbered, lambda s: _hit(s["raw"], plan))
    if o.max_results and not o.count_only:  # no file needs more; those after them in it are never shown
        hits = F.slice(hits, 1, o.max_results)
    rows = rows.withColumn("hits", hits)
    show = (lambda c: c) if o.stream else trim_end
    n = F.lit(o.context)
    none = F.array().cast("array<string>")

    def told(s: Column) -> Column:
        raw, i = s["raw"], s["i"]
        head = F.substring(raw, F.lit(1), _place(raw, plan) - 1)
        first = F.greatest(i - n, F.lit(0))
        ahead = F.transform(F.slice("units", first + 1, i - first), show) if o.context else none
        behind = F.transform(F.slice("units", i + 2, n), show) if o.context else none
        number, lead = i + 1, F.octet_length(head)
        if o.multiline == "document":  # lines up to the match, and its byte within the last
            number, lead = F.size(F.split(head, "\n")), F.octet_length(F.substring_index(head, "\n", -1))
        return F.struct(
            number.cast("int").alias("line_number"), lead.alias("lead"), F.octet_length(head).alias("within"), (F.lit("") if o.count_only else show(raw)).alias("line_content"),
            ahead.alias("context_before"), behind.alias("context_after"),
        )

    placed = not (o.stream or o.count_only or o.multiline == "document")
    # a text without a match stays in the JVM
    starts = line_starts(F.when(F.size("hits") > 0, F.col("text")), F.transform("hits", lambda s: s["i"])) if placed else F.transform("hits", lambda s: F.lit(0).cast("long"))
    found = rows.select("path", F.transform("hits", told).alias("hits"), starts.alias("starts")).select("path", F.explode(F.arrays_zip("hits", "starts")).alias("m"))
    m = F.col("m.hits")
    return found.select(
        "path", m["line_number"].alias("line_number"), (m["lead"] + 1).cast("int").alias("col"), m["line_content"].alias("line_content"),
        (F.lit(0) if o.stream or o.count_only else F.col("m.starts") + m["within"]).cast("long").alias("byte_offset"), m["context_before"].alias("context_before"), m["context_after"].alias("context_after"), F.lit(False).alias("is_binary"),
    )


def limited(found: DataFrame, o: SearchOptions) -> DataFrame:
    """The first max_results in (path, line_number) order; all if 0."""
    return found.orderBy("path", "line_number").limit(o.max_results) if o.max_results else found


def count(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("count"))


def count_by_file(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("count"))


def files_with_matches(found: DataFrame) -> DataFrame:
    return found.select("path").distinct().orderBy("path")


def with_context_lines(found: DataFrame, context: int) -> DataFrame:
    """path, line_number, byte_offset (null for context), line_content, is_match: each line once, matches before context."""
    start = F.col("line_number") - F.size("context_before")
    ahead = F.transform("context_before", lambda x, i: F.struct((start + i).alias("n"), x.alias("c"), F.lit(None).cast("long").alias("o")))
    own = F.array(F.struct(F.col("line_number").alias("n"), F.col("line_content").alias("c"), F.col("byte_offset").alias("o")))
    behind = F.transform("context_after", lambda x, i: F.struct((F.col("line_number") + 1 + i).alias("n"), x.alias("c"), F.lit(None).cast("long").alias("o")))
    rows = found.select("path", F.explode(F.concat(ahead, own, behind)).alias("l"))
    best = rows.groupBy("path", F.col("l.n").cast("int").alias("line_number")).agg(F.max("l.o").alias("byte_offset"), F.max("l.c").alias("line_content"))
    return best.select("path", "line_number", "byte_offset", "line_content", F.col("byte_offset").isNotNull().alias("is_match"))


def blocks(context_rows: DataFrame) -> DataFrame:
    """Adds block: runs of neighbouring lines of a file, counted from 1."""
    w = W.partitionBy("path").orderBy("line_number")
    gap = (F.col("line_number") - F.coalesce(F.lag("line_number").over(w), F.lit(-1)) > 1).cast("int")
    return context_rows.withColumn("gap", gap).withColumn("block", F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("gap")
