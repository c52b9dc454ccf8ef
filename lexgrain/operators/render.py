"""Output shapes: text, JSON lines, counts, file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shown
from .matching import blocks, with_context_lines


def grep(found: DataFrame) -> DataFrame:
    """value: path:line:byte_offset:content, without context."""
    return found.select(F.concat_ws(":", "path", F.col("line_number").cast("string"), F.col("byte_offset").cast("string"), shown(F.col("line_content"))).alias("value"))


def grep_context(found: DataFrame, context: int) -> DataFrame:
    """path, line_number, block, value; context lines are path:line:- :content, each line once, in (path, line_number) order."""
    rows = blocks(with_context_lines(found, context))
    offset = F.coalesce(F.col("byte_offset").cast("string"), F.lit("- "))
    return rows.select("path", "line_number", "block", F.concat_ws(":", "path", F.col("line_number").cast("string"), offset, shown(F.col("line_content"))).alias("value"))


def jsonl(found: DataFrame) -> DataFrame:
    """value: one JSON object a match."""
    cut = lambda name: F.transform(name, shown).alias(name)
    keys = [F.col("path").alias("file"), F.col("line_number").alias("line"), F.col("col"), shown(F.col("line_content")).alias("content"), F.col("byte_offset"), cut("context_before"), cut("context_after"), F.col("is_binary")]
    return found.select(F.to_json(F.struct(*keys)).alias("value"))


def count_json(counted: DataFrame) -> DataFrame:
    return counted.select(F.to_json(F.struct("count")).alias("value"))


def files_json(files: DataFrame) -> DataFrame:
    return files.agg(F.sort_array(F.collect_set("path")).alias("files")).select(F.to_json(F.struct("files")).alias("value"))


def write(rendered: DataFrame, path: str) -> None:
    """Writes the value column as text files."""
    rendered.select("value").write.mode("overwrite").text(path)
