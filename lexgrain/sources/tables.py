"""Tables as sources: a row with a text is a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension


def from_table(df: DataFrame, file_id: str | Column, path: Column, text: str | Column, ext: Column | None = None, mtime_ns: Column | None = None) -> DataFrame:
    """file_id, path, ext, mtime_ns, size_bytes, content, text of any table with a text column; a null text is empty."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    body = F.coalesce(col(text), F.lit(""))
    return df.select(
        col(file_id).cast("long").alias("file_id"), path.alias("path"), (ext if ext is not None else extension(path)).alias("ext"), (mtime_ns if mtime_ns is not None else F.lit(0)).cast("long").alias("mtime_ns"),
        F.octet_length(body).cast("long").alias("size_bytes"), F.encode(body, "UTF-8").alias("content"), body.alias("text"),
    )


def documents(df: DataFrame) -> DataFrame:
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("txt")))
    return from_table(df, "doc_id", path, "text", F.coalesce("lang", F.lit("txt")))


def pages(df: DataFrame) -> DataFrame:
    return from_table(df, "page_id", F.col("url"), "html", F.lit("html"))


def conversations(df: DataFrame) -> DataFrame:
    """One text a turn, for searching as a stream."""
    path = F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string"))
    return from_table(df, F.col("conv_id") * 100_000 + F.col("turn"), path, "text", F.lit(""))
