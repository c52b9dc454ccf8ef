"""From a plan to the files that may match, by the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.trigrams import may_contain
from ..plans.planner import CaseInsensitive, Literal, QueryPlan, RegexWithLiterals
from .index import StoredIndex

#: Posting lists read for each required string: the rarest. What they let through is verified anyway.
RAREST = 3


def division(postings: DataFrame, trigrams: list[int]) -> DataFrame:
    """file_id of the files that hold all of trigrams."""
    kinds = sorted(set(trigrams))
    return postings.where(F.col("trigram").isin(kinds)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(kinds)).select("file_id")


def grouped(postings: DataFrame, groups: list[tuple[int, ...]]) -> DataFrame:
    """file_id of the files that hold one at least of each group."""
    spark = postings.sparkSession
    rows = [(t, g) for g, group in enumerate(dict.fromkeys(groups)) for t in group]
    want = spark.createDataFrame(rows, "trigram int, grp int")  # eight rows for each byte of the query at most
    held = postings.where(F.col("trigram").isin(sorted({t for t, _ in rows}))).join(F.broadcast(want), "trigram")
    return held.groupBy("file_id").agg(F.countDistinct("grp").alias("n")).where(F.col("n") == len({g for _, g in rows})).select("file_id")


def candidates(plan: QueryPlan, index: StoredIndex, filters: bool = False) -> tuple[DataFrame | None, dict[str, int]]:
    """file_id of candidates (None: all files) and the lookup part of the statistics.

    filters: the files' stored filters are asked for the required trigrams whose lists weren't read."""
    stats = {"trigrams_queried": 0, "posting_lists_decoded": 0}
    if isinstance(plan, Literal | RegexWithLiterals):
        sets = [plan.trigrams] if isinstance(plan, Literal) else plan.trigram_sets
        df = index.frequencies(sorted({t for s in sets for t in s}))
        chosen: set[int] = set()
        for s in sets:
            for t in s:
                stats["trigrams_queried"] += 1
                if t not in df:  # a required trigram occurs nowhere
                    return index.files.select("file_id").limit(0), stats | {"posting_lists_decoded": 0}
            chosen |= set(sorted(s, key=lambda t: (df[t], t))[:RAREST])
        stats["posting_lists_decoded"] = len(chosen)
        found, rest = division(index.postings, sorted(chosen)), sorted({t for s in sets for t in s} - chosen)
        if filters and rest:
            found = may_contain(index.blooms.join(found, "file_id"), rest)
        return found, stats
    if isinstance(plan, CaseInsensitive):
        stats["trigrams_queried"] = sum(map(len, plan.groups))
        df = index.frequencies(sorted({t for g in plan.groups for t in g}))
        ranked = sorted(dict.fromkeys(plan.groups), key=lambda g: sum(df.get(t, 0) for t in g))[:RAREST]
        stats["posting_lists_decoded"] = sum(t in df for g in ranked for t in g)
        return grouped(index.postings, ranked), stats
    return None, stats
