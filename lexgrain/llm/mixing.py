"""Mixing sources to target weights by Pareto order sampling.

Every source's target is its weighted share of the whole, at most `most` times its
size, the excess reshared by weight (water level over the sources, found with one
pass of cumulative sums).  A document's expected copies are its source's target over
its size, times its own relative weight where one is given; whole copies are certain,
the fraction is an inclusion probability p.  Documents are ranked by random odds over
inclusion odds, (u / (1 - u)) / (p / (1 - p)), u from a digest of seed and identifier,
and each source takes its first documents in that order until the words that the
whole copies left open are met, the last one only if that comes nearer.

Prefix sums of a large source stay distributed: rows are counted in fine rank bins, a
source's cut falls into one bin, and only that bin's rows are sorted together.

Results for odd input: a null or empty text has no words and is never taken; an empty
table gives an empty result; a null source is a source of its own, last; equal ranks
are cut by identifier, then text; rows that repeat both are cut together, so they may
overshoot; extra columns stay in `mix`, not in `mix_sizes`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table

WEIGHTS = (5, 2, 1)
#: u has 48 bits.
U_BITS = 48


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """In (0, 1), from the first 12 hex digits of an MD5."""
    digits = F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), "UTF-8")), 1, U_BITS // 4)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << U_BITS))


def targets(sizes: DataFrame, share_percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of sizes(source, size): one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (nth % len(weights)).cast("int") + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    # sources fill in order of cap / weight; at rank k those before are full and the rest share what is left
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, on, all_ = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing), W.partitionBy()
    left = F.sum("source_size").over(all_) * share_percent - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left.cast("double") / (100 * F.sum("weight").over(on)).cast("double")
    per = per.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # the first source that isn't full sets the level of all that follow
    at = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    fill = F.col("weight") * at
    return per.select("source", "source_size", F.when(at.isNull() | (F.col("cap") <= fill), F.col("cap").cast("double")).otherwise(fill).alias("target"))


def mix_sizes(docs: DataFrame, share_percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 29, bin_rows: int = 256, worth: str | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every row.

    worth: a column of docs with a positive number that raises or lowers a document's expected copies within its source;
    copies of one document still don't exceed `most`."""
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("th"), (F.col(worth).cast("double") if worth else F.lit(1.0)).alias("worth"))
    rows = table(rows, "mix-sizes")
    per = table(targets(rows, share_percent, most, weights), "mix-targets")
    scale = rows.groupBy("source").agg(F.sum(F.col("worth") * F.col("size")).alias("worth_size"), F.count(F.lit(1)).alias("n"))
    per = per.alias("a").join(scale.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.worth_size", "b.n")
    u = uniform(seed, F.col("doc_id"))
    with_per = rows.alias("r").join(per.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "p.source_size", "p.target", "p.worth_size", "p.n")
    hoped = F.when(F.col("worth_size") > 0, F.least(F.col("target") * F.col("worth") / F.col("worth_size"), F.lit(float(most)))).otherwise(0.0)
    with_per = with_per.withColumn("hoped", hoped).withColumn("sure", F.floor("hoped").cast("int")).withColumn("p", F.col("hoped") - F.col("sure")).withColumn("u", u)
    odds = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    ranked = with_per.withColumn("rank", odds)
    # ranks spread as u / (1 - u) does for equal p; rank / (1 + rank) spreads them evenly over (0, 1)
    bins = F.greatest(F.lit(1), F.ceil(F.col("n") / bin_rows))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins).cast("int"))
    ranked = table(ranked.drop("n", "worth_size", "worth", "p", "u", "hoped"), "mix-ranks")
    sure = ranked.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("sure_size"))
    filled = ranked.where(F.col("bin").isNotNull()).groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    filled = filled.withColumn("below", F.coalesce(F.sum("bin_size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    room = per.alias("a").join(sure.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", (F.col("target") - F.col("sure_size")).alias("room"))
    cut = filled.alias("f").join(room.alias("m"), F.col("f.source").eqNullSafe(F.col("m.source"))).select("f.*", "m.room")
    cut = cut.where((F.col("below") <= F.col("room")) & (F.col("below") + F.col("bin_size") > F.col("room")) | (F.col("below") + F.col("bin_size") == F.col("room")))
    # of bins that meet the room at both ends the last one cuts
    cut = cut.groupBy("source").agg(F.max_by(F.struct("bin", "below", "room"), "bin").alias("c")).select("source", "c.*")
    cut = table(cut, "mix-cuts")
    joined = ranked.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left").select("r.*", F.col("c.bin").alias("cut"), "c.below", "c.room")
    inside = joined.where(F.col("bin") == F.col("cut"))
    order = W.partitionBy("source").orderBy("rank", "doc_id", "th")
    upto = F.sum("size").over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    inside = inside.withColumn("extra", (F.col("below") + upto - F.col("size") / 2 <= F.col("room")).cast("int"))
    # with no cut the whole fraction fits: every ranked document is taken
    rest = joined.where(F.col("bin").isNull() | F.col("cut").isNull() | (F.col("bin") != F.col("cut")))
    rest = rest.withColumn("extra", F.coalesce((F.col("cut").isNull() | (F.col("bin") < F.col("cut"))) & F.col("bin").isNotNull(), F.lit(False)).cast("int"))
    every = inside.unionByName(rest).withColumn("copies", F.col("sure") + F.col("extra"))
    return every.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "th")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 150 - 100 * coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s
), l AS (
  SELECT *, room::DOUBLE / (100 * weights)::DOUBLE AS level FROM o
), f AS (
  SELECT min(level) AS fill FROM (SELECT level FROM l WHERE cap > weight * level ORDER BY 2 * source_size / weight, source NULLS LAST LIMIT 1)
), t AS (
  SELECT source, source_size, cap, CASE WHEN fill IS NULL OR cap <= weight * fill THEN cap::DOUBLE ELSE weight * fill END AS target FROM l, f
), h AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size::DOUBLE, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS hoped,
    (('0x' || substr(md5('29:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(1 << U_BITS)!r}::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(hoped)::BIGINT AS sure, hoped - floor(hoped) AS p FROM h
), r AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM p
), c AS (
  SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS left_open,
    sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r
)
SELECT doc_id, size, source_size, target, (size * (sure + CASE WHEN rank IS NOT NULL AND upto - size / 2 <= left_open THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


def mix(docs: DataFrame, share_percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 29, worth: str | None = None) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay."""
    copies = mix_sizes(docs, share_percent, most, weights, seed, worth=worth).groupBy("doc_id", "th").agg(F.max("copies").alias("copies"))
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    taken = docs.alias("d").join(copies.where("copies > 0").alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64("d.text") == F.col("c.th")))
    nth = f"copy {uuid.uuid4().hex}"
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias(nth)).drop(nth)
