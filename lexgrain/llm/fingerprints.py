"""Document fingerprints: SimHash with DataFrame operations only.

A document's terms are its runs of three words (all its words where it has fewer).
Each occurrence votes, so a term's weight is its count: a 1 bit of its hash votes
for, a 0 bit against, and the signs of the sums are the bits of the fingerprint.
Two bit counters share one 64-bit sum, 32 bits each, which holds 4 billion terms.

`within_radius` finds all fingerprints within a Hamming radius by permuted block
tables: with B blocks and radius r, some B - r blocks agree exactly, so one table for
each choice of B - r blocks, keyed by them, holds every pair; a count of differing
bits confirms.  Equal fingerprints are collapsed first.  `fingerprint_edits` asks it for
every ASKED-th identifier, against the fingerprints of all rows.

Results for odd input: a null text counts as empty; no terms give the zero
fingerprint; an empty table gives an empty result; equal texts have equal
fingerprints; rows that repeat an identifier stay separate, ordered by text, and
rows that repeat both too; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, partitions, table

HALVES, LANES = 2, 32
BITS = HALVES * 64
#: Rows whose identifier is divisible by ASKED are searched for; their neighbours differ in RADIUS bits at most.
ASKED, RADIUS = 20, 3


def fingerprints(texts: DataFrame, keys: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, f0, f1 (64 bits each) for each row of texts(keys..., text, carry...); keys name a row, carry are its longs."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), f"^{SPACE}|{SPACE}$", "")
    words = texts.select(*keys, *carry, F.split(clean, SPACE).alias("w"))
    n = F.size("w")
    runs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, n).alias("b"), F.slice("w", 3, n).alias("c"))
    terms = words.select(*keys, *carry, n.alias("n"), F.posexplode(runs).alias("i", "t"))
    # of three words and more only full runs vote; of fewer, the one run that starts at the first word
    terms = terms.where((F.col("i") == 0) | (F.col("i") < F.col("n") - 2))
    hashed = terms.select(*keys, *carry, (F.length("t.a") > 0).cast("long").alias("v"), F.xxhash64("t.a", "t.b", "t.c").alias("h0"))
    hashed = hashed.withColumn("h1", F.xxhash64("h0", F.lit(7)))
    mask = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned(f"h{h}", j).bitwiseAND(mask) * F.col("v")).alias(f"s{h}_{j}") for h in range(HALVES) for j in range(LANES)]
    voted = hashed.groupBy(*keys).agg(F.sum("v").alias("votes"), *[F.max(c).alias(c) for c in carry], *sums)

    def half(h: int) -> Column:
        low = [F.when(F.col(f"s{h}_{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("votes"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(LANES)]
        high = [F.when(F.shiftrightunsigned(f"s{h}_{j}", 32) * 2 > F.col("votes"), F.lit((1 << (j + 32)) - ((1 << 64) if j == 31 else 0))).otherwise(F.lit(0)) for j in range(LANES)]
        out = F.lit(0).cast("long")
        for x in low + high:
            out = out.bitwiseOR(x.cast("long"))
        return out

    return voted.select(*keys, *carry, *[half(h).alias(f"f{h}") for h in range(HALVES)])


def hexed(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """1 less the share of differing bits."""
    return 1.0 - (F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))) / F.lit(float(BITS))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id, next_text, part, nth (together a row's own) in descending doc_id (null last, repeated identifiers by text; after the last the first).

    Identifiers are range-partitioned at splitters that are identifiers of the table; each
    splitter's rows are also sent to the range below, where the row before them needs them."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    got = rows.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)] or [0.5], 10_000).alias("q"), F.max("doc_id").alias("top")).first()
    cuts = sorted(set(got["q"] or []))
    top = got["top"]
    # range k holds the identifiers in (cuts[k-1], cuts[k]]; null identifiers are in range 0, below the rest
    at = F.lit(0)
    if cuts:
        at = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("doc_id"))))
    own = F.array(F.struct(at.alias("part"), F.lit(0).alias("ghost")))
    up = F.when(F.col("doc_id").isin(cuts), F.array(F.struct((at + 1).alias("part"), F.lit(1).alias("ghost")))) if cuts else F.lit(None)
    wrap = F.when(F.col("doc_id").eqNullSafe(F.lit(top).cast("long")), F.array(F.struct(F.lit(0).alias("part"), F.lit(2).alias("ghost"))))
    none = F.array().cast("array<struct<part:int,ghost:int>>")
    dealt = rows.select("doc_id", "text", F.explode(F.concat(own, F.coalesce(up.cast("array<struct<part:int,ghost:int>>"), none), F.coalesce(wrap, none))).alias("p")).select("doc_id", "text", "p.part", "p.ghost")
    # ghosts stand after the rows of their range: first the range below's top row, at the very end the table's first
    w = W.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("text"))
    return dealt.repartitionByRange(n, "part").withColumns({"next_text": F.lead("text").over(w), "next_id": F.lead("doc_id").over(w), "nth": F.row_number().over(w).cast("long")}).where("ghost = 0").select("doc_id", "text", "next_id", "next_text", "part", "nth")


#: A SHA-256 in hex travels as five longs of 13 digits, which a hash aggregate can hold.
SHA_PARTS = [(1 + 13 * i, 13 if i < 4 else 12) for i in range(5)]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within of every row.

    n_within: where ASKED divides the identifier, how many other distinct fingerprints lie within RADIUS bits; null elsewhere.
    The edited text's last floor(n_chars / 3) code points give way to as many first ones (or all) of the next document."""
    n = F.char_length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m))
    rows = with_next(docs).select("part", "nth", "doc_id", F.xxhash64("text").alias("th"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_id", F.xxhash64("next_text").alias("next_th"))
    rows = rows.withColumn("sha", F.sha2(F.encode("edited", "UTF-8"), 256))
    sha = [F.conv(F.substring("sha", at, k), 16, 10).cast("long").alias(f"x{i}") for i, (at, k) in enumerate(SHA_PARTS)]
    carry = ("doc_id", "th", "n_chars", "next_id", "next_th", *[f"x{i}" for i in range(5)])
    both = F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text"))))
    texts = rows.select("part", "nth", *carry[:5], *sha, both.alias("e")).select("part", "nth", *carry, "e.edit", "e.text")
    voted = fingerprints(texts, ("part", "nth", "edit"), carry)
    own, other = F.col("edit") == 0, F.col("edit") == 1
    picks = [F.max(F.when(w, F.col(f))).alias(a) for w, f, a in ((own, "f0", "f0"), (own, "f1", "f1"), (other, "f0", "e0"), (other, "f1", "e1"))]
    each = table(voted.groupBy("part", "nth").agg(*[F.max(c).alias(c) for c in carry], *picks), "fingerprints")
    after = each.select(F.col("doc_id").alias("next_id"), F.col("th").alias("next_th"), F.col("f0").alias("g0"), F.col("f1").alias("g1")).dropDuplicates(["next_id", "next_th"])
    joined = each.alias("a").join(after.alias("b"), F.col("a.next_id").eqNullSafe(F.col("b.next_id")) & (F.col("a.next_th") == F.col("b.next_th")), "left")
    asked = F.col("doc_id") % ASKED == 0
    found = within_radius(each.where(asked), each, RADIUS).where("distance > 0")
    counts = table(found.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("others")), "fingerprint-neighbours")
    joined = joined.join(counts.alias("n"), (F.col("a.f0") == F.col("n.f0")) & (F.col("a.f1") == F.col("n.f1")), "left")
    digest = F.concat(*[F.lpad(F.hex(f"x{i}"), k, "0") for i, (_, k) in enumerate(SHA_PARTS)])
    joined = joined.select(F.col("a.*"), "g0", "g1", F.when(asked, F.coalesce("others", F.lit(0))).alias("n_within"))
    return joined.select(
        "doc_id", "n_chars", F.lower(digest).alias("edited_sha256"), hexed("f0", "f1").alias("fingerprint"), hexed("e0", "e1").alias("edited_fingerprint"),
        likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), likeness(("f0", "f1"), ("g0", "g1")).alias("near_next"), "n_within",
    )


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """f0, f1, g0, g1, distance: every distinct fingerprint (g0, g1) of index within radius of a distinct one (f0, f1) of queries."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("0 <= radius < blocks")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def signed(mask: int) -> Column:
        return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")

    def tables(df: DataFrame, a: str, b: str) -> DataFrame:
        """Each distinct fingerprint once a table, keyed by the bits of the table's blocks."""
        rows = df.select(F.col("f0").alias(a), F.col("f1").alias(b)).distinct()
        keys = []
        for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
            mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
            keys.append(F.struct(F.lit(k).alias("k"), F.col(a).bitwiseAND(signed(mask & (1 << 64) - 1)).alias("u"), F.col(b).bitwiseAND(signed(mask >> 64)).alias("v")))
        return rows.select(a, b, F.explode(F.array(*keys)).alias("e")).select(a, b, "e.k", "e.u", "e.v")

    d = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1")))
    pairs = tables(queries, "f0", "f1").join(tables(index, "g0", "g1"), ["k", "u", "v"]).where(d <= radius)
    return pairs.select("f0", "f1", "g0", "g1", d.alias("distance")).distinct()
