"""Sharding by a Feistel permutation with cycle walking over global row numbers; DataFrame functions only.

Law `rows`: row numbers 0..n-1 pass a keyed permutation of 0..n-1; the image modulo the shard count is the shard,
the quotient the slot. Shard sizes differ by one at most, slots are gapless, and shard and slot of a row can be
computed from its number and n alone. The permutation is a mixed-radix Feistel network on a*b >= n with
a = ceil(sqrt(n)), b = ceil(n/a); images outside 0..n-1 walk the cycle on. Fewer than a images lie outside, so a
walk of WALK steps falls short with probability below n**(-WALK/2); a row that did would raise, not go wrong.

Row numbers: equal (doc_id, size, crc) rows are first counted (so repeated rows never meet in one task), groups fall
into hash ranges (RANGES, or one to RANGE_ROWS rows of a larger table), ranges get offsets by a prefix sum of a row each, groups
are numbered inside each range and written out in blocks of at most BLOCK rows.

Defined results: null text has size 16 and crc32 0; null doc_id sorts first; repeated rows get numbers of their own;
no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

SHARDS = 40
RANGES, RANGE_ROWS = 4096, 1 << 20
BLOCK = 4096
ROUNDS = 6
WALK = 64
SEED = 20240229


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """The image of row number x (0..n-1) under the seeded permutation of 0..n-1."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    b = max(1, -(-n // a))

    def step(i: int):
        def left(s: Column) -> Column:
            return F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), s["r"]), F.lit(a).cast("long")), F.lit(a).cast("long")).alias("l"), s["r"].alias("r"))

        def right(s: Column) -> Column:
            return F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), s["l"]), F.lit(b).cast("long")), F.lit(b).cast("long")).alias("r"))

        return right if i % 2 else left

    def once(v: Column) -> Column:
        state = F.struct(F.floor(v / F.lit(b)).cast("long").alias("l"), F.pmod(v, F.lit(b).cast("long")).alias("r"))
        for i in range(ROUNDS):
            state = F.transform(F.array(state), step(i))[0]
        return F.transform(F.array(state), lambda s: s["l"] * F.lit(b).cast("long") + s["r"])[0]

    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), lambda v, _: F.when(v >= F.lit(n), once(v)).otherwise(v))
    return F.transform(F.array(out), lambda v: F.when(v < F.lit(n), v).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long")))[0]


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"))
    groups = stash(rows.groupBy("doc_id", "size", "crc").agg(F.count("*").alias("n")), "shard-groups")
    ranges = max(RANGES, groups.count() // RANGE_ROWS)
    groups = groups.withColumn("range", F.pmod(F.xxhash64("doc_id", "size", "crc"), F.lit(ranges)).cast("int"))
    per_range = groups.groupBy("range").agg(F.sum("n").alias("rows")).orderBy("range").collect()  # at most `ranges` rows
    start, offsets = 0, []
    for r in per_range:
        offsets.append((r["range"], start))
        start += r["rows"]
    total = start
    base = F.broadcast(spark.createDataFrame(offsets, "range int, base long"))  # a row to RANGE_ROWS rows, RANGES at least
    inside = Window.partitionBy("range").orderBy("doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = groups.withColumn("last", F.sum("n").over(inside)).join(base, "range").withColumn("first", F.col("base") + F.col("last") - F.col("n"))
    # a group of many equal rows is cut into blocks, which other tasks write out
    until = (F.col("first") + F.col("n")).alias("until")
    blocks = numbered.select("doc_id", "size", "crc", until, F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("first")).repartition("first")
    each = blocks.select("doc_id", "size", "crc", F.explode(F.sequence("first", F.least(F.col("first") + BLOCK, F.col("until")) - 1)).alias("row"))
    placed = each.withColumn("image", permuted(F.col("row"), total, seed))
    return placed.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.pmod("image", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("image") / F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark, table(spark, sf_dir, "documents"))
