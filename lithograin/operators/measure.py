"""Ratios, throughputs, winners, the three medians, tuning grids and their recommendations, validation matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1048576


def ratio(source: Column, artifact: Column) -> Column:
    return F.when(artifact == 0, F.lit(0.0)).otherwise(source / artifact)


def throughput(size: Column, seconds: Column) -> Column:
    """MiB/s; null where either is zero."""
    return F.when((size > 0) & (seconds > 0), size / MIB / seconds)


def tune_throughput(size: Column, seconds: Column) -> Column:
    return size / MIB / F.greatest(seconds, F.lit(1e-9))


def winner(left: Column, right: Column, names: tuple[str, str]) -> Column:
    """The smaller one; equality and missing values tie."""
    return F.when(left < right, names[0]).when(right < left, names[1]).otherwise("tie")


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """average of the middles; upper middle; average of the middles, floored for integers."""
    out = df.groupBy(group).agg(F.median(value).alias("median_compare"), F.count(value).alias("_n"), F.median(F.floor(value)).alias("_m"))
    ranked = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    upto = F.sum("c").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upper = ranked.withColumn("upto", upto).join(out.select(group, "_n"), group).filter(F.col("upto") > F.floor(F.col("_n") / 2)).groupBy(group).agg(F.min(value).alias("median_benchmark"))
    return out.join(upper, group).select(group, "median_compare", "median_benchmark", F.floor("_m").cast("long").alias("median_tune"))


def grid(spark: SparkSession, chunks: list[int], threads: list[int], runs: int) -> DataFrame:
    """Sorted, distinct options times runs: a literal parameter grid of bounded size."""
    row = [(c, t, r) for c in sorted(set(chunks)) for t in sorted(set(threads)) for r in range(1, runs + 1)]
    return spark.createDataFrame(row, "chunk_size long, threads long, run int")


def in_flight(threads: Column) -> Column:
    return F.greatest(2 * threads, F.lit(4))


def peak_memory(chunk: Column, threads: Column, flight: Column) -> Column:
    return chunk * (flight + F.least(threads, flight))


def recommendations(configs: DataFrame) -> DataFrame:
    """configs(chunk_size, threads, throughput, ratio, memory): best throughput, ratio and balanced score; ties go to
    smaller chunks, then fewer threads (balanced: higher throughput first)."""
    span = configs.agg(*(f(c).alias(f"{n}_{c}") for c in ("throughput", "ratio", "memory") for n, f in (("lo", F.min), ("hi", F.max))))
    scored = configs.crossJoin(F.broadcast(span))  # one row

    def norm(c: str) -> Column:
        return F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), F.lit(1.0)).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))

    scored = scored.withColumn("score", F.lit(0.55) * norm("throughput") + F.lit(0.45) * norm("ratio") - F.lit(0.08) * norm("memory"))
    small = (-F.col("chunk_size")).alias("c"), (-F.col("threads")).alias("t")
    picks = {
        "throughput": F.struct("throughput", *small), "ratio": F.struct("ratio", *small), "balanced": F.struct("score", "throughput", *small),
    }
    best = scored.agg(*(F.max(p).alias(k) for k, p in picks.items()))
    one = [best.select(F.lit(k).alias("goal"), (-F.col(f"{k}.c")).alias("chunk_size"), (-F.col(f"{k}.t")).alias("threads")) for k in picks]
    return one[0].unionByName(one[1]).unionByName(one[2])


#: Why a benchmark is partial, in order.
PARTIAL_REASONS = {
    "no_baseline": "zstd baseline skipped",
    "no_roundtrip": "round-trip decompression skipped; output identity not validated",
    "no_hash": "SHA256 identity validation skipped",
    "prefix_limited": "only the configured input prefix was benchmarked",
}


def scope_status(options: DataFrame) -> DataFrame:
    """options(no_baseline, no_roundtrip, no_hash, prefix_limited, estimate_only): scope, status and partial reasons."""
    reasons = F.filter(F.array(*(F.when(F.col(k), F.lit(v)) for k, v in PARTIAL_REASONS.items())), lambda x: x.isNotNull())
    scope = F.when(F.col("estimate_only"), "estimate_only").when(F.col("prefix_limited"), "sampled").when(F.size(reasons) == 0, "full").otherwise("partial")
    status = F.when(F.col("no_hash") | F.col("no_roundtrip") | F.col("estimate_only"), "not_validated").when(F.col("prefix_limited"), "partially_validated").otherwise("validated")
    return options.withColumn("scope", scope).withColumn("validation_status", status).withColumn("partial_reasons", F.array_join(reasons, "|"))


CHECKS = ("header", "metadata", "payload_structure", "chunk_table", "trailing_data", "decompression", "restored_length", "per_chunk_sha256", "global_sha256")
_FIVE = CHECKS[:5]
#: Checks passed and failed by the stage at which validation stopped.
STAGES = {
    "header": ((), ("header",)),
    "metadata": (("header",), ("metadata",)),
    "metadata_limit": (("header",), ()),
    "chunk_table": (("header", "metadata"), ("chunk_table",)),
    "trailing_data": (("header", "metadata", "chunk_table"), ("trailing_data",)),
    "v1_payload": (("header", "metadata"), ("payload_structure", "decompression")),
    "v1_length": (("header", "metadata"), ("restored_length",)),
    "v2_payload": (_FIVE, ("decompression",)),
    "chunk_length": (_FIVE, ("restored_length",)),
    "chunk_hash": (_FIVE, ("per_chunk_sha256",)),
    "restored_length": ((*_FIVE, "decompression", "per_chunk_sha256"), ("restored_length",)),
    "global_hash": ((*_FIVE, "decompression", "restored_length", "per_chunk_sha256"), ("global_sha256",)),
}


def status_of(stage: str, check: str) -> str:
    passed, failed = STAGES[stage]
    if stage.startswith("v1") and check in ("chunk_table",):
        return "not_applicable"
    if stage.startswith("v1") and check in ("per_chunk_sha256", "global_sha256", "trailing_data"):
        return "not_available"
    return "passed" if check in passed else "failed" if check in failed else "not_completed"


def validation_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, c, status_of(s, c)) for s in STAGES for c in CHECKS], "stage string, check_name string, status string")
