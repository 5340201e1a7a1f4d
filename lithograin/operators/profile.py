"""Column facts by one pass of plain aggregates.

Counts, empties, lengths and the numeric share are sums; distinct counts, asked for up to CENSOR, come from a theta sketch of
64-bit hashes, which is exact below its 2**SKETCH_BITS entries. So a column costs one bounded state a task, one row of it
is shuffled a task, and no value is. Full distinct values travel only where a result needs them (value_counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import CENSOR, is_numeric, rendered

SKETCH_BITS = 14


def unpivot(df: DataFrame) -> DataFrame:
    """(column_index, column_name, value) for a frame of field texts."""
    cells = F.array(*(F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(df.columns)))
    return df.select(F.inline(cells))


def value_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("column_index", "column_name", "value").agg(F.count("*").alias("c"))


def _aggregates(value: Column, numeric: Column) -> list[Column]:
    size = F.octet_length(value).cast("long")
    return [
        F.count("*").alias("observed_values"), F.sum((value == "").cast("long")).alias("empty_values"), F.sum(numeric.cast("long")).alias("numeric_values"), F.min(size).alias("min_len"),
        F.max(size).alias("max_len"), F.sum(size).alias("total_bytes"), F.theta_sketch_agg(F.xxhash64(value), SKETCH_BITS).alias("_distinct"),
    ]


def _finished(facts: DataFrame) -> DataFrame:
    distinct = F.theta_sketch_estimate("_distinct")
    return facts.select(
        "column_index", "column_name", "observed_values", "empty_values", "numeric_values", "min_len", "max_len", (F.col("total_bytes") / F.col("observed_values")).alias("mean_len"), "total_bytes",
        F.when(distinct >= CENSOR, "at_least").otherwise("exact").alias("cardinality_kind"), F.least(distinct, F.lit(CENSOR)).cast("long").alias("cardinality_value"),
    )


def facts_of_cells(cells: DataFrame) -> DataFrame:
    """One row per column of cells(column_index, column_name, value)."""
    value = F.col("value")
    return _finished(cells.groupBy("column_index", "column_name").agg(*_aggregates(value, is_numeric(value))))


#: Types whose texts are all numbers, or never are; others are put to the numeric grammar.
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "decimal")
_OTHERS = ("timestamp", "date", "boolean")


def column_facts(df: DataFrame, dataset: str, scale: int = 2) -> DataFrame:
    """One row per column of df; no rows for no rows."""
    texts, kinds, out = rendered(df, scale), dict(df.dtypes), []
    if not texts.columns:
        return facts_of_cells(df.sparkSession.createDataFrame([], "column_index int, column_name string, value string")).withColumn("dataset", F.lit(dataset))
    for i, name in enumerate(texts.columns):
        value, kind = F.col(f"`{name}`"), kinds[name]
        numeric = value != "" if kind.startswith(_NUMBERS) else F.lit(False) if kind.startswith(_OTHERS) else is_numeric(value)
        out.append([c.alias(f"{i}.{k}") for k, c in enumerate(_aggregates(value, numeric))])
    names = ("observed_values", "empty_values", "numeric_values", "min_len", "max_len", "total_bytes", "_distinct")
    one = texts.agg(*(c for column in out for c in column))
    rows = F.array(*(F.struct(F.lit(i).alias("column_index"), F.lit(name).alias("column_name"), *(F.col(f"`{i}.{k}`").alias(n) for k, n in enumerate(names))) for i, name in enumerate(texts.columns)))
    return _finished(one.select(F.inline(rows)).filter("observed_values > 0")).withColumn("dataset", F.lit(dataset))


def sampled(df: DataFrame, keys: list[str], rows: int = 10_000, max_bytes: int | None = None) -> DataFrame:
    """The first rows records in key order, and of those the longest prefix within max_bytes of field text and separators.

    TakeOrderedAndProject keeps the cut distributed; the byte prefix runs over at most rows records.
    """
    head = df.orderBy(*keys).limit(rows)
    if max_bytes is None:
        return head
    texts = rendered(df).columns
    size = sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) + 1 for c in texts[1:]), F.octet_length(F.coalesce(F.col(texts[0]).cast("string"), F.lit(""))) + 1)
    running = F.sum(size).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return head.withColumn("_bytes", running).filter(F.col("_bytes") <= max_bytes).drop("_bytes")


def name_status(headers: DataFrame) -> DataFrame:
    """headers(column_index, column_name): name_is_empty and the index of the first equal name before it."""
    first = F.min("column_index").over(Window.partitionBy("column_name"))
    return headers.select("column_index", "column_name", (F.col("column_name") == "").alias("name_is_empty"), F.when(first < F.col("column_index"), first).alias("duplicate_of"))


def legacy_stats(counts: DataFrame) -> DataFrame:
    """Full-buffer statistics from value counts: unique, repeated, mean length, all-numeric, and the suggested encoding."""
    from ..functions.fields import is_numeric_trimmed

    size = F.octet_length("value").cast("long")
    stats = counts.groupBy("column_index", "column_name").agg(
        F.sum("c").alias("n"), F.count("*").alias("unique_values"), F.sum(F.col("c") - 1).alias("repeated_values"),
        (F.sum(F.col("c") * size) / F.sum("c")).alias("mean_len"), F.min(is_numeric_trimmed(F.col("value"))).alias("all_numeric"),
    )
    suggestion = F.when((F.col("n") >= 2) & (F.col("repeated_values") > 0) & (2 * F.col("unique_values") <= F.col("n")), "dictionary").when(F.col("all_numeric"), "delta").otherwise("plain")
    return stats.withColumn("suggestion", suggestion)
