"""Dictionary, run-length and delta encodings and their sizes, as window and aggregate plans.

Order always comes from explicit keys. Numbering restarts per group where a group is given, so that a column of many
groups numbers in parallel; one global order is one ordered pass by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: No dictionary may hold more values; a column that does is refused.
MAX_VALUES = 65_535


def dictionary(df: DataFrame, value: str, keys: list[str], most: int = MAX_VALUES) -> DataFrame:
    """(code, value): codes in order of first occurrence; one aggregate, then numbering over distinct values only, of which
    the task that numbers takes most + 1; a column with more than most raises."""
    first = df.groupBy(F.col(value).alias("value")).agg(F.min(F.struct(*keys)).alias("first")).orderBy("first").limit(most + 1)
    code = (F.row_number().over(Window.orderBy("first")) - 1).cast("long")
    return first.select(F.when(code < most, code).otherwise(F.raise_error(F.lit(f"the column has more than {most} values")).cast("long")).alias("code"), "value")


def encode(df: DataFrame, value: str, keys: list[str], codes: DataFrame) -> DataFrame:
    """Codes of the column's values; Spark broadcasts the dictionary when it is small and shuffles it otherwise."""
    return df.select(*keys, F.col(value).alias("value")).join(codes, "value").select(*keys, "code")


def decode(encoded: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Values of codes; codes outside the dictionary vanish."""
    return encoded.join(codes, "code").select(*keys, "value")


def run_lengths(df: DataFrame, value: str, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """(group..., run_id, value, run_length) of consecutive equal values."""
    order = Window.partitionBy(*(group or [])).orderBy(*keys)
    flagged = df.withColumn("_new", F.when(F.lag(value).over(order).eqNullSafe(F.col(value)) & (F.row_number().over(order) > 1), 0).otherwise(1))
    numbered = flagged.withColumn("run_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long") - 1)
    return numbered.groupBy(*(group or []), "run_id").agg(F.first(value).alias("value"), F.count("*").alias("run_length"))


def delta(df: DataFrame, value: str, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """The first value, then differences."""
    before = F.lag(value).over(Window.partitionBy(*(group or [])).orderBy(*keys))
    return df.select(*dict.fromkeys((group or []) + keys), F.coalesce(F.col(value) - before, F.col(value)).alias("delta"))


def undelta(deltas: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    order = Window.partitionBy(*(group or [])).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select(*dict.fromkeys((group or []) + keys), F.sum("delta").over(order).cast("long").alias("value"))


def sizes(counts: DataFrame) -> DataFrame:
    """Plain and dictionary byte sizes per column from value counts, and which one is chosen."""
    size = F.octet_length("value").cast("long")
    out = counts.groupBy("column_index", "column_name").agg(
        F.sum("c").alias("n"), F.count("*").alias("distinct_values"), (1 + F.sum(F.col("c") * (4 + size))).alias("plain_bytes"), (6 + F.sum(4 + size)).alias("_entries")
    )
    width = F.when(F.col("distinct_values") <= 255, 1).when(F.col("distinct_values") <= 65535, 2).otherwise(4)
    out = out.withColumn("id_width", width.cast("long")).withColumn("dictionary_bytes", F.col("_entries") + F.col("n") * F.col("id_width"))
    return out.withColumn("mode", F.when(F.col("dictionary_bytes") < F.floor(F.col("plain_bytes") * F.lit(0.95)), "dictionary").otherwise("plain")).drop("_entries")


def payload_size(column_sizes: DataFrame) -> DataFrame:
    """Bytes of the columnar payload: a 21-byte head and each column in its chosen form."""
    return column_sizes.agg((F.lit(21) + F.sum(F.when(F.col("mode") == "dictionary", F.col("dictionary_bytes")).otherwise(F.col("plain_bytes")))).cast("long").alias("payload_bytes"))
