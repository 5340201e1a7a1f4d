"""Column facts over a stream: one stateful aggregate, a row of state per column.

Counts, lengths and the numeric share are exact; the distinct count is a sketch, since exact counts would need state for
every value. Runs in complete or update mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import is_numeric, rendered
from ..operators.profile import unpivot


def stream_facts(stream: DataFrame, scale: int = 2, error: float = 0.02) -> DataFrame:
    size = F.octet_length("value").cast("long")
    return unpivot(rendered(stream, scale)).groupBy("column_index", "column_name").agg(
        F.count("*").alias("observed_values"), F.sum((F.col("value") == "").cast("long")).alias("empty_values"), F.sum(is_numeric(F.col("value")).cast("long")).alias("numeric_values"),
        F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.sum(size).alias("total_bytes"), F.approx_count_distinct("value", error).alias("approx_distinct"),
    )
