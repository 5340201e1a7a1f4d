"""From column facts to an encoding per column and one storage decision per table; narrow expressions and one aggregate.

32-bit arithmetic is kept where results depend on it; sizes are 64-bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import CENSOR, is_numeric_or_date

MAX_DICTIONARY = 65_535
#: Reasons and their codes.
COLUMN_REASONS = {
    "Exceeded cardinality threshold": "CARDINALITY_THRESHOLD_EXCEEDED",
    "Very low cardinality with high repetition": "VERY_LOW_CARDINALITY_HIGH_REPETITION",
    "Repeated values likely benefit from dictionary IDs": "REPETITION_SUPPORTS_DICTIONARY",
    "Numeric/date heuristic matched": "NUMERIC_OR_DATE_HEURISTIC_MATCHED",
    "No strong dictionary signal": "NO_STRONG_DICTIONARY_SIGNAL",
}
TABLE_CODES = ("INSUFFICIENT_REPETITION_MAJORITY", "PROJECTED_DICTIONARY_SAVINGS_BELOW_THRESHOLD", "HIGH_REPETITION_DETECTED")
#: Reasons of the first two; the third names the dictionary columns.
TABLE_REASONS = (
    "Insufficient repetition across majority of columns for dictionary gains.",
    "Projected dictionary savings < 5%; RawZstd is more predictable.",
)
REASON_BYTES = 120

#: Expressions over facts columns.
UNIQUE = f"CASE WHEN cardinality_kind = 'at_least' THEN greatest(observed_values, {CENSOR}) ELSE cardinality_value END"
REPETITION = (
    "CASE WHEN observed_values = 0 OR cardinality_kind = 'at_least' THEN cast(0 AS float) ELSE "
    "greatest(least(cast(cast(1 AS float) - cast(cast(u AS float) / cast(observed_values AS float) AS float) AS float), cast(1 AS float)), cast(0 AS float)) END"
)
PROJECTED = "greatest(cast(ceil(u * cast({k} AS double)) AS bigint), u)"
DICTIONARY = "pu * (cast(ceil(cast(mean_len AS float)) AS bigint) + 4)"
WIDTH = "CASE WHEN pu <= 255 THEN 1 WHEN pu <= 65535 THEN 2 ELSE 4 END"
ROWS = "cast(ceil(greatest(observed_values, 1) * cast({k} AS double)) AS bigint)"
ENCODED = "dictionary_bytes + projected_rows * id_width"
RAW = "cast(ceil(total_bytes * cast({k} AS double)) AS bigint) + projected_rows"
KIB = "cast(floor((dictionary_bytes + 1023) / 1024) AS bigint)"
STRATEGY = (
    "CASE WHEN cardinality_kind = 'at_least' OR u > 65535 THEN 'raw' WHEN u <= 255 AND repetition >= cast(0.60 AS float) THEN 'dictionary' "
    "WHEN u <= 65535 AND repetition >= cast(0.20 AS float) THEN 'dictionary' WHEN numeric_or_date THEN 'delta_candidate' ELSE 'plain' END"
)
REASON = (
    "CASE WHEN cardinality_kind = 'at_least' OR u > 65535 THEN 'Exceeded cardinality threshold' WHEN u <= 255 AND repetition >= cast(0.60 AS float) THEN 'Very low cardinality with high repetition' "
    "WHEN u <= 65535 AND repetition >= cast(0.20 AS float) THEN 'Repeated values likely benefit from dictionary IDs' WHEN numeric_or_date THEN 'Numeric/date heuristic matched' ELSE 'No strong dictionary signal' END"
)
STEPS = (("u", UNIQUE), ("repetition", REPETITION), ("pu", PROJECTED), ("dictionary_bytes", DICTIONARY), ("id_width", WIDTH), ("projected_rows", ROWS), ("encoded_bytes", ENCODED), ("raw_bytes", RAW), ("dictionary_kib", KIB), ("strategy", STRATEGY), ("reason", REASON))


def column_plan(facts: DataFrame, byte_scale: float = 1.0) -> DataFrame:
    """facts plus projected sizes, strategy, reason and reason_code."""
    out = facts.withColumn("numeric_or_date", is_numeric_or_date(F.col("column_name"), F.col("numeric_values"), F.col("observed_values")))
    for name, text in STEPS:
        out = out.withColumn(name, F.expr(text.replace("{k}", repr(float(byte_scale)))))
    codes = F.create_map(*(F.lit(x) for pair in COLUMN_REASONS.items() for x in pair))
    return out.withColumn("reason_code", codes[F.col("reason")])


TABLE_AGGREGATES = {
    "columns": "cast(count(*) AS bigint)",
    "low_repetition": "cast(sum(CASE WHEN repetition < cast(0.10 AS float) THEN 1 ELSE 0 END) AS bigint)",
    "encoded": "cast(sum(encoded_bytes) AS bigint)",
    "raw": "cast(sum(raw_bytes) AS bigint)",
    "memory_mb": "round(cast(sum(CASE WHEN strategy = 'dictionary' THEN cast(dictionary_kib AS double) / 1024 ELSE 0 END) AS double), 6)",
    "dictionary_columns": "cast(sum(CASE WHEN strategy = 'dictionary' THEN 1 ELSE 0 END) AS bigint)",
}
SAVINGS = "CASE WHEN raw = 0 THEN 0.0 ELSE round(greatest(0.0, least(100.0, cast((1 - cast(encoded AS double) / raw) * 100 AS double))), 4) END"
CODE = (
    "CASE WHEN columns > 0 AND 100 * low_repetition >= 70 * columns THEN 'INSUFFICIENT_REPETITION_MAJORITY' "
    "WHEN encoded >= cast(0.95 AS double) * raw THEN 'PROJECTED_DICTIONARY_SAVINGS_BELOW_THRESHOLD' ELSE 'HIGH_REPETITION_DETECTED' END"
)


def table_plan(plan: DataFrame) -> DataFrame:
    """One row per dataset: totals, savings, mode, code and reason."""
    out = plan.groupBy("dataset").agg(*(F.expr(text).alias(name) for name, text in TABLE_AGGREGATES.items()))
    out = out.withColumn("savings_percent", F.expr(SAVINGS)).withColumn("code", F.expr(CODE))
    out = out.withColumn("mode", F.when(F.col("code") == "HIGH_REPETITION_DETECTED", "csv_columnar_dictionary").otherwise("raw_zstd"))
    high = F.concat(F.lit("High repetition detected in "), "dictionary_columns", F.lit("/"), "columns", F.lit(" columns."))
    return out.withColumn("reason", F.when(F.col("code") == TABLE_CODES[0], TABLE_REASONS[0]).when(F.col("code") == TABLE_CODES[1], TABLE_REASONS[1]).otherwise(high))


def stored_reason(reason: str) -> str:
    """A column's reason as plans keep it: at most REASON_BYTES bytes of UTF-8, cut between characters."""
    return reason.encode()[:REASON_BYTES].decode(errors="ignore")


def with_limitation(table: DataFrame, limitation: str | None) -> DataFrame:
    """Any limitation falls back to raw storage and keeps what the planner would have chosen."""
    fallback = F.lit(limitation).isNotNull()
    return (
        table.withColumn("recommended_mode", F.col("mode")).withColumn("mode", F.when(fallback, "raw_zstd").otherwise(F.col("mode")))
        .withColumn("code", F.when(fallback, "ANALYSIS_LIMITED_RAW_ZSTD_FALLBACK").otherwise(F.col("code")))
        .withColumn("selection_scope", F.when(fallback, "safe_fallback").otherwise("planner_recommendation"))
    )


def dictionary_limits(plan: DataFrame, max_values: int = MAX_DICTIONARY, max_mb: int = 64) -> DataFrame:
    """Dictionary columns beyond a limit become plain, with a warning."""
    over = (F.col("strategy") == "dictionary") & ((F.col("u") > max_values) | (F.col("dictionary_kib") > max_mb * 1024))
    return plan.withColumn("warning", F.when(over, F.lit("DICTIONARY_LIMIT_APPLIED"))).withColumn("strategy", F.when(over, "plain").otherwise(F.col("strategy")))


def execution(plan: DataFrame) -> DataFrame:
    """The executable projection: only dictionaries are carried out, all else is plain."""
    return plan.select("dataset", "column_index", "column_name", "strategy", F.when(F.col("strategy") == "dictionary", "dictionary").otherwise("plain").alias("mode"))


def plan_shape(exec_plan: DataFrame) -> DataFrame:
    """Is the plan dense from 0 and complete?"""
    n = F.count("*")
    return exec_plan.groupBy("dataset").agg(n.alias("columns"), ((F.min("column_index") == 0) & (F.max("column_index") == n - 1) & (F.countDistinct("column_index") == n)).alias("dense"))


def diagnostics(plan: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Codes per dataset and column, ordered by ord: empty name, duplicate name, censored cardinality."""
    censored = plan.filter("cardinality_kind = 'at_least'").select("dataset", "column_index", F.lit("CARDINALITY_LIMIT_REACHED").alias("code"), F.lit(3).alias("ord"))
    if names is None:
        return censored
    empty = names.filter("name_is_empty").select("dataset", "column_index", F.lit("EMPTY_COLUMN_NAME").alias("code"), F.lit(1).alias("ord"))
    twice = names.filter("duplicate_of IS NOT NULL").select("dataset", "column_index", F.lit("DUPLICATE_COLUMN_NAME").alias("code"), F.lit(2).alias("ord"))
    return empty.unionByName(twice).unionByName(censored)


#: Category and message of each recommendation; raw storage has one message a source of its selection.
ADVICE = {
    "STRUCTURED_COMPRESSION_RECOMMENDED": ("compression_strategy", "PlannerPolicyV1 recommends structured compression for the analyzed scope; compression retains its safe RawZstd fallback."),
    "RAW_ZSTD_RECOMMENDED": ("compression_strategy", "PlannerPolicyV1 recommends RawZstd for the analyzed scope."),
    "HIGH_CARDINALITY_OBSERVED": ("dataset_observation", "One or more columns reached a censored lower bound of at least 8193 distinct observed values."),
    "ANALYSIS_LIMITED": ("analysis_limitation", "Analysis is partial because a configured sampling or safety limit was reached."),
    "FULL_COMPARISON_RECOMMENDED": ("next_action", "Run Compare in Full mode when complete-input measurements and round-trip validation are needed."),
}
RAW_BY_SAFETY = "Analysis safety limits require the byte-preserving RawZstd fallback."
RAW_WITHOUT_ANALYSIS = "Structured analysis is unavailable; use the byte-preserving RawZstd fallback."


def advise(plan: DataFrame, table: DataFrame, partial: bool = False, limits: tuple[str, ...] = ()) -> DataFrame:
    """Ordered recommendations per dataset: code, category, message, and evidence as source:code or source:code:column,
    comma-joined. limits: the codes of what made the analysis partial."""
    safe = F.col("selection_scope") == "safe_fallback" if "selection_scope" in table.columns else F.lit(False)
    chosen = F.concat(F.when(safe, "safety_policy:").otherwise("planner_policy:"), "code")
    category, message = (F.create_map(*(F.lit(x) for code, pair in ADVICE.items() for x in (code, pair[i]))) for i in range(2))
    parts = [table.select("dataset", F.lit(1).alias("ord"), F.when(F.col("mode") == "raw_zstd", "RAW_ZSTD_RECOMMENDED").otherwise("STRUCTURED_COMPRESSION_RECOMMENDED").alias("name"), chosen.alias("evidence"), safe.alias("safe"))]
    at = F.col("column_index").cast("string")
    seen = F.concat(F.lit("analysis_diagnostic:CARDINALITY_LIMIT_REACHED:"), at, F.when(F.col("reason_code") == "CARDINALITY_THRESHOLD_EXCEEDED", F.concat(F.lit(",column_policy:CARDINALITY_THRESHOLD_EXCEEDED:"), at)).otherwise(""))
    high = plan.filter("cardinality_kind = 'at_least'").groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("column_index", seen.alias("e")))).alias("all"))  # a row a column
    parts.append(high.select("dataset", F.lit(2).alias("ord"), F.lit("HIGH_CARDINALITY_OBSERVED").alias("name"), F.array_join(F.transform("all", lambda x: x["e"]), ",").alias("evidence"), F.lit(False).alias("safe")))
    if partial:
        limiting = F.lit(",".join(f"analysis_diagnostic:{code}" for code in dict.fromkeys(limits))) if limits else chosen
        parts += [table.select("dataset", F.lit(i).alias("ord"), F.lit(name).alias("name"), limiting.alias("evidence"), F.lit(False).alias("safe")) for i, name in ((3, "ANALYSIS_LIMITED"), (4, "FULL_COMPARISON_RECOMMENDED"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("dataset", "ord", F.col("name").alias("code"), category[F.col("name")].alias("category"), F.when(F.col("safe"), RAW_BY_SAFETY).otherwise(message[F.col("name")]).alias("message"), "evidence")
