"""Field-level expressions: rendering, byte lengths, the numeric grammar and name heuristics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: texts that parse as i64 or f64, sign, dot and exponent forms, inf, infinity and nan included.
NUMERIC = r"[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)"
#: A column name that contains one of these counts as numeric or date-like.
NAME_HINTS = ("date", "time", "ts", "amount", "price", "qty", "count", "id")
#: Distinct counts are exact up to CENSOR - 1.
CENSOR = 8193


def is_numeric(value: Column) -> Column:
    return value.rlike(rf"(?i)\A{NUMERIC}\z")


def is_numeric_trimmed(value: Column) -> Column:
    """The full-buffer analyser's looser test: surrounding white space is dropped and blank is not numeric."""
    return F.trim(value).rlike(rf"(?i)\A{NUMERIC}\z")


def is_numeric_or_date(name: Column, numeric: Column, observed: Column) -> Column:
    rate = F.when(observed > 0, (numeric.cast("float") / observed.cast("float")).cast("float")).otherwise(F.lit(0.0).cast("float"))
    return F.lower(name).rlike("|".join(NAME_HINTS)) | (rate >= F.lit(0.8).cast("float"))


def header_name(raw: Column) -> Column:
    """Strips one pair of surrounding quotes; a lone quote stays."""
    return F.when((F.octet_length(raw) >= 2) & raw.startswith('"') & raw.endswith('"'), F.expr("substring(raw, 2, length(raw) - 2)")).otherwise(raw)


def rendered(df: DataFrame, scale: int = 2) -> DataFrame:
    """Every scalar column as field text: doubles as decimal(18, scale), null as the empty field; arrays are skipped."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct")):
            continue
        value = F.col(f"`{name}`")
        if kind in ("double", "float"):
            value = value.cast(f"decimal(18,{scale})")
        out.append(F.coalesce(value.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def file_type(name: Column) -> Column:
    """csv, txt or unknown by extension, case-insensitively."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "csv", "csv").when(ext.isin("txt", "log"), "txt").otherwise("unknown")
