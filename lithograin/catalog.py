"""Every query of the core library with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fields
from .operators import chunks, codec, encoding, measure, profile, text
from .plans import policy
from .sources import synthetic

I, D, S, T = "int", "double", "string", "timestamp"
#: Columns of the tables; arrays are not profiled.
TABLES = {
    "region": {"r_regionkey": I, "r_name": S},
    "nation": {"n_nationkey": I, "n_name": S, "n_regionkey": I},
    "customer": {"c_custkey": I, "c_name": S, "c_nationkey": I, "c_acctbal": D, "c_mktsegment": S},
    "supplier": {"s_suppkey": I, "s_name": S, "s_nationkey": I, "s_acctbal": D},
    "part": {"p_partkey": I, "p_name": S, "p_brand": S, "p_type": S, "p_size": I, "p_retailprice": D},
    "orders": {"o_orderkey": I, "o_custkey": I, "o_orderstatus": S, "o_totalprice": D, "o_orderdate": T, "o_orderpriority": S},
    "lineitem": {"l_orderkey": I, "l_partkey": I, "l_suppkey": I, "l_linenumber": I, "l_quantity": D, "l_extendedprice": D, "l_discount": D, "l_tax": D, "l_returnflag": S, "l_linestatus": S, "l_shipdate": T},
    "events": {"event_id": I, "ts": T, "user_id": I, "event_type": S, "value": D, "props": S},
    "documents": {"doc_id": I, "text": S, "lang": S, "source": S, "n_chars": I},
    "pages": {"page_id": I, "url": S, "html": S},
    "benchmark": {"item_id": I, "text": S},
    "conversations": {"conv_id": I, "turn": I, "role": S, "text": S},
    "labels": {"doc_id": I, "quality": I, "toxic": I},
}
FACTS = "dataset, column_index, column_name, observed_values, empty_values, numeric_values, min_len, max_len, mean_len, total_bytes, cardinality_kind, cardinality_value"
#: Written apart from functions/fields.py, so that an error there shows.
NUMBER_SQL = "regexp_full_match({v}, '[-+]?((inf(inity)?|nan)|[0-9]+([.][0-9]*)?(e[-+]?[0-9]+)?|[.][0-9]+(e[-+]?[0-9]+)?)', 'i')"
NUMERIC_SQL = NUMBER_SQL.format(v="v")

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# --- profiles -------------------------------------------------------------------------------------------------------


def cells_sql(name: str, source: str | None = None, columns=None) -> str:
    """(i, name, v) of a table as field texts."""
    one = "SELECT {i} AS i, '{c}' AS name, coalesce({v}, '') AS v FROM {t}"
    cast = {D: "CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"}
    return " UNION ALL ".join(one.format(i=i, c=c, t=source or name, v=cast.get(k, "CAST({c} AS VARCHAR)").format(c=c)) for i, (c, k) in enumerate(TABLES[name].items()) if not columns or c in columns)


def facts_sql(name: str, source: str | None = None) -> str:
    return f"""SELECT '{name}' AS dataset, i::INT AS column_index, name AS column_name, sum(c)::BIGINT AS observed_values, sum(CASE WHEN v = '' THEN c ELSE 0 END)::BIGINT AS empty_values,
  sum(CASE WHEN {NUMERIC_SQL} THEN c ELSE 0 END)::BIGINT AS numeric_values, min(strlen(v))::BIGINT AS min_len, max(strlen(v))::BIGINT AS max_len,
  sum(c * strlen(v))::DOUBLE / sum(c)::DOUBLE AS mean_len, sum(c * strlen(v))::BIGINT AS total_bytes,
  CASE WHEN count(*) >= 8193 THEN 'at_least' ELSE 'exact' END AS cardinality_kind, least(count(*), 8193)::BIGINT AS cardinality_value
FROM (SELECT i, name, v, count(*) AS c FROM ({cells_sql(name, source)}) GROUP BY ALL) GROUP BY i, name"""


def plan_sql(facts: str) -> str:
    """The planner over a facts query for a whole table, written apart from plans/policy.py: from distinct counts and sizes
    to one of five verdicts a column."""
    return f"""SELECT q.*, r.strategy, r.reason, r.reason_code FROM (
  SELECT *, CASE WHEN cardinality_kind <> 'exact' OR u >= 65536 THEN 1 WHEN repetition >= 0.6::FLOAT AND u < 256 THEN 2 WHEN repetition >= 0.2::FLOAT THEN 3 WHEN numeric_or_date THEN 4 ELSE 5 END AS verdict
  FROM (SELECT *, dict + observed_values * (CASE WHEN u < 256 THEN 1 WHEN u < 65536 THEN 2 ELSE 4 END) AS encoded_bytes, total_bytes + observed_values AS raw_bytes, (dict + 1023) // 1024 AS dictionary_kib,
      (CASE WHEN cardinality_kind = 'exact' THEN 1::FLOAT - u::FLOAT / observed_values::FLOAT ELSE 0 END)::FLOAT AS repetition
    FROM (SELECT *, u * (ceil(mean_len::FLOAT)::BIGINT + 4) AS dict,
        list_bool_or(list_transform(['date', 'time', 'ts', 'amount', 'price', 'qty', 'count', 'id'], lambda h: contains(lower(column_name), h))) OR numeric_values::FLOAT / observed_values::FLOAT >= 0.8::FLOAT AS numeric_or_date
      FROM (SELECT *, CASE WHEN cardinality_kind = 'exact' THEN cardinality_value WHEN observed_values < 8193 THEN 8193 ELSE observed_values END AS u FROM ({facts}))))) q
JOIN (VALUES (1, 'raw', 'Exceeded cardinality threshold', 'CARDINALITY_THRESHOLD_EXCEEDED'), (2, 'dictionary', 'Very low cardinality with high repetition', 'VERY_LOW_CARDINALITY_HIGH_REPETITION'),
  (3, 'dictionary', 'Repeated values likely benefit from dictionary IDs', 'REPETITION_SUPPORTS_DICTIONARY'), (4, 'delta_candidate', 'Numeric/date heuristic matched', 'NUMERIC_OR_DATE_HEURISTIC_MATCHED'),
  (5, 'plain', 'No strong dictionary signal', 'NO_STRONG_DICTIONARY_SIGNAL')) r(verdict, strategy, reason, reason_code) USING (verdict)"""


PLAN = "dataset, column_index, column_name, u AS unique_values, repetition, encoded_bytes, raw_bytes, dictionary_kib, strategy, reason"
PLAN_SQL = "dataset, column_index, column_name, CAST(u AS BIGINT) AS unique_values, CAST(repetition AS FLOAT) AS repetition, CAST(encoded_bytes AS BIGINT) AS encoded_bytes, CAST(raw_bytes AS BIGINT) AS raw_bytes, CAST(dictionary_kib AS BIGINT) AS dictionary_kib, strategy, reason"


def facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return profile.column_facts(table(spark, sf_dir, name), name)


def plan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return policy.column_plan(facts(spark, sf_dir, name))


def all_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in TABLES:
        one = plan(spark, sf_dir, name)
        out = one if out is None else out.unionByName(one)
    return out


ALL_SQL = " UNION ALL ".join(f"({plan_sql(facts_sql(name))})" for name in TABLES)
TABLE_SQL = f"""SELECT *, CASE WHEN low_repetition >= 0.7::DOUBLE * columns THEN 'INSUFFICIENT_REPETITION_MAJORITY' WHEN 20 * encoded >= 19 * raw THEN 'PROJECTED_DICTIONARY_SAVINGS_BELOW_THRESHOLD' ELSE 'HIGH_REPETITION_DETECTED' END AS code,
  round(CASE WHEN encoded >= raw THEN 0 ELSE 100 - 100 * encoded / raw END::DOUBLE, 4) AS savings_percent
FROM (SELECT dataset, count(*) AS columns, count(*) FILTER (repetition < 0.1::FLOAT) AS low_repetition, sum(encoded_bytes)::BIGINT AS encoded, sum(raw_bytes)::BIGINT AS raw,
    round(coalesce(sum(dictionary_kib) FILTER (strategy = 'dictionary'), 0) / 1024.0::DOUBLE, 6) AS memory_mb, count(*) FILTER (strategy = 'dictionary') AS dictionary_columns FROM ({ALL_SQL}) GROUP BY dataset)"""


def _profiles() -> None:
    for name in TABLES:
        query(f"profile_{name}", facts_sql(name))(lambda spark, sf_dir, name=name: facts(spark, sf_dir, name).selectExpr(*FACTS.split(", ")))
    for name in ("lineitem", "orders", "events"):
        query(f"column_plan_{name}", f"SELECT {PLAN_SQL} FROM ({plan_sql(facts_sql(name))})")(lambda spark, sf_dir, name=name: plan(spark, sf_dir, name).selectExpr(*PLAN.split(", ")))


_profiles()


@query("profile_sampled_lineitem", facts_sql("lineitem", "(SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice LIMIT 10000)"))
def profile_sampled_lineitem(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    return profile.column_facts(profile.sampled(table(spark, sf_dir, "lineitem"), keys), "lineitem").selectExpr(*FACTS.split(", "))


HEADERS = ["id", "name", "", "id", "note", "", "name"]


@query("profile_name_status", "SELECT i::INT AS column_index, h AS column_name, h = '' AS name_is_empty, CASE WHEN min(i) OVER (PARTITION BY h) < i THEN min(i) OVER (PARTITION BY h) END::INT AS duplicate_of FROM (VALUES " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(HEADERS)) + ") t(i, h)")
def profile_name_status(spark, sf_dir):
    return profile.name_status(spark.createDataFrame(list(enumerate(HEADERS)), "column_index int, column_name string"))


def _two(sql: str) -> str:
    return " UNION ALL ".join(f"({sql.format(facts=facts_sql(n))})" for n in ("lineitem", "events"))


@query("cardinality_censored", _two("SELECT dataset, column_name, cardinality_kind, cardinality_value FROM ({facts})"))
def cardinality_censored(spark, sf_dir):
    return facts(spark, sf_dir, "lineitem").unionByName(facts(spark, sf_dir, "events")).select("dataset", "column_name", "cardinality_kind", "cardinality_value")


@query("repetition_rate_planner", f"SELECT column_name, CAST(repetition AS FLOAT) AS repetition FROM ({plan_sql(facts_sql('lineitem'))})")
def repetition_rate_planner(spark, sf_dir):
    return plan(spark, sf_dir, "lineitem").select("column_name", "repetition")


@query("repetition_rate_report", f"SELECT column_name, CASE WHEN cardinality_kind = 'exact' AND observed_values > 0 THEN 1.0::DOUBLE - cardinality_value::DOUBLE / observed_values::DOUBLE END AS repetition FROM ({facts_sql('lineitem')})")
def repetition_rate_report(spark, sf_dir):
    rate = F.when((F.col("cardinality_kind") == "exact") & (F.col("observed_values") > 0), F.lit(1.0) - F.col("cardinality_value") / F.col("observed_values"))
    return facts(spark, sf_dir, "lineitem").select("column_name", rate.alias("repetition"))


@query("numeric_or_date_flag", " UNION ALL ".join(f"(SELECT dataset, column_name, numeric_values, numeric_or_date FROM ({plan_sql(facts_sql(n))}))" for n in ("orders", "events")))
def numeric_or_date_flag(spark, sf_dir):
    return plan(spark, sf_dir, "orders").unionByName(plan(spark, sf_dir, "events")).select("dataset", "column_name", "numeric_values", "numeric_or_date")


TABLE_COLUMNS = "dataset columns low_repetition encoded raw memory_mb dictionary_columns code savings_percent mode reason".split()


@query(
    "table_plan_all",
    f"""SELECT *, CASE code WHEN 'HIGH_REPETITION_DETECTED' THEN 'csv_columnar_dictionary' ELSE 'raw_zstd' END AS mode, CASE code WHEN 'HIGH_REPETITION_DETECTED' THEN format('High repetition detected in {{}}/{{}} columns.', dictionary_columns, columns)
  WHEN 'PROJECTED_DICTIONARY_SAVINGS_BELOW_THRESHOLD' THEN 'Projected dictionary savings < 5%; RawZstd is more predictable.' ELSE 'Insufficient repetition across majority of columns for dictionary gains.' END AS reason FROM ({TABLE_SQL})""",
)
def table_plan_all(spark, sf_dir):
    return policy.table_plan(all_plans(spark, sf_dir)).select(*TABLE_COLUMNS)


@query("dictionary_limits_applied", f"SELECT column_index, column_name, CASE WHEN strategy = 'dictionary' AND u > 1000 THEN 'plain' ELSE strategy END AS strategy, CASE WHEN strategy = 'dictionary' AND u > 1000 THEN 'DICTIONARY_LIMIT_APPLIED' END AS warning FROM ({plan_sql(facts_sql('orders'))})")
def dictionary_limits_applied(spark, sf_dir):
    return policy.dictionary_limits(plan(spark, sf_dir, "orders"), max_values=1000).select("column_index", "column_name", "strategy", "warning")


@query("execution_modes", f"SELECT column_index, column_name, strategy, CASE WHEN strategy = 'dictionary' THEN 'dictionary' ELSE 'plain' END AS mode FROM ({plan_sql(facts_sql('orders'))})")
def execution_modes(spark, sf_dir):
    return policy.execution(plan(spark, sf_dir, "orders")).drop("dataset")


@query("plan_shape", f"SELECT dataset, count(*)::BIGINT AS columns, min(column_index) = 0 AND max(column_index) = count(*) - 1 AS dense FROM ({ALL_SQL}) GROUP BY dataset")
def plan_shape(spark, sf_dir):
    return policy.plan_shape(policy.execution(all_plans(spark, sf_dir)))


@query("plan_reason_codes", f"SELECT dataset, column_name, reason_code FROM ({ALL_SQL})")
def plan_reason_codes(spark, sf_dir):
    return all_plans(spark, sf_dir).select("dataset", "column_name", "reason_code")


@query("plan_diagnostics", f"SELECT dataset, column_index, 'CARDINALITY_LIMIT_REACHED' AS code, 3 AS ord FROM ({ALL_SQL}) WHERE cardinality_kind = 'at_least'")
def plan_diagnostics(spark, sf_dir):
    return policy.diagnostics(all_plans(spark, sf_dir))


@query(
    "advisor_recommendations",
    f"""SELECT dataset, 1 AS ord, 'STRUCTURED_COMPRESSION_RECOMMENDED' AS code, 'compression_strategy' AS category, 'PlannerPolicyV1 recommends structured compression for the analyzed scope; compression retains its safe RawZstd fallback.' AS message, 'planner_policy:' || code AS evidence FROM ({TABLE_SQL}) WHERE code = 'HIGH_REPETITION_DETECTED'
UNION ALL SELECT dataset, 1, 'RAW_ZSTD_RECOMMENDED', 'compression_strategy', 'PlannerPolicyV1 recommends RawZstd for the analyzed scope.', 'planner_policy:' || code FROM ({TABLE_SQL}) WHERE code <> 'HIGH_REPETITION_DETECTED'
UNION ALL SELECT dataset, 2, 'HIGH_CARDINALITY_OBSERVED', 'dataset_observation', 'One or more columns reached a censored lower bound of at least 8193 distinct observed values.',
  string_agg(format('analysis_diagnostic:CARDINALITY_LIMIT_REACHED:{{0}},column_policy:CARDINALITY_THRESHOLD_EXCEEDED:{{0}}', column_index), ',' ORDER BY column_index) FROM ({ALL_SQL}) WHERE cardinality_kind = 'at_least' GROUP BY dataset""",
)
def advisor_recommendations(spark, sf_dir):
    plans = all_plans(spark, sf_dir)
    plans = spark.createDataFrame(plans.collect(), plans.schema)  # a row a column, read twice
    return policy.advise(plans, policy.table_plan(plans))


LEGACY_NUMERIC = NUMBER_SQL.format(v="trim(v)")


@query(
    "legacy_csv_stats_orders",
    f"SELECT *, CASE WHEN n >= 2 AND repeated_values > 0 AND 2 * unique_values <= n THEN 'dictionary' WHEN all_numeric THEN 'delta' ELSE 'plain' END AS suggestion FROM (SELECT i::INT AS column_index, name AS column_name, sum(c)::BIGINT AS n, count(*)::BIGINT AS unique_values, sum(c - 1)::BIGINT AS repeated_values, sum(c * strlen(v))::DOUBLE / sum(c)::DOUBLE AS mean_len, bool_and({LEGACY_NUMERIC}) AS all_numeric FROM (SELECT i, name, v, count(*) AS c FROM ({cells_sql('orders')}) GROUP BY ALL) GROUP BY i, name)",
)
def legacy_csv_stats_orders(spark, sf_dir):
    return profile.legacy_stats(profile.value_counts(profile.unpivot(fields.rendered(table(spark, sf_dir, "orders")))))


# --- encodings ------------------------------------------------------------------------------------------------------

DICT_SQL = "SELECT row_number() OVER (ORDER BY k) - 1 AS code, v AS value FROM (SELECT o_orderpriority AS v, min(o_orderkey) AS k FROM orders GROUP BY 1)"


def _dictionary(spark, sf_dir):
    return encoding.dictionary(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"])


query("dictionary_table_orders", DICT_SQL)(_dictionary)


@query("dictionary_codes_orders", f"SELECT o_orderkey, code FROM orders JOIN ({DICT_SQL}) d ON d.value = o_orderpriority")
def dictionary_codes_orders(spark, sf_dir):
    return encoding.encode(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"], _dictionary(spark, sf_dir))


@query("dictionary_decode_roundtrip", "SELECT o_orderkey, o_orderpriority AS value FROM orders")
def dictionary_decode_roundtrip(spark, sf_dir):
    return encoding.decode(dictionary_codes_orders(spark, sf_dir), _dictionary(spark, sf_dir), ["o_orderkey"])


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@query(
    "rle_runs_lineitem",
    "WITH a AS (SELECT l_suppkey, l_returnflag AS v, row_number() OVER w AS p, lag(l_returnflag) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice)), "
    "r AS (SELECT l_suppkey, v, sum(CASE WHEN p > 1 AND b IS NOT DISTINCT FROM v THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY p) - 1 AS run_id FROM a) "
    "SELECT l_suppkey, run_id::BIGINT AS run_id, any_value(v) AS value, count(*) AS run_length FROM r GROUP BY l_suppkey, run_id",
)
def rle_runs_lineitem(spark, sf_dir):
    return encoding.run_lengths(table(spark, sf_dir, "lineitem"), "l_returnflag", [k for k in LINE_KEYS if k != "l_suppkey"], ["l_suppkey"])


@query("delta_encode_orders", "SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS delta FROM orders")
def delta_encode_orders(spark, sf_dir):
    return encoding.delta(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderkey"], ["o_custkey"])


@query("delta_decode_orders", "SELECT o_custkey, o_orderkey, o_orderkey AS value FROM orders")
def delta_decode_orders(spark, sf_dir):
    return encoding.undelta(delta_encode_orders(spark, sf_dir), ["o_orderkey"], ["o_custkey"])


def sizes_sql(name: str) -> str:
    base = f"SELECT i::INT AS column_index, name AS column_name, sum(c)::BIGINT AS n, count(*)::BIGINT AS distinct_values, (1 + sum(c * (4 + strlen(v))))::BIGINT AS plain_bytes, (CASE WHEN count(*) <= 255 THEN 1 WHEN count(*) <= 65535 THEN 2 ELSE 4 END)::BIGINT AS id_width, (6 + sum(4 + strlen(v)) + sum(c) * (CASE WHEN count(*) <= 255 THEN 1 WHEN count(*) <= 65535 THEN 2 ELSE 4 END))::BIGINT AS dictionary_bytes FROM (SELECT i, name, v, count(*) AS c FROM ({cells_sql(name)}) GROUP BY ALL) GROUP BY i, name"
    return f"SELECT *, CASE WHEN dictionary_bytes < floor(plain_bytes::DOUBLE * 0.95::DOUBLE) THEN 'dictionary' ELSE 'plain' END AS mode FROM ({base})"


def _sizes(spark, sf_dir, name):
    return encoding.sizes(profile.value_counts(profile.unpivot(fields.rendered(table(spark, sf_dir, name)))))


@query("encoding_sizes_lineitem", sizes_sql("lineitem"))
def encoding_sizes_lineitem(spark, sf_dir):
    return _sizes(spark, sf_dir, "lineitem")


@query("columnar_payload_size", f"SELECT (21 + sum(CASE WHEN mode = 'dictionary' THEN dictionary_bytes ELSE plain_bytes END))::BIGINT AS payload_bytes FROM ({sizes_sql('orders')})")
def columnar_payload_size(spark, sf_dir):
    return encoding.payload_size(_sizes(spark, sf_dir, "orders"))


# --- text -----------------------------------------------------------------------------------------------------------

LINES = "list_transform(CASE WHEN string_split({t}, chr(10))[-1] = '' THEN string_split({t}, chr(10))[:-2] ELSE string_split({t}, chr(10)) END, lambda x: regexp_replace(x, '\\r$', ''))"
DOC_LINES = f"SELECT unnest({LINES.format(t='text')}) AS line FROM documents"


@query("text_line_stats", f"SELECT sum(c)::BIGINT AS lines, sum(c - 1)::BIGINT AS repeated_lines, count(*)::BIGINT AS distinct_lines FROM (SELECT line, count(*) AS c FROM ({DOC_LINES}) GROUP BY 1)")
def text_line_stats(spark, sf_dir):
    return text.line_stats(table(spark, sf_dir, "documents"))


@query("text_top_phrases", f"WITH w AS (SELECT list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS w FROM ({DOC_LINES})), p AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS phrase FROM w WHERE len(w) >= 3) SELECT phrase, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, phrase LIMIT 10")
def text_top_phrases(spark, sf_dir):
    return text.top_phrases(table(spark, sf_dir, "documents"))


def _hits(d: str) -> str:
    return f"list_sum(list_transform(h, lambda x: length(x) - length(replace(x, {d}, ''))))"


DELIM_SQL = ["','", "';'", "chr(9)", "'|'"]


def legacy_sql(key: str, value: str, name: str) -> str:
    return f"""SELECT {key}, CASE greatest({', '.join(f'coalesce({_hits(d)}, 0) * 4 + {i}' for i, d in enumerate(DELIM_SQL))}) % 4 WHEN 0 THEN 'comma' WHEN 1 THEN 'semicolon' WHEN 2 THEN 'tab' ELSE 'pipe' END AS delimiter
FROM (SELECT {key}, ({LINES.format(t=value)})[1:20] AS h FROM {name})"""


@query("detect_delimiter_legacy", legacy_sql("doc_id", "text", "documents"))
def detect_delimiter_legacy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.legacy_delimiter(F.col("text")).alias("delimiter"))


@query("detect_delimiter_legacy_pages", legacy_sql("page_id", "html", "pages"))
def detect_delimiter_legacy_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.legacy_delimiter(F.col("html")).alias("delimiter"))


SCORES_SQL = f"""WITH l AS (SELECT doc_id, unnest({LINES.format(t='text')}) AS line FROM documents WHERE NOT contains(text, '"')),
c AS (SELECT doc_id, d.name AS delimiter, length(line) - length(replace(line, d.c, '')) + 1 AS width, count(*) AS records FROM l, (VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9)), ('pipe', '|')) d(name, c) WHERE line <> '' GROUP BY ALL),
s AS (SELECT doc_id, delimiter, max({{'r': records, 'w': width}}) AS m, sum(records) AS significant, sum(records * (width - 1)) AS separators FROM c GROUP BY ALL)
SELECT doc_id, delimiter, m.r = significant AS consistent, m.r::BIGINT AS modal_records, separators::BIGINT AS separators, m.w::BIGINT AS modal_width FROM s WHERE separators > 0"""


@query("dialect_scores", SCORES_SQL)
def dialect_scores(spark, sf_dir):
    return text.dialect_scores(table(spark, sf_dir, "documents"), "doc_id")


@query("dialect_detected", f"WITH sc AS ({SCORES_SQL}), b AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY consistent DESC, modal_records DESC, separators DESC, modal_width DESC) AS r FROM sc) SELECT doc_id, CASE WHEN count(*) = 1 THEN 'detected' ELSE 'ambiguous' END AS outcome, CASE WHEN count(*) = 1 THEN min(delimiter) END AS delimiter FROM b WHERE r = 1 GROUP BY doc_id")
def dialect_detected(spark, sf_dir):
    return text.detected(dialect_scores(spark, sf_dir), "doc_id")


# Of all documents; their SQL-checked namesakes above leave out those with quotes, which SQL cannot lex.
@query("dialect_scores_all")
def dialect_scores_all(spark, sf_dir):
    return text.dialect_scores_all(table(spark, sf_dir, "documents"), "doc_id")


@query("dialect_detected_all")
def dialect_detected_all(spark, sf_dir):
    return text.detected_all(table(spark, sf_dir, "documents"), "doc_id")


@query("newline_style", "SELECT page_id, CASE WHEN contains(html, chr(13) || chr(10)) THEN 'crlf' ELSE 'lf' END AS style FROM pages")
def newline_style(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.newline_style(F.col("html")).alias("style"))


_NUM = NUMBER_SQL.format(v="trim({c})")


@query(
    "header_detected",
    f"""WITH r AS (SELECT conv_id, turn, list_filter({LINES.format(t='text')}, lambda x: x <> '') AS r FROM conversations), c AS (SELECT conv_id, turn, len(r) AS n, string_split(r[1], ',') AS a, string_split(r[2], ',') AS b FROM r)
SELECT conv_id, turn, CASE WHEN n < 2 THEN false ELSE len(list_filter(a, lambda c: trim(c) <> '' AND regexp_matches(c, '[A-Za-z_]') AND NOT {_NUM.format(c='c')})) = len(a) AND len(list_distinct(a)) = len(a)
 AND len(list_filter(b, lambda c: {_NUM.format(c='c')} OR strlen(c) > strlen(a[1]))) > 0 END AS has_header FROM c""",
)
def header_detected(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.has_header(F.col("text")).alias("has_header"))


@query("file_type_by_extension", "SELECT page_id, CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'csv' THEN 'csv' WHEN 'txt' THEN 'txt' WHEN 'log' THEN 'txt' ELSE 'unknown' END AS file_type FROM pages")
def file_type_by_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fields.file_type(F.col("url")).alias("file_type"))


# --- chunks ---------------------------------------------------------------------------------------------------------

CHUNKS_SQL = "SELECT doc_id, k AS chunk_id, k * 4096 AS off, encode(text)[k * 4096 + 1 : k * 4096 + 4096] AS data FROM (SELECT doc_id, text, unnest(range(0, (strlen(text) + 4095) // 4096)) AS k FROM documents)"


def _layout(spark, sf_dir):
    return chunks.layout(table(spark, sf_dir, "documents"), "doc_id", "text", 4096)


@query("chunk_layout", f"SELECT doc_id, chunk_id, off AS \"offset\", octet_length(data)::BIGINT AS size FROM ({CHUNKS_SQL})")
def chunk_layout(spark, sf_dir):
    return _layout(spark, sf_dir).drop("data")


@query("chunk_digest", f"SELECT doc_id, chunk_id, octet_length(data)::BIGINT AS size, sha256(data) AS sha256 FROM ({CHUNKS_SQL})")
def chunk_digest(spark, sf_dir):
    return chunks.digests(_layout(spark, sf_dir), "doc_id")


@query("global_digest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def global_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


STATS_SQL = "SELECT doc_id, sum(c)::BIGINT AS size, count(*)::BIGINT AS unique_bytes, max(c)::BIGINT AS max_frequency, sum(CASE WHEN regexp_full_match(b, '3[0-9]|2[BCDE]|0A|0D|09|20') THEN c ELSE 0 END)::BIGINT AS numeric_like FROM (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)[1:65536]), '..')) AS b FROM documents) GROUP BY ALL) GROUP BY doc_id"


@query("chunk_byte_stats", STATS_SQL)
def chunk_byte_stats(spark, sf_dir):
    return chunks.byte_stats(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("adaptive_level", f"SELECT *, (CASE WHEN unique_bytes <= 16 OR max_frequency / size >= 0.20 THEN 6 WHEN unique_bytes > 180 OR (numeric_like / size >= 0.85 AND unique_bytes > 24) THEN 1 ELSE 3 END)::INT AS level FROM ({STATS_SQL})")
def adaptive_level(spark, sf_dir):
    return chunks.adaptive_level(chunk_byte_stats(spark, sf_dir))


@query("level_distribution", f"SELECT level, count(*) AS documents FROM (SELECT (CASE WHEN unique_bytes <= 16 OR max_frequency / size >= 0.20 THEN 6 WHEN unique_bytes > 180 OR (numeric_like / size >= 0.85 AND unique_bytes > 24) THEN 1 ELSE 3 END)::INT AS level FROM ({STATS_SQL})) GROUP BY 1")
def level_distribution(spark, sf_dir):
    return adaptive_level(spark, sf_dir).groupBy("level").agg(F.count("*").alias("documents"))


def _seeded(spark, sf_dir):
    """The layout with every seventh document's second chunk moved by one byte and every eleventh's sizes wrong."""
    rows = _layout(spark, sf_dir).select(F.col("doc_id").alias("archive"), "chunk_id", F.col("offset").alias("orig_offset"), F.col("size").alias("orig_size"), (F.col("size") + 13).alias("comp_size"))
    placed = chunks.with_offsets(rows)
    return placed.withColumn("orig_offset", F.when((F.col("archive") % 7 == 0) & (F.col("chunk_id") == 1), F.col("orig_offset") + 1).otherwise(F.col("orig_offset"))).withColumn(
        "orig_size", F.when((F.col("archive") % 11 == 0) & (F.col("chunk_id") == 0), F.lit(5000)).otherwise(F.col("orig_size"))
    )


@query(
    "chunk_table_checks",
    f"""WITH t AS (SELECT doc_id AS archive, chunk_id, CASE WHEN doc_id % 7 = 0 AND chunk_id = 1 THEN off + 1 ELSE off END AS oo, CASE WHEN doc_id % 11 = 0 AND chunk_id = 0 THEN 5000 ELSE octet_length(data) END AS os FROM ({CHUNKS_SQL})),
w AS (SELECT archive, chunk_id, os, oo, coalesce(lag(oo + os) OVER (PARTITION BY archive ORDER BY chunk_id), 0) AS want FROM t)
SELECT archive, chunk_id, 'CHUNK_SIZE' AS violation FROM w WHERE os > 4096 UNION ALL SELECT archive, chunk_id, 'ORIGINAL_OFFSET' FROM w WHERE oo <> want""",
)
def chunk_table_checks(spark, sf_dir):
    return chunks.violations(_seeded(spark, sf_dir), 4096)


@query("chunk_offsets", f"SELECT archive, chunk_id, (64 + 80 * count(*) OVER (PARTITION BY archive) + coalesce(sum(cs) OVER (PARTITION BY archive ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS comp_offset FROM (SELECT doc_id AS archive, chunk_id, octet_length(data) + 13 AS cs FROM ({CHUNKS_SQL}))")
def chunk_offsets(spark, sf_dir):
    return _seeded(spark, sf_dir).select("archive", "chunk_id", "comp_offset")


# --- measures -------------------------------------------------------------------------------------------------------


@query("compression_ratio_winners", "SELECT doc_id, CASE WHEN b = 0 THEN 0.0::DOUBLE ELSE a / b END AS ratio, CASE WHEN b < c THEN 'packed' WHEN c < b THEN 'zstd' ELSE 'tie' END AS storage_winner FROM (SELECT doc_id, strlen(text)::DOUBLE AS a, (strlen(text) // 3 + doc_id % 5)::DOUBLE AS b, (strlen(text) // 3 + length(text) % 5)::DOUBLE AS c FROM documents)")
def compression_ratio_winners(spark, sf_dir):
    n = F.octet_length("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", n.cast("double").alias("a"), (F.floor(n / 3) + F.col("doc_id") % 5).cast("double").alias("b"), (F.floor(n / 3) + F.length("text") % 5).cast("double").alias("c"))
    return rows.select("doc_id", measure.ratio(F.col("a"), F.col("b")).alias("ratio"), measure.winner(F.col("b"), F.col("c"), ("packed", "zstd")).alias("storage_winner"))


@query(
    "medians",
    "WITH s AS (SELECT event_type, list_sort(list(value)) AS l, list_sort(list(floor(value))) AS f FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, CASE WHEN len(l) % 2 = 1 THEN l[len(l) // 2 + 1] ELSE (l[len(l) // 2] + l[len(l) // 2 + 1]) / 2 END AS median_compare, l[len(l) // 2 + 1] AS median_benchmark, floor(CASE WHEN len(f) % 2 = 1 THEN f[len(f) // 2 + 1] ELSE (f[len(f) // 2] + f[len(f) // 2 + 1]) / 2 END)::BIGINT AS median_tune FROM s",
)
def medians(spark, sf_dir):
    out = measure.medians(table(spark, sf_dir, "events"), "event_type", "value")
    return out


def _grid(spark):
    g = measure.grid(spark, [4, 1, 2, 8, 4], [1, 2, 4, 8], 3)
    g = g.withColumn("throughput", ((F.col("chunk_size") * 7 + F.col("threads") * 31 + F.col("run") * 3) % 17 + F.col("threads") * 10).cast("double"))
    g = g.withColumn("ratio", 3 + ((F.col("chunk_size") * 5 + F.col("run")) % 7) / F.lit(8.0))
    return g.withColumn("memory", measure.peak_memory(F.col("chunk_size"), F.col("threads"), measure.in_flight(F.col("threads"))).cast("double"))


GRID_SQL = "SELECT c AS chunk_size, t AS threads, r AS run, ((c * 7 + t * 31 + r * 3) % 17 + t * 10)::DOUBLE AS throughput, 3 + ((c * 5 + r) % 7) / 8.0::DOUBLE AS ratio, (c * (greatest(2 * t, 4) + least(t, greatest(2 * t, 4))))::DOUBLE AS memory FROM (VALUES (1), (2), (4), (8)) a(c), (VALUES (1), (2), (4), (8)) b(t), (VALUES (1), (2), (3)) d(r)"
CONFIG_SQL = f"SELECT chunk_size::BIGINT AS chunk_size, threads::BIGINT AS threads, median(throughput) AS throughput, median(ratio) AS ratio, median(memory) AS memory FROM ({GRID_SQL}) GROUP BY ALL"


@query("tune_grid", CONFIG_SQL)
def tune_grid(spark, sf_dir):
    return _grid(spark).groupBy("chunk_size", "threads").agg(*(F.median(c).alias(c) for c in ("throughput", "ratio", "memory")))


@query(
    "tune_recommendations",
    f"""WITH c AS ({CONFIG_SQL}), n AS (SELECT *, {', '.join(f"CASE WHEN max({m}) OVER () = min({m}) OVER () THEN 1.0 ELSE ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()) END AS n_{m}" for m in ('throughput', 'ratio', 'memory'))} FROM c),
s AS (SELECT *, 0.55::DOUBLE * n_throughput + 0.45::DOUBLE * n_ratio - 0.08::DOUBLE * n_memory AS score FROM n)
SELECT goal, chunk_size, threads FROM ((SELECT 'throughput' AS goal, * FROM s ORDER BY throughput DESC, chunk_size, threads LIMIT 1) UNION ALL (SELECT 'ratio', * FROM s ORDER BY ratio DESC, chunk_size, threads LIMIT 1) UNION ALL (SELECT 'balanced', * FROM s ORDER BY score DESC, throughput DESC, chunk_size, threads LIMIT 1))""",
)
def tune_recommendations(spark, sf_dir):
    return measure.recommendations(tune_grid(spark, sf_dir))


OPTIONS = (*measure.PARTIAL_REASONS, "estimate_only")
REASONS_SQL = "concat_ws('|', " + ", ".join(f"CASE WHEN {k} THEN '{v}' END" for k, v in measure.PARTIAL_REASONS.items()) + ")"


@query(
    "benchmark_scope_status",
    "SELECT *, CASE WHEN estimate_only THEN 'estimate_only' WHEN prefix_limited THEN 'sampled' WHEN partial_reasons = '' THEN 'full' ELSE 'partial' END AS scope, CASE WHEN no_hash OR no_roundtrip OR estimate_only THEN 'not_validated' WHEN prefix_limited THEN 'partially_validated' ELSE 'validated' END AS validation_status FROM (SELECT *, "
    + REASONS_SQL + " AS partial_reasons FROM " + ", ".join(f"(VALUES (true), (false)) t{i}({o})" for i, o in enumerate(OPTIONS)) + ")",
)
def benchmark_scope_status(spark, sf_dir):
    out = spark.range(1)
    for o in OPTIONS:
        out = out.withColumn(o, F.explode(F.array(F.lit(True), F.lit(False))))
    return measure.scope_status(out.drop("id"))


#: What each stage of failure leaves of the nine checks: passed, failed, . not completed, x not applicable, - not available.
MATRIX_SQL = """SELECT stage, check_name, CASE substr(marks, i, 1) WHEN 'p' THEN 'passed' WHEN 'f' THEN 'failed' WHEN 'x' THEN 'not_applicable' WHEN '-' THEN 'not_available' ELSE 'not_completed' END AS status
FROM (VALUES ('header', 'f........'), ('metadata', 'pf.......'), ('metadata_limit', 'p........'), ('chunk_table', 'pp.f.....'), ('trailing_data', 'pp.pf....'),
  ('v1_payload', 'ppfx-f.--'), ('v1_length', 'pp.x-.f--'), ('v2_payload', 'pppppf...'), ('chunk_length', 'ppppp.f..'), ('chunk_hash', 'ppppp..f.'), ('restored_length', 'ppppppfp.'), ('global_hash', 'ppppppppf')) s(stage, marks),
(VALUES (1, 'header'), (2, 'metadata'), (3, 'payload_structure'), (4, 'chunk_table'), (5, 'trailing_data'), (6, 'decompression'), (7, 'restored_length'), (8, 'per_chunk_sha256'), (9, 'global_sha256')) c(i, check_name)"""


@query("validation_matrix", MATRIX_SQL)
def validation_matrix(spark, sf_dir):
    return measure.validation_matrix(spark)


# --- round trips: proven identical, not expressible in SQL -------------------------------------------------------------


@query("zstd_roundtrip_identity", f"SELECT doc_id, chunk_id, octet_length(data)::BIGINT AS size, true AS identical FROM ({CHUNKS_SQL})")
def zstd_roundtrip_identity(spark, sf_dir):
    return codec.zstd_roundtrip(_layout(spark, sf_dir), ["doc_id", "chunk_id"]).drop("comp_size")


@query("columnar_roundtrip_identity", "SELECT o_orderstatus, count(*) AS rows, true AS identical FROM orders GROUP BY 1")
def columnar_roundtrip_identity(spark, sf_dir):
    texts = fields.rendered(table(spark, sf_dir, "orders"))
    return codec.columnar_roundtrip(texts, "o_orderstatus").groupBy("o_orderstatus").agg(F.sum("rows").alias("rows"), F.min("identical").alias("identical"))


# --- generated tables: byte-exact by their published digests, not expressible in SQL ------------------------------------

for _profile in synthetic.COLUMNS:
    QUERIES[f"generate_{_profile}"] = lambda spark, sf_dir, name=_profile: synthetic.generate(spark, name)
