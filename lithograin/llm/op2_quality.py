"""Quality rules as a short-circuit cascade; DataFrame functions only.

Each rule's rejection rate and cost are estimated on a bounded sample: rejections by counting, cost as the CPU time that
the sample's tasks spend on it. Rules then run in order of rejections per cost, and a document that one rule rejects skips
the rest: CASE is lazy, and every rule derives the counts it needs itself, so a dear count of a rejected document is never
made. The verdict is the conjunction of all rules, so the order changes cost, never results. Where the counts are
asked for themselves (quality), they are made for every document and only what rules need beyond them is skipped.

Defined results: null or blank text has no words and fails the base rules; repeated rows get equal results; null
doc_id passes through; no rows give no rows; texts are read whole; further columns are ignored, whatever their names, and
kept as they are by keep_documents; rules of equal rejections per cost keep their given order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stash, table, unstash

SAMPLE_ROWS = 2000
#: Times that each sampled row is put to a rule in a measurement, and measurements, of which the cheapest counts.
REPEAT, ROUNDS = 3, 2
#: Seconds a row that every rule costs at least, so that free rules of no use don't come first.
LEAST_COST = 1e-7
WINDOW = 8


def let(value: Column, body) -> Column:
    """Binds value once for use inside body; keeps Catalyst from repeating it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: linear passes over sorted (hash, position)."""
    entries = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(pos: Column) -> Column:
        gaps = F.transform(pos, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, k + 1), p + WINDOW) - p))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(entries, repeated))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _repeats(w: Column) -> Column:
    windows = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return let(windows, _repeat_words)


def _duplicates(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


class OfText:
    """Counts of a text, each made where a rule asks for it; words: the text's words, bound once."""

    def __init__(self, text: Column, words: Column) -> None:
        self.text, self.words = text, words

    n_words = property(lambda self: F.size(self.words).cast("long"))
    word_chars = property(lambda self: F.length(F.array_join(self.words, "")).cast("long"))
    n_symbols = property(lambda self: F.regexp_count(self.text, F.lit(r"[#*$%&|<>]")).cast("long"))
    n_lines = property(lambda self: F.size(_lines(self.text)).cast("long"))
    n_dup_lines = property(lambda self: let(_lines(self.text), _duplicates))
    n_repeat_words = property(lambda self: _repeats(self.words))


class OfColumns:
    """Counts that are columns already."""

    def __init__(self, text: Column) -> None:
        self.text = text

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


@dataclass(frozen=True)
class Rule:
    """name, and the condition over a document's counts under which the rule rejects it."""

    name: str
    rejects: Callable[[OfText | OfColumns], Column]


#: Rules of the contract's base, then the method's. Thresholds are wide: prose in any of the corpus's languages passes every one.
BASE_RULES = (
    Rule("few_words", lambda x: x.n_words < 20),
    Rule("repetition", lambda x: x.n_repeat_words * 100 > x.n_words * 30),
)
RULES = (
    Rule("symbols", lambda x: x.n_symbols * 10 > x.n_words * 3),
    Rule("word_length", lambda x: let(x.word_chars, lambda c: (c < 2 * x.n_words) | (c > 14 * x.n_words))),
    Rule("duplicate_lines", lambda x: x.n_dup_lines * 10 > x.n_lines * 5),
    Rule("shouting", lambda x: F.regexp_count(x.text, F.lit(r"!")) * 10 > x.n_words * 3),
    Rule("upper_case", lambda x: F.regexp_count(x.text, F.lit(r"[A-ZÀ-ÞΑ-ΩА-Я]{3}")) * 10 > x.n_words * 4),
    Rule("ellipsis_lines", lambda x: F.regexp_count(x.text, F.lit(r"(?:\.\.\.|…)[\x20\x09\x0D]*(?:\n|$)")) * 10 > x.n_lines * 5),
    Rule("no_letters", lambda x: F.regexp_count(x.text, F.lit(r"[\x20\x09-\x0D]?[^\x20\x09-\x0D]*\p{L}")) * 10 < x.n_words * 5),
)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) plus the base counts, each made once."""
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeats(w).alias("repeat"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n"), _duplicates(x).alias("dup"))
    counts = F.struct(
        let(_words(_text()), of_words).alias("w"), F.length(F.regexp_replace(_text(), SPACE_CLASS + "+", "")).cast("long").alias("chars"),
        F.regexp_count(_text(), F.lit(r"[#*$%&|<>]")).cast("long").alias("symbols"), let(_lines(_text()), of_lines).alias("lines"),
    )
    return docs.withColumn("_f", counts).select(
        *docs.columns, F.col("_f.w.n").alias("n_words"), F.col("_f.chars").alias("word_chars"), F.col("_f.symbols").alias("n_symbols"), F.col("_f.lines.n").alias("n_lines"),
        F.col("_f.lines.dup").alias("n_dup_lines"), F.col("_f.w.repeat").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def of_text(condition: Callable[[OfText], Column]) -> Column:
    """A condition over the counts of the column text, made lazily."""
    return let(_words(_text()), lambda w: condition(OfText(_text(), w)))


def of_columns(condition: Callable[[OfColumns], Column]) -> Column:
    return condition(OfColumns(_text()))


def cascade(rules: list[Rule]) -> Callable[[OfText | OfColumns], Column]:
    """Do all rules pass? Later ones are only asked where earlier ones do."""

    def verdict(x: OfText | OfColumns) -> Column:
        out = F.when(rules[0].rejects(x), F.lit(False)) if rules else F.lit(True)
        for rule in rules[1:]:
            out = out.when(rule.rejects(x), F.lit(False))
        return out.otherwise(F.lit(True)) if rules else out

    return verdict


def _cpu_seconds(spark: SparkSession, run: Callable[[], object]) -> tuple[float, object]:
    """CPU seconds that the tasks of run's jobs took, and its result."""
    context, group = spark.sparkContext, f"quality-{uuid.uuid4().hex}"
    kept = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    context.setJobGroup(group, "cost of a quality rule")
    try:
        result = run()
    finally:
        for k, v in kept.items():
            context.setLocalProperty(k, v)
    scala = context._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), scala.statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(s).executorCpuTime() for s in stages) / 1e9, result


def estimate(sample: DataFrame, rules: tuple[Rule, ...], view: Callable) -> dict[str, tuple[float, float]]:
    """Share of the sample that each rule rejects, and its CPU seconds a row beyond those of reading the row."""
    spark, many = sample.sparkSession, sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

    def timed(condition: Column) -> tuple[float, int, int]:
        job = lambda: many.agg(F.count("*"), F.coalesce(F.sum(condition.cast("int")), F.lit(0))).first()
        runs = [_cpu_seconds(spark, job) for _ in range(ROUNDS)]
        return min(t for t, _ in runs), *runs[0][1]

    floor, rows, _ = timed(F.length("text") < 0)
    out = {}
    for rule in rules:
        took, _, rejected = timed(view(rule.rejects))
        out[rule.name] = rejected / max(1, rows), max(0.0, took - floor) / max(1, rows) + LEAST_COST
    return out


def ordered(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejections per cost; a rule that rejects nothing in the sample counts as rejecting a tenth of a row in SAMPLE_ROWS."""
    score = {name: (share + 0.1 / SAMPLE_ROWS) / cost for name, (share, cost) in estimates.items()}
    return sorted(rules, key=lambda r: -score[r.name])


def plan_cascade(rows: DataFrame, rules: tuple[Rule, ...], view: Callable, sample_rows: int = SAMPLE_ROWS, counted: Callable[[DataFrame], DataFrame] = lambda x: x) -> list[Rule]:
    """The rules in the order in which a cascade over rows(text) runs; view makes a condition of the sample's columns."""
    n = rows.count()
    sample = stash(counted(rows.select("text").sample(min(1.0, sample_rows / max(1, n)), seed=7)), "quality-sample")
    order = ordered(rules, estimate(sample, rules, view))
    unstash(sample)
    return order


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs plus the base counts, base_failed and kept."""
    docs = docs.select("doc_id", "text")
    order = plan_cascade(docs, rules, of_columns, sample_rows, lambda x: measured(x).filter("NOT base_failed"))
    return measured(docs).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(of_columns(cascade(order))))


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    return docs.filter(of_text(cascade(plan_cascade(docs, rules, of_text))))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The counts and the verdict over a relation `docs(doc_id, text)`; the pipeline's SQL uses it too.
FEATURES_SQL = r"""
base AS (SELECT doc_id, coalesce(text, '') AS text FROM docs),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(0, 8) r(j) GROUP BY doc_id),
f AS (SELECT w.doc_id, text, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
quality AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols * 10 > n_words * 3
                  OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR n_dup_lines * 10 > n_lines * 5
                  OR len(regexp_extract_all(text, '!')) * 10 > n_words * 3
                  OR len(regexp_extract_all(text, '[A-ZÀ-ÞΑ-ΩА-Я]{3}')) * 10 > n_words * 4
                  OR len(regexp_extract_all(text, '(?:\.\.\.|…)[\x20\x09\x0D]*(?:\n|$)')) * 10 > n_lines * 5
                  OR len(regexp_extract_all(text, '[\x20\x09-\x0D]?[^\x20\x09-\x0D]*\p{L}')) * 10 < n_words * 5) AS kept
      FROM f)
"""

ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {FEATURES_SQL}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept FROM quality
"""
