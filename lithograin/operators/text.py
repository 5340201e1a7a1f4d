"""Lines, phrases, delimiters, newline styles and headers of plain and delimited text; built-in expressions, but for
the dialect of text with quotes, which the lexer scores."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import delimited

#: Candidate delimiters in order.
DELIMITERS = (",", ";", "\t", "|")
NAMES = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}
#: Buckets that phrases are counted in by hash, and how many of the fullest have their phrases counted as text first.
BUCKETS, FIRST = 1 << 18, 1 << 12


def lines(text: Column) -> Column:
    """Split on LF; one trailing CR goes from each line, a last empty piece is no line."""
    parts = F.split(text, "\n")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(lines(F.col(text))).alias("line")).groupBy("line").agg(F.count("*").alias("c"))


def line_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines, repeated lines (beyond the first of each), distinct lines over all documents."""
    return line_counts(docs, text).agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("repeated_lines"), F.count("*").alias("distinct_lines"))


def top_phrases(docs: DataFrame, text: str = "text", words: int = 3, top: int = 10) -> DataFrame:
    """The most frequent phrases of words consecutive words within a line, counted twice or more; ties in byte order.

    All phrases are first counted by hash, in BUCKETS buckets. No phrase occurs more often than its bucket, so once the
    phrases of the FIRST fullest buckets give a count that the answer reaches, others of it lie only in buckets of that
    count or more. Only phrases of these buckets are shuffled as text. Runs at once and reads docs twice, or a third time if
    more than FIRST buckets reach that count."""
    spark, names = docs.sparkSession, [f"w{i}" for i in range(words)]
    split = F.array_remove(F.split(F.col("line"), r"\s+"), "")  # a CR before LF goes with the white space
    many = F.greatest(F.size("w") - (words - 1), F.lit(0))
    windows = F.arrays_zip(*(F.slice("w", i + 1, many).alias(name) for i, name in enumerate(names)))
    phrases = docs.select(F.explode(F.split(text, "\n")).alias("line")).select(split.alias("w")).select(F.explode(windows).alias("p")).select("p.*")
    phrases = phrases.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)))

    def first(counted: DataFrame) -> DataFrame:
        return counted.orderBy(F.desc("n"), "phrase").limit(top)

    def among(buckets: pa.Table) -> DataFrame:
        kept = phrases.join(F.broadcast(spark.createDataFrame(buckets.select(["bucket"]))), "bucket", "left_semi")
        return kept.groupBy(F.concat_ws(" ", *names).alias("phrase")).agg(F.count("*").alias("n")).filter("n > 1")

    loads = phrases.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").toArrow().sort_by([("n", "descending")])  # BUCKETS rows at most
    found = first(among(loads.slice(0, FIRST))).toArrow()
    least = found["n"][-1].as_py() if found.num_rows == top > 0 else 2
    others = loads.slice(FIRST).filter(pc.field("n") >= least)
    found = spark.createDataFrame(found)
    return first(found.unionByName(among(others)) if others.num_rows else found)


def legacy_delimiter(text: Column) -> Column:
    """The candidate with most occurrences in the first 20 lines; the last one wins ties, so text without any gives pipe."""
    head = F.slice(lines(text), 1, 20)
    counts = [_counted(head, d, i) for i, d in enumerate(DELIMITERS)]
    return F.element_at(F.array(*(F.lit(NAMES[d]) for d in DELIMITERS)), F.greatest(*counts)["i"] + 1)


def _counted(head: Column, delimiter: str, at: int) -> Column:
    total = F.aggregate(head, F.lit(0), lambda a, x: a + F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))))
    return F.struct(total.alias("n"), F.lit(at).alias("i"))


def newline_style(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r\n")), "crlf").otherwise("lf")


def dialect_scores(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Score tuple per document and candidate for quote-free text: consistent, modal records, separators, modal width."""
    rows = docs.filter(~F.contains(F.col(text), F.lit('"'))).select(key, F.explode(lines(F.col(text))).alias("line")).filter("line <> ''")
    widths = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(NAMES[d]).alias("delimiter"), (F.length("line") - F.length(F.replace(F.col("line"), F.lit(d), F.lit(""))) + 1).alias("width")) for i, d in enumerate(DELIMITERS))))
    counted = rows.select(key, widths.alias("w")).groupBy(key, "w.ord", "w.delimiter", "w.width").agg(F.count("*").alias("records"))
    best = F.max(F.struct("records", "width"))
    return (
        counted.groupBy(key, "ord", "delimiter").agg(best.alias("m"), F.sum("records").alias("significant"), F.sum(F.col("records") * (F.col("width") - 1)).alias("separators"))
        .filter("separators > 0")
        .select(key, "delimiter", (F.col("m.records") == F.col("significant")).alias("consistent"), F.col("m.records").alias("modal_records"), "separators", F.col("m.width").cast("long").alias("modal_width"))
    )


_QUOTED = "delimiter string, consistent boolean, quoted_fields long, modal_records long, separators long, modal_width long"


def _score_quoted(batches):
    """One row per document and candidate with separators; a candidate that the text is malformed under gives none."""
    for batch in batches:
        at, out = [], []
        for i, data in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            for d in delimited.CANDIDATES:
                try:
                    got = delimited.score(data, d)
                except delimited.Malformed:
                    continue
                if got:
                    at.append(i)
                    out.append((NAMES[d.decode()], *got))
        names = [part.split()[0] for part in _QUOTED.split(", ")]
        columns = list(zip(*out)) or [()] * len(names)
        kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[batch.schema.names[0], *names])


def dialect_scores_all(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """dialect_scores of every document, those with quotes among them, with the number of quoted fields."""
    plain = dialect_scores(docs, key, text).withColumn("quoted_fields", F.lit(0).cast("long"))
    quoted = docs.filter(F.contains(F.col(text), F.lit('"'))).select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    scored = quoted.mapInArrow(_score_quoted, f"`{key}` {kind}, {_QUOTED}")
    return plain.select(key, *(part.split()[0] for part in _QUOTED.split(", "))).unionByName(scored)


def _detect_quoted(batches):
    """The lexer's own verdict, one row per document; a malformed text's outcome is malformed, undetected ones give no row."""
    for batch in batches:
        at, out = [], []
        for i, data in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            try:
                outcome, d = delimited.detect(data)
            except delimited.Malformed:
                outcome, d = "malformed", None
            if outcome != "undetected":
                at.append(i)
                out.append((outcome, d and NAMES[d.decode()]))
        columns = list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=[batch.schema.names[0], "outcome", "delimiter"])


def detected_all(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """detected of every document, those with quotes among them."""
    quoted = docs.filter(F.contains(F.col(text), F.lit('"'))).select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    return detected(dialect_scores(docs, key, text), key).unionByName(quoted.mapInArrow(_detect_quoted, f"`{key}` {kind}, outcome string, delimiter string"))


def detected(scores: DataFrame, key: str) -> DataFrame:
    """Detected with its delimiter, or ambiguous when several candidates share the best score."""
    score = F.struct("consistent", "modal_records", "separators", "modal_width")
    best = scores.withColumn("score", score).groupBy(key).agg(F.max("score").alias("best"), F.collect_list(F.struct("score", "delimiter")).alias("all"))  # at most four a key
    winners = F.transform(F.filter("all", lambda x: x["score"] == F.col("best")), lambda x: x["delimiter"])
    return best.select(key, F.when(F.size(winners) == 1, "detected").otherwise("ambiguous").alias("outcome"), F.when(F.size(winners) == 1, F.element_at(winners, 1)).alias("delimiter"))


def has_header(text: Column, delimiter: str = ",") -> Column:
    """The first row names columns: unique, non-blank, with a letter or underscore, not numeric, and the second row has
    a cell that is numeric or longer than the first header cell."""
    from ..functions.fields import is_numeric_trimmed

    rows = F.filter(lines(text), lambda x: x != "")
    cut = lambda r: F.split(r, "\\" + delimiter)
    first, second = cut(F.get(rows, F.lit(0))), cut(F.get(rows, F.lit(1)))
    named = F.forall(first, lambda c: (F.trim(c) != "") & c.rlike("[A-Za-z_]") & ~is_numeric_trimmed(c)) & (F.size(F.array_distinct(first)) == F.size(first))
    longer = F.exists(second, lambda c: is_numeric_trimmed(c) | (F.octet_length(c) > F.octet_length(F.get(first, F.lit(0)))))
    return F.when(F.size(rows) < 2, F.lit(False)).otherwise(named & longer)
