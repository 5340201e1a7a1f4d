"""Suffix-array dedup: removes every byte covered by a 50-byte string that also starts in an earlier document.

Equal texts collapse first: a text of 50 bytes or more that an earlier document has as a whole loses all its bytes,
and only the earliest copy takes part in the suffix array (see suffix.py).

Defined results: null text counts as empty; texts under 50 bytes lose nothing; a null doc_id counts as the smallest;
rows that share doc_id and text count as one document, rows that share only the doc_id never mark each other;
no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table
from .suffix import repeated

WINDOW = 50
LEAST = -(2**63)


def _cut(batches):
    """Texts with byte ranges -> maximal removed runs and what is left."""
    for batch in batches:
        out = {k: [] for k in ("doc_id", "tid", "n_removed", "n_spans", "spans", "kept_text")}
        for doc, tid, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(4))):
            merged: list[list[int]] = []
            for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(text[at:lo])
                at = hi
            kept.append(text[at:])
            for k, v in zip(out, (doc, tid, sum(b - a for a, b in merged), len(merged), merged, b"".join(kept))):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_text", pa.binary())]))


def suffix_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents, cut): documents has doc_id, tid, n_bytes, sha, rep_id (smallest doc_id with that text);
    cut has doc_id, tid, n_removed, n_spans, spans, kept_text of those earliest copies that lose bytes."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), text.alias("text")).withColumn("tid", F.xxhash64("text"))
    members = stash(rows.select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "suffix-members")
    # written before it meets the rows, so that a hot text's rows can be split
    reps = stash(members.groupBy("sha").agg(F.min("doc_id").alias("rep_id")), "suffix-reps")
    candidates, spans = repeated(spark, rows.filter(F.octet_length("text") >= window).withColumn("salt", F.lit(0).cast("long")), window)
    per_doc = spans.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    cut = candidates.join(per_doc, ["doc_id", "tid"]).select("doc_id", "tid", "text", "ranges").mapInArrow(
        _cut, "doc_id long, tid long, n_removed long, n_spans long, spans array<array<long>>, kept_text binary"
    )
    return members.join(reps, "sha").withColumn("sha", F.lower(F.hex("sha"))), cut


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, cut = suffix_dedup(spark, table(spark, sf_dir, "documents"))
    digest = cut.select("doc_id", "tid", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))
    whole = (F.col("doc_id") > F.col("rep_id")) & (F.col("n_bytes") >= WINDOW)
    return documents.join(digest, ["doc_id", "tid"], "left").select(
        F.when(F.col("doc_id") > LEAST, F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


#: Every window of 50 bytes, its first document, and the runs of bytes that windows of earlier documents cover.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS MATERIALIZED (SELECT doc_id, 1000 * k AS lo, substr(x, 2000 * k + 1, 2098) AS x FROM (SELECT doc_id, x, unnest(range(0, (n + 999) // 1000)) AS k FROM d)),
w AS MATERIALIZED (SELECT doc_id, lo + j AS i, substr(x, 2 * j - 1, 100) AS s FROM (SELECT doc_id, lo, x, unnest(range(1, greatest(1, length(x) // 2 - 48))) AS j FROM p)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first_id < doc_id),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k, i FROM mark),
span AS (SELECT doc_id, k, min(i) AS lo, max(i) + 49 AS hi FROM run GROUP BY doc_id, k),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, list({'lo': lo, 'hi': hi} ORDER BY lo) AS spans FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, n, n_removed, n_spans, CASE WHEN spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(spans) + 1),
    lambda j: substr(x, CASE WHEN j = 0 THEN 1 ELSE 2 * spans[j].hi + 1 END, 2 * (CASE WHEN j = len(spans) THEN n ELSE spans[j + 1].lo - 1 END - CASE WHEN j = 0 THEN 0 ELSE spans[j].hi END))), '') END AS h
  FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(from_hex(h)) AS kept_sha256 FROM kept
"""
