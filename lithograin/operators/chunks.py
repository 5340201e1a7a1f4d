"""Fixed-size chunk layouts of byte values, their digests, byte statistics and invariants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, ENTRY = 64, 80
STATS_BYTES = 65_536


def layout(docs: DataFrame, key: str, text: str, chunk: int) -> DataFrame:
    """(key, chunk_id, offset, size, data) per chunk of each value's UTF-8 bytes; an empty value has none."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")

    def pieces(b):
        # cut inside the array, so that no chunk's row carries the whole value along
        numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length(b) - 1) / chunk).cast("long"))
        cut = F.transform(numbers, lambda i: F.struct(i.alias("chunk_id"), F.substring(b, (i * chunk + 1).cast("int"), F.lit(chunk)).alias("data")))
        return F.when(F.octet_length(b) > 0, cut)

    bound = F.transform(F.array(data), pieces)[0]  # encoded once
    ids = docs.select(key, F.inline(bound))
    return ids.select(key, "chunk_id", (F.col("chunk_id") * F.lit(chunk)).cast("long").alias("offset"), F.octet_length("data").cast("long").alias("size"), "data")


def digests(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.select(key, "chunk_id", "size", F.sha2("data", 256).alias("sha256"))


_STATS = pa.schema([("size", pa.int64()), ("unique_bytes", pa.int64()), ("max_frequency", pa.int64()), ("numeric_like", pa.int64())])


def _counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data[:STATS_BYTES], np.uint8), minlength=256)


def byte_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Over the first 64 KiB: size, different bytes, the largest byte count, numeric-like bytes; one row a document, nothing shuffled.
    Documents without text have no row."""

    def run(batches):
        for batch in batches:
            counts = [_counts(x) for x in batch.column(1).to_pylist()]
            stats = [[int(c.sum()), int((c > 0).sum()), int(c.max()), int(c[_NUMERIC_LIKE].sum())] for c in counts]
            columns = [pa.array(c, pa.int64()) for c in zip(*stats)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *_STATS.names])

    head = F.substring(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 1, STATS_BYTES).alias("head")
    rows = docs.select(key, head).filter("octet_length(head) > 0")
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, size long, unique_bytes long, max_frequency long, numeric_like long")


def adaptive_level(stats: DataFrame) -> DataFrame:
    share = F.col("max_frequency") / F.col("size")
    level = F.when((F.col("unique_bytes") <= 16) | (share >= 0.20), 6).when((F.col("unique_bytes") > 180) | ((F.col("numeric_like") / F.col("size") >= 0.85) & (F.col("unique_bytes") > 24)), 1).otherwise(3)
    return stats.withColumn("level", level)


#: Digits, sign, separators and white space of numeric columns.
_NUMERIC_LIKE = np.isin(np.arange(256), np.frombuffer(b"0123456789-+.,\r\n\t ", np.uint8))


def level_of(data: bytes) -> int:
    """adaptive_level for one chunk in hand."""
    counts = _counts(data)
    size, unique = max(1, int(counts.sum())), int((counts > 0).sum())
    if unique <= 16 or counts.max() / size >= 0.20:
        return 6
    return 1 if unique > 180 or (counts[_NUMERIC_LIKE].sum() / size >= 0.85 and unique > 24) else 3


def with_offsets(table: DataFrame, archive: str = "archive") -> DataFrame:
    """Payload offsets: an exclusive prefix sum of compressed sizes behind the head and the table."""
    order = Window.partitionBy(archive).orderBy("chunk_id")
    before = F.coalesce(F.sum("comp_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.withColumn("comp_offset", (F.lit(HEAD) + ENTRY * F.count("*").over(Window.partitionBy(archive)) + before).cast("long"))


def violations(table: DataFrame, target: int, archive: str = "archive") -> DataFrame:
    """Broken invariants per chunk row: dense ids, sizes in 1..target, contiguous source and payload offsets."""
    order = Window.partitionBy(archive).orderBy("chunk_id")
    n = F.count("*").over(Window.partitionBy(archive))
    checks: dict[str, Column] = {
        "CHUNK_ID": F.col("chunk_id") != F.row_number().over(order) - 1,
        "CHUNK_SIZE": (F.col("orig_size") <= 0) | (F.col("orig_size") > target),
        "ORIGINAL_OFFSET": F.col("orig_offset") != F.coalesce(F.lag(F.col("orig_offset") + F.col("orig_size")).over(order), F.lit(0)),
        "PAYLOAD_OFFSET": F.col("comp_offset") != F.coalesce(F.lag(F.col("comp_offset") + F.col("comp_size")).over(order), HEAD + ENTRY * n),
    }
    flagged = table.select(archive, "chunk_id", *(c.alias(f"is_{k}") for k, c in checks.items()))
    return flagged.select(archive, "chunk_id", F.explode(F.filter(F.array(*(F.when(F.col(f"is_{k}"), F.lit(k)) for k in checks)), lambda x: x.isNotNull())).alias("violation"))
