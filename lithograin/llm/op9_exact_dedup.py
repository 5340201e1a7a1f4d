"""Exact dedup by an extendible-hash index kept on shared files.

Keys are 64-bit hashes of the white-space-normalised text. A directory of 2**depth slots points at buckets; an
overfull bucket splits by one more leading key bit, and the directory doubles when a bucket's own depth passes it.
Splits follow counts of keys by prefix, taken over all keys, a few bits further each round and only for the buckets that
are still overfull. Every owner task takes a contiguous key range of buckets, walks its keys in order, chains different
texts under one key, compares bytes along the chain and writes its buckets to a folder of its own. Rows find their
group by way of the directory: slot, bucket, then key and digest within the bucket. Copies inside one batch collapse
before the shuffle, so a group that holds a third of all rows sends one row per batch.

Buckets hold `bucket_rows` keys, more where that would make over MOST_BUCKETS of them an owner, so directory and
index grow with the number of partitions and not with the documents. Keys that agree in SPARE more leading bits than
even keys would need stay in one bucket, whose chain then grows (owners sort on disk).

Defined results: a null text counts as empty; all rows that carry the group's smallest doc_id stay (repeated rows
count as one document); a null doc_id never wins unless the whole group has none; no rows give no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, parts, scratch, stash, sweep, table

BUCKET_ROWS = 4096
LEAST_BUCKETS, MOST_BUCKETS = 8, 64
SPARE = 8
AHEAD = 3
#: A directory is broadcast up to so many slots; a larger one is joined.
BROADCAST_SLOTS = 1 << 20


class Directory:
    """Slots by leading key bits; each bucket knows its own depth and its prefix of so many bits."""

    def __init__(self) -> None:
        self.depth, self.slots = 0, np.zeros(1, np.int32)
        self.local, self.prefix = [0], [0]

    def split(self, bucket: int) -> int:
        """Gives the upper half of a bucket's keys to a new bucket; doubles the directory where it is no finer than the bucket."""
        if self.local[bucket] == self.depth:
            self.slots = np.repeat(self.slots, 2)
            self.depth += 1
        new = len(self.local)
        self.local[bucket] += 1
        self.prefix[bucket] *= 2
        self.local.append(self.local[bucket])
        self.prefix.append(self.prefix[bucket] + 1)
        width = 1 << (self.depth - self.local[new])
        self.slots[self.prefix[new] * width : (self.prefix[new] + 1) * width] = new
        return new

    def insert(self, counts: dict[int, int], bits: int, capacity: int) -> list[int]:
        """Splits what the keys counted by prefixes of bits bits overfill; the buckets that are still overfull at that depth."""
        order = np.array(sorted(counts), np.uint64)
        total = np.concatenate([[0], np.cumsum([counts[int(p)] for p in order], dtype=np.int64)])

        def keys(b: int) -> int:
            shift = bits - self.local[b]
            lo, hi = np.searchsorted(order, np.array([self.prefix[b] << shift, ((self.prefix[b] + 1) << shift) - 1], np.uint64), "left")
            return int(total[hi + (hi < len(order) and int(order[hi]) == ((self.prefix[b] + 1) << shift) - 1)] - total[lo])

        todo, over = list(range(len(self.local))), []
        while todo:
            b = todo.pop()
            if self.local[b] <= bits and keys(b) > capacity:
                if self.local[b] < bits:
                    todo += [b, self.split(b)]
                else:
                    over.append(b)
        return over

    def owners(self, n: int) -> np.ndarray:
        """Owner of each bucket: n contiguous ranges of about as many buckets each, in key order."""
        order = sorted(range(len(self.local)), key=lambda b: self.prefix[b] << (self.depth - self.local[b]))
        out = np.zeros(len(order), np.int32)
        out[order] = np.arange(len(order), dtype=np.int64) * n // len(order)
        return out


def grow(count: Callable[[int, Directory, list[int]], dict[int, int]], keys: int, capacity: int) -> Directory:
    """A directory whose buckets hold at most capacity of the keys; count(bits, directory, buckets) counts the keys of
    these buckets by prefixes of bits bits."""
    out, even = Directory(), max(0, (max(1, keys) // capacity)).bit_length()
    bits, most, over = min(64, even + AHEAD), min(64, even + SPARE), [0]
    while keys > capacity and over:
        over = out.insert(count(bits, out, over), bits, capacity)
        if bits >= most:
            break
        bits = min(most, bits + AHEAD)
    return out


def _combine(directory: Directory, owner: np.ndarray):
    depth, slots = directory.depth, directory.slots

    def run(batches):
        for batch in batches:
            chains: dict[tuple[int, str], list] = {}
            for doc, h, norm in zip(*(batch.column(i).to_pylist() for i in range(3))):
                chain = chains.setdefault((h, norm), [doc, 0])
                if doc is not None and (chain[0] is None or doc < chain[0]):
                    chain[0] = doc
                chain[1] += 1
            keys = np.array([h for h, _ in chains], np.int64).view(np.uint64)
            bucket = slots[(keys >> np.uint64(64 - depth)).astype(np.int64)] if depth else np.zeros(len(keys), np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner[bucket]), pa.array(bucket), pa.array(keys.view(np.int64)),
                    pa.array([c[0] for c in chains.values()], pa.int64()), pa.array([c[1] for c in chains.values()], pa.int64()), pa.array([t for _, t in chains], pa.string()),
                ],
                names=["owner", "bucket", "h", "doc_id", "n", "norm"],
            )

    return run


def _chain(batches):
    """Rows come sorted by key; a chain holds one slot for each different text under the key."""

    def flush(owner, bucket, h, slots):
        for slot, (text, doc, n) in enumerate(slots):
            out.append((owner, bucket, h, slot, hashlib.sha256(text.encode()).digest(), doc, n))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["owner", "bucket", "h", "slot", "sha", "keep_id", "n"])

    kinds, out, at, slots = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), [], None, []
    for batch in batches:
        for owner, bucket, h, doc, n, norm in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if at != (owner, bucket, h):
                if at:
                    flush(*at, slots)
                at, slots = (owner, bucket, h), []
            for slot in slots:
                if slot[0] == norm:
                    slot[1] = doc if slot[1] is None else slot[1] if doc is None else min(slot[1], doc)
                    slot[2] += n
                    break
            else:
                slots.append([norm, doc, n])
        if len(out) >= 10_000:
            yield batch_of(out)
            out.clear()
    if at:
        flush(*at, slots)
    if out:
        yield batch_of(out)


@dataclass
class Index:
    """The directory and, in folders by owner, the buckets: (owner, bucket, h, slot, sha, keep_id, n)."""

    directory: Directory
    owner: np.ndarray
    buckets: DataFrame

    def probe(self, rows: DataFrame) -> DataFrame:
        """rows(..., h, sha) that the index has, with keep_id and n of their group: directory, bucket, then the chain."""
        slot = F.shiftrightunsigned("h", 64 - self.directory.depth) if self.directory.depth else F.lit(0).cast("long")
        slots = rows.sparkSession.createDataFrame([(i, int(b), int(self.owner[b])) for i, b in enumerate(self.directory.slots)], "slot long, bucket int, owner int")
        placed = rows.withColumn("slot", slot).join(F.broadcast(slots) if len(self.directory.slots) <= BROADCAST_SLOTS else slots, "slot").drop("slot")
        return placed.join(self.buckets.select("owner", "bucket", "h", "sha", "keep_id", "n"), ["owner", "bucket", "h", "sha"])


def keyed(docs: DataFrame, key: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """doc_id, h, norm (the normalised text) of every row."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE_CLASS + "+", " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", key("norm").alias("h"), "norm")


def build(spark: SparkSession, texts: DataFrame, members: DataFrame, bucket_rows: int = BUCKET_ROWS) -> Index:
    """The index over texts(doc_id, h, norm); members(h) are the same rows in the shared folder."""
    owners = parts(spark)
    distinct = stash(members.select("h").distinct(), "dedup-keys")
    keys = distinct.count()
    capacity = min(max(bucket_rows, -(-keys // (MOST_BUCKETS * owners))), max(16, keys // (LEAST_BUCKETS * owners)))

    def count(bits: int, directory: Directory, buckets: list[int]) -> dict[int, int]:
        within = distinct
        if directory.depth:
            wanted = set(buckets)
            slots = spark.createDataFrame([(i,) for i, b in enumerate(directory.slots.tolist()) if b in wanted], "slot long")
            placed = distinct.withColumn("slot", F.shiftrightunsigned("h", 64 - directory.depth))
            within = placed.join(F.broadcast(slots) if len(directory.slots) <= BROADCAST_SLOTS else slots, "slot", "left_semi").select("h")
        got = within.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("p") if bits < 64 else F.col("h").alias("p")).agg(F.count("*").alias("n")).collect()
        return {r.p % (1 << 64): r.n for r in got}  # about 2**AHEAD prefixes a bucket of the directory

    directory = grow(count, keys, capacity)
    owner = directory.owners(owners)
    entries = texts.mapInArrow(_combine(directory, owner), "owner int, bucket int, h long, doc_id long, n long, norm string")
    chained = entries.repartitionById(owners, "owner").sortWithinPartitions("bucket", "h").mapInArrow(_chain, "owner int, bucket int, h long, slot int, sha binary, keep_id long, n long")
    return Index(directory, owner, stash(chained, "dedup-index", by="owner"))


def exact_dedup(spark: SparkSession, docs: DataFrame, bucket_rows: int = BUCKET_ROWS, key: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. key maps the normalised text to a 64-bit hash."""
    before = scratch()
    texts = keyed(docs, key)
    members = stash(texts.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-members")
    index = build(spark, texts, members, bucket_rows)
    sweep(before, members, index.buckets)
    return index.probe(members).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
