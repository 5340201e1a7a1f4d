"""Byte-level BPE by a global distinct-word shuffle.

Batches of documents split their texts into pre-tokens with positions and keep, per batch, the list of different
words and the stream of word numbers in order of position (compressed). One pass writes both to the shared folder, so
the order in which the input comes, or comes again after a lost executor, doesn't matter. Only a batch's different words
travel, packed by word block: a block's owner encodes each different word once for the whole corpus, by merging its
bytes pair by pair in order of rank, and sends every batch its ids back. The batch's stream and its words' ids meet by
batch number and reassemble by position; decoding looks every id up in the token-byte table.

Defined results: null text counts as empty (no ids, no bytes); null doc_id passes through; repeated rows get equal
results; no rows give no rows; whole texts are read, however long; of pairs with one rank the leftmost merges first;
further columns are ignored.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, release, stash, table, unstash

BATCH_CHARS = 24 << 20
#: Words beyond this many bytes merge by a heap, in n log n steps.
LONG = 48
_CACHE: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: neighbours whose joined bytes have the least rank merge first, the leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    left = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, _NONE) for a, b in zip(left, left[1:])]
    while pairs:
        least = min(pairs)
        if least == _NONE:
            break
        at = pairs.index(least)
        left[at : at + 2] = [left[at] + left[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(left[at] + left[at + 1], _NONE)
        if at:
            pairs[at - 1] = ranks.get(left[at - 1] + left[at], _NONE)
    return [ranks[part] for part in left]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # ends and predecessors of the parts by start
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, at, end = heapq.heappop(heap)
        if not alive[at] or after[at] >= n or after[after[at]] != end:
            continue  # one of the pair has merged since
        alive[after[at]] = False
        after[at] = end
        if end < n:
            before[end] = at
            if (r := ranks.get(word[at : after[end]])) is not None:
                heapq.heappush(heap, (r, at, after[end]))
        if (prev := before[at]) >= 0 and (r := ranks.get(word[prev:end])) is not None:
            heapq.heappush(heap, (r, prev, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : after[at]]])
        at = after[at]
    return out


_NONE = 1 << 62


def _token_bytes(shared) -> list[bytes]:
    """The token-byte table, made once per Python worker."""
    if id(shared) not in _CACHE:
        table_ = [b""] * (max(shared.value.values(), default=-1) + 1)
        for token, rank in shared.value.items():
            table_[rank] = token
        _CACHE.clear()
        _CACHE[id(shared)] = table_
    return _CACHE[id(shared)]


def _batched(batches):
    """(number, doc ids, texts) of about BATCH_CHARS characters each."""
    docs, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs.append(doc)
            texts.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield number, docs, texts
                docs, texts, size, number = [], [], 0, number + 1
    if docs:
        yield number, docs, texts


def _split(texts: list[str], pattern: str):
    """Different words, most frequent first, the stream of word numbers and the words per text."""
    import regex

    find = regex.compile(pattern).findall
    known: dict[str, int] = {}
    number = known.setdefault
    streams, sizes = [], []
    for text in texts:
        found = find(text)
        sizes.append(len(found))
        streams.append(np.fromiter((number(w, len(known)) for w in found), np.uint32, len(found)))
    stream = np.concatenate(streams) if streams else np.zeros(0, np.uint32)
    count = np.bincount(stream, minlength=len(known))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(known), np.uint32)
    rank[order] = np.arange(len(known), dtype=np.uint32)
    words = list(known)
    return [words[i] for i in order.tolist()], rank[stream] if len(stream) else stream, np.array(sizes, np.uint32)


ROW = "batch long, block int, docs array<long>, a binary, b binary, c binary"
_ROW = pa.schema([("batch", pa.int64()), ("block", pa.int32()), ("docs", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


def _planes(x: np.ndarray) -> bytes:
    """Like bytes of uint32 values together: the high ones are almost all 0."""
    return np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _pre_tokens(pattern: str, blocks: int):
    """Documents -> a batch's stream (block -1) and, per block, its different words with their numbers (ascending, as differences)."""

    def run(batches):
        dense, pack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdCompressor(level=1).compress
        for number, docs, texts in _batched(batches):
            words, stream, sizes = _split(texts, pattern)
            rows = [(number, -1, docs, dense(_planes(stream)), dense(_planes(sizes)), len(words).to_bytes(8, "little"))]
            words = [w.encode() for w in words]
            block = np.fromiter((xxhash.xxh3_64_intdigest(w) % blocks for w in words), np.int64, len(words))
            order = np.argsort(block, kind="stable")
            cut = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
            for x, y in zip(cut, cut[1:]):
                at = order[x:y]
                part = [words[i] for i in at.tolist()]
                size = np.array([len(w) for w in part], np.uint32)
                rows.append((number, int(block[at[0]]), None, pack(_planes(np.diff(at, prepend=0))), pack(_planes(size)), dense(b"".join(part))))
            yield _rows(rows)

    return run


def _encode(shared):
    """An owner's words -> each batch's ids; every different word is encoded once."""

    def run(batches):
        ranks = shared.value
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                data, at, ids, lens = unpack(row["c"]), 0, [], []
                for n in _unplanes(unpack(row["b"])).tolist():
                    word = data[at : at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = merge(word, ranks)
                    ids += got
                    lens.append(len(got))
                rows.append((row["batch"], row["block"], None, row["a"], pack(_planes(np.array(lens, np.uint32))), pack(_planes(np.array(ids, np.uint32)))))
            yield _rows(rows)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def _ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


def _reassemble(shared):
    """One batch: its stream and the ids of its words."""

    def run(got: pa.Table) -> pa.Table:
        tokens = _token_bytes(shared)
        unpack = zstandard.ZstdDecompressor().decompress
        rows = got.to_pylist()
        head = next(r for r in rows if r["block"] < 0)
        n_words = int.from_bytes(head["c"], "little")
        lens, at, flat, base = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), [], 0
        for r in rows:
            if r["block"] >= 0:
                where, n, ids = (_unplanes(unpack(r[k])).astype(np.int64) for k in "abc")
                where = np.cumsum(where)
                lens[where] = n
                at[where] = base + np.cumsum(n) - n
                base += len(ids)
                flat.append(ids)
        flat_ids = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        values = flat_ids.tolist()
        words = [b"".join([tokens[i] for i in values[a : a + n]]) for a, n in zip(at.tolist(), lens.tolist())]
        stream = _unplanes(unpack(head["a"]))
        ends = np.concatenate([[0], np.cumsum(_unplanes(unpack(head["b"])), dtype=np.int64)])
        out, step = [], 512
        for x in range(0, len(head["docs"]), step):  # slices, so that no array spans the whole batch
            cut = ends[x : x + step + 1]
            part = stream[cut[0] : cut[-1]]
            n = lens[part]
            ids = flat_ids[_ragged(at[part], n)]
            offsets = np.concatenate([[0], np.cumsum(n)])[cut - cut[0]].astype(np.int32)
            numbers, edges = part.tolist(), (cut - cut[0]).tolist()
            decoded = [b"".join([words[i] for i in numbers[a:b]]) for a, b in zip(edges, edges[1:])]
            out.append(pa.RecordBatch.from_arrays([pa.array(head["docs"][x : x + step], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(decoded, pa.binary())], schema=_OUT))
        return pa.Table.from_batches(out, schema=_OUT)

    return run


def bpe(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, ids, decoded (bytes of the decoded ids). ranks: of bounded size, sent to all executors."""
    blocks = parts(spark)
    shared = spark.sparkContext.broadcast(ranks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    split = stash(rows.mapInArrow(_pre_tokens(pattern, blocks), ROW).withColumn("part", F.when(F.col("block") < 0, "streams").otherwise("words")), "bpe-split", by="part")
    encoded = stash(split.filter("part = 'words'").drop("part").repartitionById(blocks, "block").mapInArrow(_encode(shared), ROW), "bpe-ids")
    unstash(split, part="part=words")
    release(spark)
    both = split.filter("part = 'streams'").drop("part").union(encoded)
    return both.groupBy("batch").applyInArrow(_reassemble(shared), "doc_id long, ids array<int>, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(bpe(spark, table(spark, sf_dir, "documents"), *default_vocabulary()))
