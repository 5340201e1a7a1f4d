"""Repeated byte strings across documents by a distributed, depth-bounded suffix array.

1. Anchors. Every WINDOW-byte string is keyed by the smallest hash of its 16-byte grams, so equal strings share a key
   wherever they occur. Maximal runs of consecutive strings with one key form a fragment. Documents post their keys,
   packed by key block; a block's owner answers each text bucket with the keys that more than one posting has.
2. Fragments. Buckets (keyed by text hash, so equal texts meet and only the smallest doc_id goes on) send the bytes
   of fragments with repeated keys to the key's owner.
3. Suffix array. An owner takes its fragments in shares of at most SHARE bytes, dealt by their keys, since how many
   bytes it gets depends on how much of the corpus repeats. Of a share it keeps each different fragment once and sorts
   its suffixes in two stages: only suffixes smaller than their successors are sorted directly, the others are induced
   by scans over the character buckets. Neighbours with a common prefix of WINDOW bytes form groups; every occurrence
   in a document other than the group's first is marked.

Work and traffic follow the input; owners and buckets follow spark.sql.shuffle.partitions (two to a partition where
one task holds its whole part of the input in memory). Equal texts collapse per
batch before any shuffle, and a key that many documents share posts at most two entries per batch and bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, parts, release, stash, trim, unstash

GRAM = 16
CHUNK = 1 << 20
#: Bytes of fragments that an owner sorts at once; sorting takes about 30 bytes of memory for each.
SHARE = 6 << 20
#: Orders of grams by which a share that is still too large is dealt anew, before it is dealt by whole strings.
ORDERS = 3
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def runs(buf: np.ndarray, ends: np.ndarray, salts: np.ndarray | None, window: int):
    """Fragments of texts laid end to end in buf (text i ends at ends[i]): text index, first start, length in starts, key."""
    n = len(buf) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty.astype(np.uint64)
    h = _BYTE[buf]
    for k, step in enumerate(_STEP):
        h = h[: -(1 << k)] * step + h[1 << k :]
    h = mix64(h)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    if salts is not None:
        h ^= mix64(np.repeat(salts.astype(np.int64).view(np.uint64), np.diff(ends, prepend=0)))[: len(h)]
    grams, width = window - GRAM + 1, 1
    while width * 2 <= grams:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < grams:
        h = np.minimum(h[: -(grams - width)], h[grams - width :])
    h = h[:n]
    valid = np.arange(n) + window <= ends[owner]
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    first, length = first[valid[first]], length[valid[first]]
    return owner[first], first, length, mix64(h[first])


def pieces(texts: list[bytes], window: int):
    """Chunks of about CHUNK bytes: (buffer, ends, text index, offset in its text); long texts overlap by window - 1."""
    part, ends, index, offset, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), CHUNK):
            piece = text[at : at + CHUNK + window - 1]
            if len(piece) < window:
                continue
            part.append(piece)
            size += len(piece)
            ends.append(size)
            index.append(i)
            offset.append(at)
            if size >= CHUNK:
                yield np.frombuffer(b"".join(part), np.uint8), np.array(ends), np.array(index), np.array(offset)
                part, ends, index, offset, size = [], [], [], [], 0
    if part:
        yield np.frombuffer(b"".join(part), np.uint8), np.array(ends), np.array(index), np.array(offset)


def _post(window: int, blocks: int, everywhere: bool):
    """Rows (text, salt, bucket) -> packed keys (block, keys): 48 bits of key and 16 bits of bucket an entry."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            salts, bucket = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint64)
            seen = {}
            keep = np.array([everywhere or seen.setdefault((t, s), i) == i for i, (t, s) in enumerate(zip(texts, salts.tolist()))])
            found = []
            for buf, ends, index, _ in pieces([t if k else b"" for t, k in zip(texts, keep)], window):
                owner, _, _, key = runs(buf, ends, salts[index] if salts.any() else None, window)
                # one entry per text and key
                order = np.lexsort((key, index[owner]))
                key, text = key[order], index[owner][order]
                one = np.ones(len(key), bool)
                one[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                found.append((key[one] & ~np.uint64(0xFFFF)) | bucket[text[one]])
            if not found:
                continue
            entry, count = np.unique(np.concatenate(found), return_counts=True)
            entry = np.sort(np.concatenate([entry, entry[count > 1]]))
            block = ((entry >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int32)
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            data = [entry[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(entry)))]
            yield pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.array(data, pa.binary())], names=["block", "keys"])

    return run


def _answer(buckets: int):
    """An owner's postings -> (bucket, keys) of the keys with more than one posting."""

    def run(batches):
        data = [k for batch in batches for k in batch.column(1).to_pylist()]
        trim()
        if not data:
            return
        entry = np.sort(np.frombuffer(b"".join(data), np.uint64))
        data.clear()
        key = entry >> np.uint64(16)
        same = key[1:] == key[:-1]
        shared = np.zeros(len(entry), bool)
        shared[1:] |= same
        shared[:-1] |= same
        entry = np.unique(entry[shared])
        bucket = (entry & np.uint64(0xFFFF)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, key = bucket[order], (entry >> np.uint64(16))[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        if len(cut):
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut]), pa.array([key[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(key)))], pa.binary())], names=["bucket", "keys"]
            )

    return run


_FRAGMENTS = "block int, doc_id long, tid long, text binary, docs binary, tids binary, starts binary, lens binary, data binary"


def _ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + length[i] - 1, end to end."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


def _fragments(window: int, blocks: int, everywhere: bool):
    """A bucket's texts and repeated keys -> one row per text that has candidates, and packed fragments per block.

    Equal fragments within the bucket are settled here: only the smallest doc_id's (and with everywhere the largest's)
    go on to the owner, the others are marked at once (block -1), so a string in a third of all documents
    reaches its owner once per bucket.
    """
    schema = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("tid", pa.int64()), *((k, pa.binary()) for k in ("text", "docs", "tids", "starts", "lens", "data"))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        pack = zstandard.ZstdCompressor(level=1).compress
        keys = np.unique(np.frombuffer(b"".join(right.column("keys").to_pylist()), np.uint64))
        best: dict = {}
        for doc, tid, text, salt in zip(*(left.column(k).to_pylist() for k in ("doc_id", "tid", "text", "salt"))):
            old = best.get((tid, text, salt))
            if old is None or doc < old:
                best[(tid, text, salt)] = doc
        texts = [t for _, t, _ in best]
        docs, tids, salts = np.array(list(best.values()), np.int64), np.array([t for t, _, _ in best], np.int64), np.array([s for *_, s in best], np.int64)
        index: dict[bytes, int] = {}
        frags, which, where, starts, blocks_ = [], [], [], [], []
        for buf, ends, piece, offset in pieces(texts, window) if len(keys) else ():
            owner, first, length, key = runs(buf, ends, salts[piece] if salts.any() else None, window)
            at = np.searchsorted(keys, key >> np.uint64(16))
            ok = keys[np.minimum(at, len(keys) - 1)] == key >> np.uint64(16)
            owner, first, length, key = owner[ok], first[ok], length[ok], key[ok]
            raw = buf.tobytes()
            new = len(index)
            number = np.fromiter((index.setdefault(raw[a : a + n + window - 1], len(index)) for a, n in zip(first.tolist(), length.tolist())), np.int64, len(first))
            fresh = np.zeros(len(index) - new, np.int32)
            block = ((key >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int32)
            fresh[number[number >= new] - new] = block[number >= new]
            blocks_.append(fresh)
            which.append(number)
            where.append(piece[owner])
            starts.append(first - np.concatenate([[0], ends[:-1]])[owner] + offset[owner])
        frags = list(index)
        del index
        if not frags:
            return pa.table({k: [] for k in schema.names}, schema=schema)
        which, where, starts, blocks_ = np.concatenate(which), np.concatenate(where), np.concatenate(starts).astype(np.int64), np.concatenate(blocks_)
        doc = docs[where]
        low, high = np.full(len(frags), np.iinfo(np.int64).max), np.full(len(frags), np.iinfo(np.int64).min)
        np.minimum.at(low, which, doc)
        np.maximum.at(high, which, doc)
        sent = (doc == low[which]) | (everywhere & (doc == high[which]))
        rows = {k: [] for k in schema.names}

        def put(*values) -> None:
            for k, v in zip(schema.names, values):
                rows[k].append(v)

        for i in np.unique(where):
            put(None, int(docs[i]), int(tids[i]), texts[i], None, None, None, None, None)
        size = np.array([len(f) for f in frags], np.int64) - window + 1

        def arrays(at: np.ndarray) -> list[bytes]:
            return [pack(x.tobytes()) for x in (doc[at], tids[where[at]], starts[at], size[which[at]].astype(np.int32))]

        if not sent.all():
            put(-1, None, None, None, *arrays(np.flatnonzero(~sent)), None)
        go = np.flatnonzero(sent)
        go = go[np.argsort(blocks_[which[go]], kind="stable")]
        cut = np.append(np.flatnonzero(np.diff(blocks_[which[go]], prepend=-1)), len(go))
        for a, b in zip(cut, cut[1:]):
            put(int(blocks_[which[go[a]]]), None, None, None, *arrays(go[a:b]), pack(b"".join([frags[i] for i in which[go[a:b]].tolist()])))
        return pa.table(rows, schema=schema)

    return run


def _settled(window: int):
    """What buckets have marked already -> (doc_id, tid, lo, hi)."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                docs, tids, starts = (np.frombuffer(unpack(row[k]), np.int64) for k in ("docs", "tids", "starts"))
                lens = np.frombuffer(unpack(row["lens"]), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs, tids, starts, starts + lens + window - 1)], names=["doc_id", "tid", "lo", "hi"])

    return run


def two_stage(data: np.ndarray, first: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes starting at first[i] .. first[i] + length[i] - 1, sorted to depth bytes.

    data ends each fragment with depth - 1 further bytes and then a 0; all bytes before it are shifted up by one.
    """
    t, n = data, len(data)
    # smaller than the successor: by the next different byte
    change = np.flatnonzero(t[:-1] != t[1:])
    small = np.zeros(n, bool)
    up = t[change] < t[change + 1]
    small[: change[-1] + 1 if len(change) else 0] = np.repeat(up, np.diff(change, prepend=-1)) if len(change) else []
    want = np.zeros(n, bool)
    want[_ragged(first, length)] = True
    # a larger suffix needs its successors down to the next smaller one (or the fragment's end)
    last = first + length - 1
    stop = np.append(np.flatnonzero(small | (t == 0)), n - 1)
    until = stop[np.searchsorted(stop, last)]
    want[_ragged(last, until - last + 1)] = True
    direct = np.flatnonzero(want & (small | (t == 0)))
    words = -(-depth // 7) + 1

    def word(pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pos), np.uint64)
        for k in range(7):
            out = (out << np.uint64(9)) | t[np.minimum(pos + k, n - 1)].astype(np.uint64)
        return out

    order = direct[np.argsort(k0 := word(direct), kind="stable")]
    group = np.cumsum(np.diff(np.sort(k0), prepend=np.uint64(0)) != 0) if len(k0) else np.zeros(0, np.int64)
    for w in range(1, words):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = word(order[at] + 7 * w)
        by = np.lexsort((key, group[at]))
        order[at] = order[at][by]
        key, g = key[by], group[at]
        fresh = np.zeros(len(order), np.int64)
        fresh[at[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        step = np.diff(group, prepend=group[0]) != 0
        group = np.cumsum(step | (fresh > 0))
    # induce the larger suffixes, bucket by bucket in byte order
    head = t[order]
    bounds = np.searchsorted(head, np.arange(258))
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    larger = want & ~small & (t != 0)
    out = []

    def scan(pos: np.ndarray) -> None:
        before = pos[pos > 0] - 1
        before = before[larger[before]]
        if len(before):
            c = t[before]
            by = np.argsort(c, kind="stable")
            before, c = before[by], c[by]
            cut = np.append(np.flatnonzero(np.diff(c.astype(np.int32), prepend=-1)), len(c))
            for a, b in zip(cut, cut[1:]):
                pending[int(c[a])].append(before[a:b])

    for c in range(257):
        while pending[c]:
            found = np.concatenate(pending[c])
            pending[c] = []
            out.append(found)
            scan(found)
        own = order[bounds[c] : bounds[c + 1]]
        out.append(own)
        scan(own)
    result = np.concatenate(out) if out else np.zeros(0, np.int64)
    inside = np.zeros(n, bool)
    inside[_ragged(first, length)] = True
    return result[inside[result]]


def _load(rows: list[tuple]):
    """Packed rows (docs, tids, starts, lens, data) -> their arrays and bytes end to end."""
    unpack = zstandard.ZstdDecompressor().decompress
    docs, tids, starts, lens, data = ([unpack(row[i]) for row in rows] for i in range(5))
    docs, tids, starts = (np.frombuffer(b"".join(x), np.int64) for x in (docs, tids, starts))
    return docs, tids, starts, np.frombuffer(b"".join(lens), np.int32).astype(np.int64), b"".join(data)


def _strings(buf: np.ndarray, ends: np.ndarray, window: int):
    """As runs, but keyed by the whole string: only strings that are equal share a key."""
    n = max(0, len(buf) - window + 1)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * _STEP[0] + _BYTE[buf[k : k + n]]
    begins = np.concatenate([[0], ends[:-1]])
    length = ends - begins - window + 1
    at, owner = _ragged(begins, length), np.repeat(np.arange(len(ends)), length)
    new = np.ones(len(at), bool)
    new[1:] = (h[at[1:]] != h[at[:-1]]) | (owner[1:] != owner[:-1])
    cut = np.flatnonzero(new)
    return owner[cut], at[cut], np.diff(np.append(cut, len(at))), mix64(h[at[cut]])


def _shares(rows: list[tuple], window: int, order: int = 0):
    """An owner's packed rows -> lists of rows of at most SHARE bytes; equal strings are in one list.

    Fragments are dealt by the key they came by. Shares that are too large because of one key are cut into fragments anew,
    by another order of grams each time and by whole strings at last. rows is emptied.
    """
    total = sum(row[5] for row in rows)
    if total <= SHARE or order > ORDERS:
        yield rows
        return
    pack = zstandard.ZstdCompressor(level=1).compress
    shares: list[list[tuple]] = [[] for _ in range(-(-2 * total // SHARE))]
    while rows:
        some, size = [], 0
        while rows and size < CHUNK:
            some.append(rows.pop())
            size += some[-1][5]
        docs, tids, starts, lens, data = _load(some)
        buf, ends = np.frombuffer(data, np.uint8), np.cumsum(lens + window - 1)
        owner, first, length, key = _strings(buf, ends, window) if order == ORDERS else runs(buf, ends, np.full(len(ends), order), window)
        begins = first - np.concatenate([[0], ends[:-1]])[owner] + starts[owner]
        share = (key % np.uint64(len(shares))).astype(np.int64)
        by = np.argsort(share, kind="stable")
        cut = np.append(np.flatnonzero(np.diff(share[by], prepend=-1)), len(by))
        for a, b in zip(cut, cut[1:]):
            at = by[a:b]
            size = length[at] + window - 1
            parts_ = docs[owner[at]], tids[owner[at]], begins[at], length[at].astype(np.int32), buf[_ragged(first[at], size)]
            shares[share[at[0]]].append((*(pack(x.tobytes()) for x in parts_), int(size.sum())))
    shares.reverse()
    while shares:
        if mine := shares.pop():
            yield from _shares(mine, window, order + 1)


def _mark(window: int, everywhere: bool):
    """An owner's fragments -> (doc_id, tid, lo, hi): bytes covered by repeated strings. everywhere: the first document's too."""

    def run(batches):
        trim()
        size = lambda lens: len(x := np.frombuffer(zstandard.ZstdDecompressor().decompress(lens), np.int32)) * (window - 1) + int(x.sum(dtype=np.int64))
        rows = [(row["docs"], row["tids"], row["starts"], row["lens"], row["data"], size(row["lens"])) for batch in batches for row in batch.to_pylist()]
        for share in _shares(rows, window):
            if share:
                yield from mark(share)

    def mark(rows):
        docs, tids, starts, lens, raw = _load(rows)
        rows.clear()
        ends = np.cumsum(lens + window - 1)
        # each different fragment once
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(raw[e - n - window + 1 : e], len(index)) for e, n in zip(ends.tolist(), lens.tolist())), np.int64, len(ends))
        del raw
        frags = list(index)
        least = np.full(len(frags), np.iinfo(np.int64).max)
        most = np.full(len(frags), np.iinfo(np.int64).min)
        np.minimum.at(least, which, docs)
        np.maximum.at(most, which, docs)
        size = np.array([len(f) for f in frags])
        length = size - window + 1
        data = np.frombuffer(b"\0".join(frags) + b"\0", np.uint8).astype(np.uint16) + 1
        tail = np.cumsum(size + 1) - 1
        data[tail] = 0
        first = tail - size
        sa = two_stage(data, first, length, window)
        # adjacent common prefixes
        same = np.ones(max(0, len(sa) - 1), bool)
        for k in range(window):
            live = np.flatnonzero(same)
            if not len(live):
                break
            same[live] = data[sa[live] + k] == data[sa[live + 1] + k]
        group = np.concatenate([[0], np.cumsum(~same)]) if len(sa) else np.zeros(0, np.int64)
        frag = np.searchsorted(tail, sa)
        low = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        high = np.full(len(low), np.iinfo(np.int64).min)
        np.minimum.at(low, group, least[frag])
        np.maximum.at(high, group, most[frag])
        lo_at = np.full(len(data), np.iinfo(np.int64).max)
        lo_at[sa] = np.where(high > low, low, np.iinfo(np.int64).max)[group]
        step = max(1, CHUNK // max(1, int(lens.mean())))
        for a in range(0, len(docs), step):
            n = lens[a : a + step]
            at = _ragged(first[which[a : a + step]], n)
            occ = np.repeat(np.arange(len(n)), n)
            bar = lo_at[at]
            gone = bar < np.iinfo(np.int64).max if everywhere else bar < docs[a : a + step][occ]
            offset = at - first[which[a : a + step]][occ]
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            border = np.flatnonzero(occ[1:] != occ[:-1]) + 1
            on = np.zeros(len(gone), bool)
            on[gone & (np.concatenate([[True], ~gone[:-1]]) if len(gone) else gone)] = True
            on[border[gone[border]]] = True
            off = gone & (np.concatenate([~gone[1:], [True]]) if len(gone) else gone)
            off[border[gone[border - 1]] - 1] = True
            b, e = np.flatnonzero(on), np.flatnonzero(off)
            del edge
            if len(b):
                o = occ[b]
                base = starts[a : a + step][o]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[a : a + step][o]), pa.array(tids[a : a + step][o]), pa.array(base + offset[b]), pa.array(base + offset[e] + window)], names=["doc_id", "tid", "lo", "hi"]
                )

    return run


def repeated(spark: SparkSession, texts: DataFrame, window: int, everywhere: bool = False, name: str = "suffix") -> tuple[DataFrame, DataFrame]:
    """texts(doc_id, tid, text binary, salt): per (doc_id, tid) with candidates its text, and its covered byte ranges.

    Strings match within one salt only. Without everywhere, tid must be a hash of the text: of equal texts only the
    smallest doc_id takes part. With everywhere, tid tells rows apart and every row takes part. Returns
    (candidates(doc_id, tid, text), spans(doc_id, tid, lo, hi)), both in the shared folder; spans may overlap.
    """
    if not GRAM <= window:
        raise ValueError("window")
    blocks, buckets, owners = parts(spark), min(2 * parts(spark), 1 << 16), 2 * parts(spark)
    rows = texts.select("doc_id", "tid", "text", "salt", F.pmod("tid", F.lit(buckets)).cast("int").alias("bucket"))
    posted = rows.select("text", "salt", "bucket").mapInArrow(_post(window, blocks, everywhere), "block int, keys binary")
    answers = stash(posted.repartitionById(blocks, "block").mapInArrow(_answer(buckets), "bucket int, keys binary"), f"{name}-keys")
    del posted
    release(spark)
    local = rows if everywhere else rows.mapInArrow(_first_of_batch, "doc_id long, tid long, text binary, salt long, bucket int")
    found = stash(local.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_fragments(window, owners, everywhere), _FRAGMENTS).withColumn("part", F.when(F.col("block").isNull(), "texts").otherwise("fragments")), f"{name}-fragments", by="part")
    unstash(answers)
    release(spark)
    packed = found.filter("part = 'fragments' AND block >= 0").select("block", "docs", "tids", "starts", "lens", "data")
    ranges = "doc_id long, tid long, lo long, hi long"
    settled = found.filter("part = 'fragments' AND block < 0").select("docs", "tids", "starts", "lens").mapInArrow(_settled(window), ranges)
    spans = stash(packed.repartitionById(owners, "block").mapInArrow(_mark(window, everywhere), ranges).union(settled), f"{name}-spans")
    unstash(found, part="part=fragments")
    release(spark)
    return found.filter("part = 'texts'").select("doc_id", "tid", "text"), spans


def _first_of_batch(batches):
    """Of equal texts in a batch only the smallest doc_id."""
    for batch in batches:
        best: dict = {}
        cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 3)]
        for i, (doc, tid, text, salt) in enumerate(zip(*cols)):
            old = best.get((tid, text, salt))
            if old is None or doc < cols[0][old]:
                best[(tid, text, salt)] = i
        yield batch.take(pa.array(sorted(best.values()), pa.int64()))
