"""Substring dedup by sliding sentence spans.

Every run of SPAN consecutive sentences (which end at sentence marks and line ends) is hashed over its lower-case words;
runs under FEW words are left to the longer ones around them, since three sentences of a word or two meet by chance in any
large corpus. As passages may also be quoted without their sentence ends or wrapped otherwise, sentences are cut further
into units, behind the word with the least hash of every WINDOW consecutive words (a sentence end counts as least). Whether
a word ends a unit so depends on WINDOW - 1 words to each side, and no unit has more than WINDOW words. Every run of SPAN
consecutive units that has MIN_WORDS words or more (shorter runs grow until they have) is hashed too; a run that would end
at a line end is hashed also up to the next end that its words alone decide. So any two
places with the same 50 words in a row share a span, wherever the passage stands: it starts in words 7 to 13, has at most
30 words and ends before the last 7. Hashes meet globally, the first span of a hash is the one with the smallest
(doc_id, position), and units that any other span of it covers are removed. Spans repeated within one document count.

Defined results: null text counts as empty; texts under FEW words, or under MIN_WORDS with fewer than SPAN sentences, lose nothing; a null doc_id counts as
the smallest; rows that share doc_id and text are one document; no rows give no rows; further columns are ignored.
Equal texts of a batch collapse before spans are hashed; a copy loses all units that some span covers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, release, stash, table, unstash

SPAN = 3
MIN_WORDS = 24
FEW = 8
WINDOW = 7
LEAST = -(2**63)
#: Characters of texts that are cut and hashed in one go.
GROUP = 1 << 20
_END = re.compile(r"[.!?…。！？][\"')\]]*\Z")
_WORD = re.compile(r"\S+")
#: White space as str.split has it, up to the last such character and one more.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])
#: An odd factor, so that its powers have inverses modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15


class _Words(dict):
    """64-bit hashes of lower-case words; bit 0 tells whether the word ends a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) & ~1 | bool(_END.search(word))
        return h


_HASHES = _Words()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers, or more, of the factor and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(12, n.bit_length())
        _POWERS[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, f, np.uint64)]) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
    return _POWERS


def _groups(texts: list[str]):
    """Ranges of texts of GROUP characters or a little more, to be laid end to end: short texts share the cost of a call."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _ends(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: word hashes; the words before each bound of units, 0 first; which bounds the words
    decide, and at which a sentence or line ends; the number of the first unit of each text, and of all units."""
    words, lines, tops = [], [], [0]
    for text in texts:
        for line in text.lower().split("\n"):
            words += line.split()
            lines.append(len(words))
        tops.append(len(words))
    n = len(words)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    own = np.zeros(n + 1, bool)
    own[1:] = h & np.uint64(1)
    sentence = own.copy()
    sentence[lines] = sentence[0] = True
    if n >= WINDOW:
        least, at, width = np.where(own[1:], np.uint64(0), h), np.zeros(n, np.int8), 1
        while width < WINDOW:  # the least of width words, the last of equal ones, and how far behind the first it is
            step = min(width, WINDOW - width)
            later = least[step:] <= least[:-step]
            at = np.where(later, at[step:] + np.int8(step), at[:-step])
            least = np.minimum(least[step:], least[:-step])
            width += step
        whole = np.ones(len(at), bool)  # windows lie within one text
        across = (np.array(tops)[:, None] - np.arange(1, WINDOW)).ravel()
        whole[across[(across >= 0) & (across < len(whole))]] = False
        own[(np.arange(1, len(at) + 1) + at)[whole]] = True
    bounds = np.flatnonzero(own | sentence)
    return h, bounds, own[bounds], sentence[bounds], np.searchsorted(bounds, tops)


def units(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the units."""
    words, bounds = [m.span() for m in _WORD.finditer(text)], _ends([text])[1].tolist()
    return [(words[a][0], words[b - 1][1], b - a) for a, b in zip(bounds, bounds[1:])]


def _spans(h: np.ndarray, bounds: np.ndarray, own: np.ndarray, sentence: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First unit, the unit behind the last and hash of every sliding span of texts cut by _ends, as columns."""
    top = np.repeat(tops[1:], np.diff(tops))
    first = np.arange(len(top))
    near = np.maximum(np.searchsorted(bounds, bounds[:-1] + MIN_WORDS), first + SPAN)
    far = np.minimum.accumulate(np.where(own, np.arange(len(own)), len(own))[::-1])[::-1][np.minimum(near, len(top))]
    last = np.stack([near, far], 1)
    keep = last <= top[:, None]
    keep[:, 1] &= (near != far) & keep[:, 0]  # a run that cannot grow to MIN_WORDS is none
    there = np.where(keep, last, -1)
    first, last = np.broadcast_to(first[:, None], last.shape)[keep], last[keep]
    stops = np.flatnonzero(sentence)
    start, end = stops[:-SPAN], stops[SPAN:]
    fit = (end <= top[start]) & (bounds[end] - bounds[start] >= FEW)
    start, end = start[fit], end[fit]
    fresh = (there[start] != end[:, None]).all(1)
    first, last = np.r_[first, start[fresh]], np.r_[last, end[fresh]]
    power, inverse = _powers(len(h) + 1)
    total = np.r_[np.uint64(0), np.cumsum(h * power[: len(h)], dtype=np.uint64)]
    lo, hi = bounds[first], bounds[last]
    return first, last, mix64((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64)).view(np.int64)


def spans(text: str):
    """(first unit, units, hash) of every sliding span."""
    first, last, h = _spans(*_ends([text]))
    yield from zip(first.tolist(), (last - first).tolist(), h.tolist())


def _hash(batches):
    """Every span of every different text in a batch; equal texts of a batch send the smallest doc_id's only."""
    for batch in batches:
        best: dict = {}
        for doc, tid, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (tid, text) not in best or doc < best[(tid, text)]:
                best[(tid, text)] = doc
        texts, ids = [text for _, text in best], np.array([(doc, tid) for (tid, _), doc in best.items()], np.int64).reshape(-1, 2)
        for a, b in _groups(texts):
            cut = _ends(texts[a:b])
            first, last, h = _spans(*cut)
            tops = cut[-1]
            of = np.repeat(np.arange(b - a), np.diff(tops))[first]
            doc, tid = ids[a:b][of].T
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (h, doc, tid, (first - tops[of]).astype(np.int32), (last - first).astype(np.int32))], names=["h", "doc_id", "tid", "first", "n"]
            )


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and end, the texts laid end to end with one character between them."""
    blank = _BLANK[np.minimum(np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32), len(_BLANK) - 1)]
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    return edges[::2], edges[1::2]


def _cut(texts: list[str], ranges: pa.ListArray) -> list[pa.Array]:
    """Number of units, of removed ones, the removed ones and what is left of each text, given the units to remove (first, n);
    n below 0 stands for all units that spans of the text itself cover."""
    cut = _ends(texts)
    bounds, tops = cut[1], cut[-1]
    n, of = tops[-1], np.repeat(np.arange(len(texts)), np.diff(tops))
    first, many = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in ranges.flatten().flatten())
    rows = np.repeat(np.arange(len(texts)), ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    first, last = first + tops[rows], first + tops[rows] + many
    copies = np.zeros(len(texts), bool)
    copies[rows[many < 0]] = True
    first, last = first[many >= 0], last[many >= 0]
    if copies.any():
        of_all, to_all, _ = _spans(*cut)
        mine = copies[of[of_all]]
        first, last = np.r_[first, of_all[mine]], np.r_[last, to_all[mine]]
    gone = np.flatnonzero(np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1))[:n])
    row = of[gone]
    count = np.bincount(row, minlength=len(texts))
    kept = list(texts)
    if len(gone):
        starts, ends = _words(texts)
        shift = np.cumsum([0] + [len(t) + 1 for t in texts])[row]
        lo, hi = (starts[bounds[gone]] - shift).tolist(), (ends[bounds[gone + 1] - 1] - shift).tolist()
        k = 0
        for i in np.flatnonzero(count).tolist():
            text, at, pieces = texts[i], 0, []
            for k in range(k, k + int(count[i])):
                pieces.append(text[at : lo[k]])
                at = hi[k]
            k += 1
            pieces.append(text[at:])
            kept[i] = "".join(pieces)
    removed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array((gone - tops[row]).astype(np.int32)))
    return [pa.array(np.diff(tops)), pa.array(count), removed, pa.array(kept, pa.string())]


def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, rep_id (smallest doc_id with this text), n_units, n_removed, removed (unit numbers), kept_text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    members = stash(rows.select("doc_id", "tid").groupBy("tid").agg(F.min("doc_id").alias("rep_id")), "spans-reps")
    found = stash(rows.select("doc_id", "tid", "text").mapInArrow(_hash, "h long, doc_id long, tid long, first int, n int"), "spans")
    # Most hashes stand once; only those that don't need their places.
    twice = stash(found.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "spans-twice")
    release(spark)
    places = stash(found.join(twice, "h"), "spans-places")
    unstash(found, twice)
    del found, twice
    release(spark)
    # Spans of copies are never first, so they may stay until only repeated hashes are left; the text's own are kept then.
    firsts = stash(places.groupBy("h").agg(F.min(F.struct("doc_id", "tid", "first")).alias("f")), "spans-firsts")
    release(spark)
    later = places.join(firsts, "h").filter(F.struct("doc_id", "tid", "first") != F.col("f")).select("tid", "doc_id", "first", "n")
    later = later.join(members.select("tid", F.col("rep_id").alias("doc_id")), ["tid", "doc_id"])
    per_text = later.groupBy("tid").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    # one table with a row per text, so that the join with all rows is the last one and a hot text's rows can be split
    texts = stash(members.join(per_text, "tid", "left"), "spans-texts")
    unstash(places, firsts)
    del places, firsts, later, per_text
    release(spark)
    # a copy of an earlier text loses every unit that a span of the text covers
    joined = rows.join(texts, "tid")
    every = F.when(F.col("doc_id") > F.col("rep_id"), F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).alias("n")))).otherwise(F.col("ranges"))
    out = joined.select("doc_id", "tid", "text", every.alias("ranges"), "rep_id")
    return out.mapInArrow(_finish, "doc_id long, rep_id long, n_units long, n_removed long, removed array<int>, kept_text string").withColumn("doc_id", F.when(F.col("doc_id") > LEAST, F.col("doc_id")))


def _finish(batches):
    """Cuts the texts of doc_id, tid, text, ranges, rep_id."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in _groups(texts):
            part = batch.slice(a, b - a)
            out = [part.column(0), part.column(4), *_cut(texts[a:b], part.column(3))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "rep_id", "n_units", "n_removed", "removed", "kept_text"])


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_units", "n_removed", "removed", F.sha2("kept_text", 256).alias("kept_sha256"))
