"""N-gram Jaccard join: documents whose distinct 5-word shingle sets have a Jaccard similarity of 0.75 or more.

The join is a product of the sparse document-by-shingle matrix with its transpose, blocked by shingle. A set's row
holds only its first n - ceil(0.75 n) + ceil(n / 8) shingles in hash order: two similar sets share at least
ceil(min / 8) of those, and that size-derived bound discards the rest.

1. Batches post (shingle, set) entries, packed by shingle block; equal sets are one row (id: 64-bit digest of the
   set). Shingles of two sets within a batch are known to be shared at once and send one entry to their owner, so a
   shingle of a third of all documents reaches its owner once per batch. Owners keep shingles of two or more sets.
2. Sets with too few shared shingles for any partner drop out. The whole sets of the others are counted again, and each
   keeps its n - ceil(0.75 n) + ceil(n / 16) rarest shingles: two similar sets share at least ceil(min / 16) of those, while
   passages that many otherwise different documents quote are common and seldom among them.
3. In turns, every shingle that spans several components names a leader: of its sets (later of a random share of them) the one with the most common shingles, which is
   the least edited of a group of near copies; overlap counts accumulate per
   (set, leader), pairs below the bound go, the rest is verified on whole sets. Large groups of near copies contract
   here with one pair per set and leader. Turns end when they link under a 200th of the sets (or after TURNS); they
   only save work, what they leave is the next step's.
4. For shingles that still span components, sets outside the largest component there meet the sets of other
   components; counts accumulate, bounds discard, whole sets verify. Pairs inside one component need no test.
   Where a pair's rarest common shingle is hot (64 sets or more have it), all its overlap is hot, so the pair is only
   formed if both sets have enough hot shingles for 0.75: edited copies of one stock text do not all meet.
5. Links close to components by minimum-label propagation with pointer jumping.

Defined results: null text and texts without words have an empty set, link with nothing and are their own component;
a text of one to four words has one shingle; equal sets are linked; a null doc_id passes through, is linked with equal sets and, where no other row has the set, with nothing else, and
never names a component unless all doc_ids there are null; repeated rows get equal results; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, mix64, parts, release, scratch, stash, sweep, table, trim, unstash

K = 5
PERCENT = 75
SLACK = 16
SCREEN = 8
TURNS = 12
STOP = 200
HOT = 64
BATCH_SETS = 1 << 13
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 1 << 19


def shingle_hashes(text: str | None, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < K:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in set(words):
        if w not in cache:
            cache[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = len(h) - K + 1
    out = h[:n].copy()
    for i in range(1, K):
        out = out * _STEP + h[i : i + n]
    return np.unique(mix64(out))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) >> 1 if len(hashes) else 0


def prefix(n: int) -> int:
    return min(n, n - -(-PERCENT * n // 100) + -(-n // SCREEN))


ROW = "kind int, block int, docs array<long>, sids binary, sizes binary, keys binary"
_ROW = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("docs", pa.list_(pa.int64())), ("sids", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


def _post(blocks: int):
    """Documents -> kind 0: doc ids with set ids and sizes; kind 1: entries (shingle 48 bits, settled 1 bit, set 15 bits)
    for the shingle's owner; kind 2: settled entries, for any task."""

    def flush(docs, sids, sizes, known, number):
        rows = [(0, number % blocks, docs, np.array(sids, np.int64).tobytes(), np.array(sizes, np.int32).tobytes(), None)]
        if known:
            ids, ns = np.fromiter(known, np.int64, len(known)), np.array([len(g) for g in known.values()], np.int32)
            cut = [g[: prefix(len(g))] for g in known.values()]
            gram = np.concatenate(cut) >> np.uint64(16)
            row = np.repeat(np.arange(len(cut), dtype=np.uint64), [len(g) for g in cut])
            order = np.argsort(gram, kind="stable")
            gram, row = gram[order], row[order]
            same = gram[1:] == gram[:-1]
            shared, first = np.zeros(len(gram), bool), np.ones(len(gram), bool)
            shared[1:] |= same
            shared[:-1] |= same
            first[1:] = ~same
            keep = ~shared | first
            key = gram[keep] << np.uint64(16) | shared[keep].astype(np.uint64) << np.uint64(15) | row[keep]
            block = ((key >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int32)
            at = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(key))
            for a, b in zip(at, at[1:]):
                used, local = np.unique(key[a:b] & np.uint64(0x7FFF), return_inverse=True)
                used = used.astype(np.int64)
                packed = key[a:b] & ~np.uint64(0x7FFF) | local.astype(np.uint64)
                rows.append((1, int(block[a]), None, ids[used].tobytes(), ns[used].tobytes(), packed.tobytes()))
            if shared.any():
                rows.append((2, (number * 7919 + 1) % blocks, None, ids.tobytes(), ns.tobytes(), (gram[shared] << np.uint64(16) | row[shared]).tobytes()))
        return _rows(rows)

    def run(batches):
        cache: dict[bytes, int] = {}
        docs, sids, sizes, known, number, weight = [], [], [], {}, 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = shingle_hashes(text, cache)
                sid = set_id(grams)
                docs.append(doc)
                sids.append(sid)
                sizes.append(len(grams))
                if len(grams) and sid not in known:
                    known[sid] = grams
                    weight += len(grams)
                if len(known) >= BATCH_SETS or weight >= 3 << 20 or len(docs) >= 1 << 16:
                    yield flush(docs, sids, sizes, known, number)
                    docs, sids, sizes, known, number, weight = [], [], [], {}, number + 1, 0
        if docs:
            yield flush(docs, sids, sizes, known, number)

    return run


OWNED = "doc_id long, gram long, sid long, n int"
_OWNED = pa.schema([("doc_id", pa.int64()), ("gram", pa.int64()), ("sid", pa.int64()), ("n", pa.int32())])


def _own(batches):
    """A block's rows -> documents (gram null) and shared entries (doc_id null)."""

    def out(docs, gram, sid, n):
        size = len(sid)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()) if docs is not None else pa.nulls(size, pa.int64()), pa.array(gram) if gram is not None else pa.nulls(size, pa.int64()), pa.array(sid), pa.array(n)], schema=_OWNED)

    trim()
    keys, sids, ns = [], [], []
    base = 0
    for batch in batches:
        for row in batch.to_pylist():
            sid, n = np.frombuffer(row["sids"], np.int64), np.frombuffer(row["sizes"], np.int32)
            if row["kind"] == 0:
                yield out(row["docs"], None, sid, n)
                continue
            key = np.frombuffer(row["keys"], np.uint64)
            at = (key & np.uint64(0x7FFF)).astype(np.int64)
            if row["kind"] == 2:
                yield out(None, (key >> np.uint64(16)).view(np.int64), sid[at], n[at])
                continue
            keys.append(key >> np.uint64(15))
            sids.append(sid[at])
            ns.append(n[at])
    if not keys:
        return
    key, sid, n = np.concatenate(keys), np.concatenate(sids), np.concatenate(ns)
    del keys, sids, ns
    settled, gram = (key & np.uint64(1)).astype(bool), (key >> np.uint64(1)).view(np.int64)
    order = np.lexsort((sid, gram))
    gram, sid, n, settled = gram[order], sid[order], n[order], settled[order]
    # one entry per shingle and set; a settled one wins, as its row has been sent already
    start = np.ones(len(gram), bool)
    start[1:] = (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])
    at = np.flatnonzero(start)
    settled = np.logical_or.reduceat(settled, at) if len(at) else settled
    gram, sid, n = gram[at], sid[at], n[at]
    shared = settled.copy()
    same = gram[1:] == gram[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    go = shared & ~settled
    if go.any():
        yield out(None, gram[go], sid[go], n[go])


def _sets(batches):
    """Documents -> set id and all its shingles."""
    cache: dict[bytes, int] = {}
    for batch in batches:
        want = batch.column(2).to_pylist()
        found = [shingle_hashes(t, cache) for t in batch.column(1).to_pylist()]
        keep = [i for i, g in enumerate(found) if set_id(g) == want[i]]
        yield pa.RecordBatch.from_arrays([pa.array([want[i] for i in keep], pa.int64()), pa.array([found[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], names=["sid", "grams"])


def _bound(a: str, b: str) -> Column:
    return F.ceil(F.least(a, b) / F.lit(SLACK))


def _fits(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(x, y, nx, ny) that are similar on their whole sets, as (a, b)."""
    left = pairs.join(sets.select(F.col("sid").alias("x"), F.col("grams").alias("gx")), "x")
    both = left.join(sets.select(F.col("sid").alias("y"), F.col("grams").alias("gy")), "y")
    common = F.size(F.array_intersect("gx", "gy")).cast("long")
    return both.withColumn("common", common).filter(100 * F.col("common") >= PERCENT * (F.col("nx") + F.col("ny") - F.col("common"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _spanning(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries of shingles that several components have, with the component that has most of the shingle's sets.

    What is known of a shingle is written first: a join of plain tables is one whose hot keys Spark can split.
    """
    named = lists.join(comp, "sid")
    sizes = named.groupBy("gram", "comp").agg(F.count("*").alias("k")).groupBy("gram").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps"))
    major = stash(sizes.filter("comps > 1").select("gram", F.col("m.comp").alias("major")), "jaccard-major")
    out = stash(named.join(major, "gram"), "jaccard-mixed")
    unstash(major)
    return out


def _all_hot() -> Column:
    """Could the overlap that 0.75 asks for consist of hot shingles alone?"""
    return (100 + PERCENT) * F.least("sx", "sy") >= PERCENT * (F.col("nx") + F.col("ny"))


def _counted(meetings: DataFrame) -> DataFrame:
    """Overlap counts per pair, below the size-derived bound discarded; a pair that met on cold shingles only needs one."""
    bounded = _all_hot()
    swap = F.col("x") > F.col("y")
    pairs = meetings.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("nx"), F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("ny"), bounded.alias("bounded"))
    return pairs.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.count("*").alias("c"), F.min("bounded").alias("bounded")).filter(~F.col("bounded") | (F.col("c") >= _bound("nx", "ny"))).drop("c", "bounded")


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp(sid, comp) with the components that links join made one."""
    of = lambda name: comp.select(F.col("sid").alias(name), F.col("comp").alias(f"c{name}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct()
    moved = components(edges, "jaccard-cc").select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return stash(comp.join(moved, "comp", "left").select("sid", F.coalesce("to", "comp").alias("comp")), "jaccard-comp")


def jaccard_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, set_id."""
    before = scratch()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = parts(spark)
    owned = stash(docs.mapInArrow(_post(blocks), ROW).repartitionById(blocks, "block").mapInArrow(_own, OWNED), "jaccard-owned")
    release(spark)
    meta = owned.filter("gram IS NULL").select("doc_id", "sid", "n")
    entries = owned.filter("gram IS NOT NULL").groupBy("gram", "sid").agg(F.first("n").alias("n"))
    alive = entries.groupBy("sid").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter(F.col("c") >= F.ceil(F.col("n") / F.lit(SCREEN))).select("sid")
    # counted before the join, so that a set of very many documents sends one row a task
    reps = meta.groupBy("sid").agg(F.min("doc_id").alias("doc_id")).join(alive, "sid")
    sets = stash(docs.join(reps, "doc_id").select("doc_id", "text", "sid").mapInArrow(_sets, "sid long, grams array<long>").dropDuplicates(["sid"]), "jaccard-sets")
    release(spark)
    flat = sets.select("sid", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    common = flat.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    per_set = flat.join(common, "gram").groupBy("sid").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))  # a set's own shingles
    room = F.col("n") - F.ceil(PERCENT * F.col("n") / F.lit(100)) + F.ceil(F.col("n") / F.lit(SLACK)) - (F.col("n") - F.size("g"))
    # of the rarest shingles, a hot one (df >= HOT) only serves pairs whose overlap can be all hot
    stock = F.size(F.filter("g", lambda x: x["df"] >= HOT))
    lists = stash(
        per_set.withColumn("room", room.cast("int")).filter("room > 0").withColumn("stock", stock)
        .withColumn("w", F.floor(F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["df"]) * 1000 / F.col("n")).cast("long"))
        .select("sid", "n", "w", "stock", F.explode(F.slice("g", F.lit(1), F.col("room"))).alias("g"))
        .select("sid", "n", "w", "stock", "g.gram", (F.col("g.df") >= HOT).alias("hot")).filter(~F.col("hot") | (100 * F.col("stock") >= PERCENT * F.col("n"))),
        "jaccard-lists",
    )
    release(spark)
    comp = stash(lists.select("sid").distinct().withColumn("comp", F.col("sid")), "jaccard-comp")
    enough, tested = comp.count() / STOP, None
    for turn in range(TURNS):
        mixed = _spanning(lists, comp)
        lead = stash(mixed.groupBy("gram").agg(F.min(F.struct(F.pmod(F.xxhash64("sid", F.lit(turn)), F.lit(1 + 3 * turn)).alias("h"), (-F.col("w")).alias("w"), F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("stock").alias("sy"), F.col("comp").alias("cy"))).alias("l")).select("gram", "l.y", "l.ny", "l.sy", "l.cy"), "jaccard-leaders")
        member = mixed.select("gram", "hot", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("stock").alias("sx"), F.col("comp").alias("cx"))
        stars = _counted(member.join(lead, "gram").filter((F.col("cx") != F.col("cy")) & _fits("nx", "ny") & (~F.col("hot") | _all_hot())))
        fresh = stash(stars if tested is None else stars.join(tested, ["x", "y"], "left_anti"), "jaccard-stars")
        tested = fresh.select("x", "y") if tested is None else tested.union(fresh.select("x", "y"))
        links = stash(_verify(fresh, sets), "jaccard-links")
        unstash(mixed, lead)
        found = links.count()
        if found:
            comp = _merged(comp, links)
        if found <= enough:
            break
    mixed = _spanning(lists, comp)
    minor = mixed.filter("comp <> major").select("gram", "hot", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("stock").alias("sx"), F.col("comp").alias("cx"))
    other = mixed.select("gram", F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("stock").alias("sy"), F.col("comp").alias("cy"), "major")
    meet = minor.join(other, "gram").filter((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("major")) | (F.col("x") < F.col("y"))) & _fits("nx", "ny") & (~F.col("hot") | _all_hot()))
    last = stash(_verify(_counted(meet).join(tested, ["x", "y"], "left_anti"), sets), "jaccard-links")
    comp = _merged(comp, last).withColumnRenamed("sid", "node")
    unstash(mixed, lists)
    # back to documents
    classes = meta.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least")).join(comp.withColumnRenamed("node", "sid"), "sid", "left")
    classes = stash(classes.withColumn("comp", F.coalesce("comp", "sid")), "jaccard-classes")
    # written before it meets its sets, so that a component of very many sets can be split
    least = stash(classes.groupBy("comp").agg(F.min("least").alias("component_id")), "jaccard-least")
    names = stash(classes.join(least, "comp").select("sid", "component_id"), "jaccard-names")
    sweep(before, owned, names)
    return meta.join(names, "sid", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("sid").alias("set_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, table(spark, sf_dir, "documents")).drop("set_id")


#: Components over a relation `docs(doc_id, text)`, as relation `jaccard(doc_id, n_shingles, component_id)`; needs WITH RECURSIVE.
COMPONENTS_SQL = r"""
jw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
jsh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM jw),
jn AS (SELECT doc_id, count(*) AS n FROM jsh GROUP BY doc_id),
jpair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM jsh a JOIN jsh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
jlink AS (SELECT x, y FROM jpair JOIN jn p ON p.doc_id = x JOIN jn q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
jedge AS (SELECT x, y FROM jlink UNION ALL SELECT y, x FROM jlink),
jreach(doc_id, r) AS (SELECT doc_id, doc_id FROM docs UNION SELECT jreach.doc_id, jedge.y FROM jreach JOIN jedge ON jedge.x = jreach.r),
jaccard AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM jreach WHERE jreach.doc_id = docs.doc_id) AS component_id FROM docs LEFT JOIN jn USING (doc_id))
"""

ORACLE_SQL = f"WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {COMPONENTS_SQL} SELECT doc_id, n_shingles, component_id FROM jaccard"
