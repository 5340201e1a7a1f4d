"""Mixing by soft membership: document rates whose expected domain token totals meet target weights.

A softmax classifier, fitted on a bounded sample of labelled rows, gives every document posteriors over domains (the
label pairs quality and toxic), rounded to 1/GRID. With A r the expected token shares of the domains under rates r, G
their Gram matrix over tokens and b the target shares, rates r >= 0 minimise

    (A r - b)' G^-1 (A r - b) / 2  +  RIDGE / 2 * mean over tokens of (r - 1)^2

by accelerated projected gradient from r = 1; in this metric the step 1 / (1 + RIDGE) is safe whatever the shares. Every
step is one distributed pass that sums 2 K + 1 numbers; documents of equal posteriors are rated alike, so passes run
over the different posteriors with their tokens summed (as many as the grid has points, at most). A rate follows from the
steps' gradients alone, so no state is kept between passes and a lost task is simply run again. Steps end when every
domain's total is within TOLERANCE of its target, or when rates stand still: then the targets can't all be met with rates
in 0..most and the rates are the least-squares compromise. max_gap tells how far the farthest domain is from its target. What no document belongs to can't be mixed in: the weight of a
domain without labelled rows is shared out among the others.

Targets are weights of the domains in the mix, of any sum, and a budget: a number of tokens, or without one as many as
leave the domain `anchor` its own total.

Defined results: null text counts as empty (no tokens, rated by its posteriors); null doc_id passes through; repeated
rows are rated alike; of conflicting labels of one doc_id the least (quality, toxic) counts, of different texts under
one labelled doc_id the least; without labels, with one class only or without tokens every document keeps rate 1; no rows
give no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, unstash

#: Domains by (quality, toxic), and their target weights in the mix.
DOMAINS = ((0, 0), (0, 1), (1, 0), (1, 1))
WEIGHTS = (0.1, 0.005, 0.855, 0.04)
#: The domain whose own total sets the budget: clean documents of good quality.
ANCHOR = 2
LABELLED = 8000
DIM = 1 << 11
GRID = 100
STEPS = 120
TOLERANCE = 1e-3
STILL = 1e-4
RIDGE = 1e-4
#: Score of a domain without labelled rows: no document belongs to it, and its weight counts for nothing.
NEVER = -1e6
SLOT_CACHE = 1 << 18
_SLOTS: dict[str, int] = {}


def featurise(text: str) -> np.ndarray:
    """Hashed word presences (log counts) and a few shares, as float32."""
    out = np.zeros(DIM + 4, np.float32)
    words = text.lower().split()
    if words:
        different = set(words)
        if len(_SLOTS) > SLOT_CACHE:
            _SLOTS.clear()
        for w in different:
            if w not in _SLOTS:
                _SLOTS[w] = xxhash.xxh3_64_intdigest(w) & (DIM - 1)
        at = np.fromiter(map(_SLOTS.__getitem__, words), np.int64, len(words))
        counts = np.bincount(at, minlength=DIM).astype(np.float32)
        out[:DIM] = np.log1p(counts)
        norm = np.sqrt((out[:DIM] ** 2).sum())
        out[:DIM] *= 4 / max(norm, 1e-6)
        n = max(1, len(text))
        out[DIM] = 1
        out[DIM + 1] = 4 * sum(map(text.count, "#*$%&|<>!")) / n
        out[DIM + 2] = 4 * sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n
        out[DIM + 3] = 2 * len(different) / len(words)
    return out


def associations(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """How far each word slot's presence departs from independence of some class, in standard deviations (RMS 1 over slots)."""
    seen, n = x[:, :DIM] > 0, len(x)
    often, z = seen.sum(0), np.zeros(DIM)
    for k in range(classes):
        share = (y == k).mean()
        z = np.maximum(z, np.abs(seen[y == k].sum(0) - often * share) / np.sqrt(often * share * (1 - share) * (1 - often / n) + 0.25))
    return z / max(np.sqrt((z**2).mean()), 1e-9)


def fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, ridge: float = 1e-3) -> np.ndarray:
    """Softmax regression by accelerated gradient steps; rows of x are features, y class numbers. Word slots count by their
    association with the classes, so that a few telling words outweigh many common ones."""
    scale = np.ones(x.shape[1])
    scale[:DIM] = associations(x, y, classes)
    scale[:DIM] *= 4 / max(np.sqrt(((x[:, :DIM] * scale[:DIM]) ** 2).sum(1).mean()), 1e-9)
    x = (x * scale).astype(np.float32)
    w = v = np.zeros((x.shape[1], classes), np.float32)
    hot = np.eye(classes, dtype=np.float32)[y]
    lip = float((x**2).sum(1).mean() / 2 + ridge)
    for t in range(steps):
        p = posterior(x, v)
        new = v - (x.T @ (p - hot) / np.float32(len(x)) + np.float32(ridge) * v) / np.float32(lip)
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w * scale[:, None]


def posterior(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def gridded(p: np.ndarray, grid: int = GRID) -> np.ndarray:
    """Posteriors as whole numbers of 1/grid that sum to grid; the largest takes what rounding leaves."""
    out = np.rint(p * grid).astype(np.int32)
    out[np.arange(len(out)), out.argmax(1)] += grid - out.sum(1, dtype=np.int32)
    return out


def rates(p: np.ndarray, grads: np.ndarray, most: float = np.inf, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates within 0..most after the steps whose domain gradients are the rows of grads, the point of the next gradient,
    and the last move; rows of p are posteriors."""
    r = at = np.ones(len(p))
    move = np.zeros(len(p))
    for t, g in enumerate(grads):
        new = np.clip(at - (p @ g + ridge * (at - 1)) / (1 + ridge), 0.0, most)
        move, at, r = new - at, new + t / (t + 3) * (new - r), new
    return r, at, move


def train_domains(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, domains=DOMAINS) -> np.ndarray | None:
    """Weights fitted on at most labelled labelled rows, those with the smallest hash of doc_id."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = known.groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `labelled` rows
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("row")).select("row.text", "row.label.quality", "row.label.toxic")

    def run(batches):
        for batch in batches:
            x = [featurise(t or "") for t in batch.column(0).to_pylist()]
            at = [np.flatnonzero(v).astype(np.int32) for v in x]
            yield pa.RecordBatch.from_arrays([pa.array([i.tobytes() for i in at], pa.binary()), pa.array([v[i].tobytes() for v, i in zip(x, at)], pa.binary()), batch.column(1), batch.column(2)], names=["at", "x", "quality", "toxic"])

    got = one.mapInArrow(run, "at binary, x binary, quality int, toxic int").collect()
    known_rows = sorted((domains.index((r.quality, r.toxic)), bytes(r.at), bytes(r.x)) for r in got if (r.quality, r.toxic) in domains)  # sums in one order
    if len({y for y, *_ in known_rows}) < 2:
        return None
    x = np.zeros((len(known_rows), DIM + 4), np.float32)
    for row, (_, at, v) in zip(x, known_rows):
        row[np.frombuffer(at, np.int32)] = np.frombuffer(v, np.float32)
    w = fit(x, np.array([y for y, *_ in known_rows]), len(domains))
    w[DIM, [k for k in range(len(domains)) if k not in {y for y, *_ in known_rows}]] = NEVER  # by the constant feature
    return w


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray | None, k: int) -> DataFrame:
    """doc_id, row_key (hash of doc_id and text), tokens and posteriors in 1/GRID, in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(weights)  # (DIM + 4) * K numbers

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            w = shared.value
            if w is None:
                p = np.full((len(texts), k), 1 / k)
            else:
                p = np.vstack([np.zeros((0, k))] + [posterior(np.stack([featurise(t) for t in texts[a : a + 512]]).astype(np.float64), w) for a in range(0, len(texts), 512)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(list(gridded(p)), pa.list_(pa.int32()))], names=["doc_id", "row_key", "tokens", "posteriors"])

    return stash(rows.mapInArrow(run, "doc_id long, row_key long, tokens long, posteriors array<int>"), "mixing")


@dataclass
class Fit:
    """Gradients of all steps; target and reached token totals by domain; the largest relative gap between the two."""

    grads: np.ndarray
    target: np.ndarray
    reached: np.ndarray
    max_gap: float


def fit_rates(scored: DataFrame, weights=WEIGHTS, budget: float | None = None, anchor: int = ANCHOR, most: float = np.inf, steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    k = len(weights)
    cells = stash(scored.filter("tokens > 0").groupBy("posteriors").agg(F.sum("tokens").alias("tokens")), "mixing-cells")

    def summed(size: int, one) -> np.ndarray:
        """Sums over all cells of what one(tokens, posteriors) returns for a batch: size numbers."""

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                p = batch.column(0).flatten().to_numpy().reshape(-1, k) / GRID
                total += one(batch.column(1).to_numpy().astype(float), p)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

        names = [f"s{i}" for i in range(size)]
        got = cells.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n) for n in names)).first()  # a row a task
        return np.array([x or 0.0 for x in got])

    gram = summed(k * k, lambda t, p: ((p.T * t) @ p).ravel()).reshape(k, k)
    own = gram.sum(1)
    total = own.sum()
    live = own > 0
    share = np.where(live, weights, 0.0) / max(sum(w for w, on in zip(weights, live) if on), 1e-300)
    if budget is None:
        budget = own[anchor] / share[anchor] if share[anchor] else total
    target = np.minimum(share * budget, most * own) if np.isfinite(most) else share * budget  # what there is, at most
    grads, reached = np.zeros((0, k)), own
    inverse = np.linalg.pinv(gram / total, rcond=1e-9, hermitian=True) if total else gram
    gap = lambda: float(np.max(np.abs(reached - target)[live] / np.maximum(target, 1e-6 * total)[live], initial=0.0)) if total else 0.0
    for _ in range(steps if total else 0):

        def sums(t, p, grads=grads):
            r, at, move = rates(p, grads, most)
            return np.concatenate([(t * r) @ p, (t * at) @ p, [(t * move**2).sum()]])

        now = summed(2 * k + 1, sums)
        reached = now[:k]
        if gap() <= tolerance or len(grads) and (now[-1] / total) ** 0.5 < STILL:
            break
        grads = np.vstack([grads, (inverse @ ((now[k : 2 * k] - target) / total))[None]])
    else:
        if total:
            reached = summed(k, lambda t, p: (t * rates(p, grads, most)[0]) @ p)
    unstash(cells)
    return Fit(grads, target, reached, gap())


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, weights=WEIGHTS, domains=DOMAINS, budget: float | None = None, anchor: int = ANCHOR, most: float = np.inf) -> DataFrame:
    """One row per row of docs: doc_id, row_key (hash of doc_id and text), tokens, posteriors (in 1/GRID), rate, max_gap."""
    k = len(domains)
    w = train_domains(spark, docs, labels, domains=domains)
    scored = score(spark, docs, w, k)
    found = fit_rates(scored, weights, budget, anchor, most) if w is not None else Fit(np.zeros((0, k)), np.zeros(k), np.zeros(k), 0.0)
    grads = found.grads

    def rate(batches):
        for batch in batches:
            p = batch.column(3).flatten().to_numpy().reshape(-1, k) / GRID
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, grads, most)[0])], names=["doc_id", "row_key", "tokens", "posteriors", "rate"])

    return scored.mapInArrow(rate, "doc_id long, row_key long, tokens long, posteriors array<int>, rate double").withColumn("max_gap", F.lit(found.max_gap))


def copies(rate: Column, key: Column, seed: int = 11) -> Column:
    """floor(rate + u), u uniform in [0, 1) by hash: its mean is the rate."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30).cast("long")) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("long")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    best = F.array_position("posteriors", F.array_max("posteriors")) - 1
    return out.select("doc_id", "tokens", best.cast("int").alias("domain"), F.round("rate", 6).alias("rate"), copies(F.col("rate"), F.col("row_key")).alias("copies"), F.round("max_gap", 6).alias("max_gap"))
