"""Trials over files: benchmark one source against a standalone stream, and tune chunk size and parallelism.

Trials measure wall time, so they run one configuration after another from the driver; each configuration's work is
distributed. Scratch files live in one folder beside the report or source and are removed unless asked for.
"""

from __future__ import annotations

import csv
import datetime
import os
import shutil
import statistics
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import verbs
from .errors import BadOption, OutputExists
from .operators import measure
from .progress import Operation
from .sources import archive, bounded

MIB = 1 << 20
#: The columns of a tuning report.
COLUMNS = (
    "timestamp engine_version input_path input_size_bytes measured_input_size_bytes input_sampled max_input_mb backend archive_version mode chunk_size_mb chunk_size_bytes threads "
    "max_in_flight_chunks adaptive_level zstd_level_strategy runs run_index output_size_bytes compression_ratio compression_time_ms compression_mb_per_sec decompression_time_ms "
    "decompression_mb_per_sec total_time_ms sha256_match validation_status benchmark_scope peak_memory_estimate_mb temp_path_used notes error"
).split()


@dataclass(frozen=True)
class Options:
    """What a benchmark leaves out."""

    runs: int = 3
    no_baseline: bool = False
    no_roundtrip: bool = False
    no_hash: bool = False
    estimate_only: bool = False
    max_input_mb: int | None = None
    chunked: bool = False
    chunk: int = MIB
    threads: int | None = None
    adaptive: bool = False
    keep_temp: bool = False

    def __post_init__(self):
        if not 1 <= self.runs <= 25 or (self.max_input_mb is not None and self.max_input_mb < 1):
            raise BadOption("runs are 1 to 25, the input bound at least 1 MiB")


#: Above this size a benchmark of everything is announced as long.
LARGE_INPUT = 1 << 30


def large_input(size: int, o: Options) -> str | None:
    """A notice for a whole benchmark of a large source; it stops nothing."""
    if size > LARGE_INPUT and not (o.estimate_only or o.no_baseline or o.no_roundtrip or o.no_hash or o.max_input_mb is not None):
        return f"the input has {size} bytes: a whole benchmark packs, restores and hashes it several times"
    return None


class _Scratch:
    """A folder of its own, removed at the end."""

    def __init__(self, beside: str, keep: bool):
        self.path, self.keep = os.path.join(os.path.dirname(os.path.abspath(beside)), f".lithograin-{uuid.uuid4().hex}"), keep

    def __enter__(self) -> str:
        os.mkdir(self.path)
        return self.path

    def __exit__(self, *_):
        if not self.keep:
            shutil.rmtree(self.path, ignore_errors=True)


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def _status(spark: SparkSession, o: Options, cut: bool) -> dict:
    flags = {"no_baseline": o.no_baseline, "no_roundtrip": o.no_roundtrip, "no_hash": o.no_hash, "prefix_limited": cut, "estimate_only": o.estimate_only}
    row = measure.scope_status(spark.createDataFrame([tuple(flags.values())], ", ".join(f"{k} boolean" for k in flags))).first()
    return {"benchmark_scope": row.scope, "validation_status": row.validation_status, "partial_reasons": row.partial_reasons.split("|") if row.partial_reasons else []}


def _speed(size: int, seconds: float) -> float | None:
    return size / MIB / seconds if size and seconds else None


def benchmark(spark: SparkSession, source: str, options: Options = Options(), op: Operation = verbs.NONE) -> dict:
    """Plan, pack, restore and prove a source, with a standalone stream beside it; times are upper medians of the runs."""
    with _Scratch(source, options.keep_temp) as folder:
        measured, cut = verbs.prefix_of(source, folder, None if options.max_input_mb is None else options.max_input_mb * MIB)
        size = os.path.getsize(measured)
        out = {"schema_version": 1, "report_type": "benchmark", "source_bytes": os.path.getsize(source), "measured_bytes": size, "runs": options.runs, **_status(spark, options, cut)}
        out["notices"] = [notice] if (notice := large_input(out["source_bytes"], options)) else []
        planned, plan = "raw_zstd", None
        try:
            seen = verbs.analyze(spark, measured, sample=bounded.Sample(), op=op)
            plan = seen.table.first().asDict()
            planned = plan["mode"]
        except verbs.BadInput as e:
            out["analysis_unavailable"] = str(e)
        out["plan"] = plan
        if options.estimate_only:
            return out
        kinds = ["planned", "raw"] + (["chunked"] if options.chunked else []) + ([] if options.no_baseline else ["zstd"])
        times, sizes = {k: [] for k in kinds}, {}
        want = None if options.no_hash or options.no_roundtrip else verbs._digest(measured)
        with op.phase("benchmarking", size * options.runs) as advance:
            for _ in range(options.runs):
                for kind in kinds:
                    packed, back = (os.path.join(folder, f"{kind}.{x}") for x in ("packed", "restored"))
                    times[kind].append(_once(spark, kind, measured, packed, back, options))
                    if want is not None and verbs._digest(back) != want:
                        raise archive.InvalidArchive("global_hash", f"{kind} did not restore the source")
                    sizes[kind] = os.path.getsize(packed)
                advance(size)
        for k in kinds:
            pack, unpack = (upper_median([t[i] for t in times[k]]) for i in (0, 1))
            out[k] = {
                "bytes": sizes[k], "ratio": size / sizes[k] if sizes[k] else 0.0, "compress_seconds": pack, "decompress_seconds": None if options.no_roundtrip else unpack,
                "compress_mib_s": _speed(size, pack), "decompress_mib_s": None if options.no_roundtrip else _speed(size, unpack),
            }
        smaller = "csv_columnar_dictionary" if sizes["planned"] < sizes["raw"] else "raw_zstd"
        out["plan_was_correct"] = planned == smaller
    op.emit("finalizing", "completed", size, size)
    return out


def _once(spark: SparkSession, kind: str, source: str, packed: str, back: str, o: Options) -> tuple[float, float]:
    if kind == "zstd":
        return verbs._standalone(source, packed, back)
    if kind == "chunked":
        took = verbs.compress(spark, source, packed, o.chunk, overwrite=True, adaptive=o.adaptive, threads=o.threads)["seconds"]
    elif kind == "planned":
        took = verbs.compress_v1(spark, source, packed, overwrite=True)["seconds"]
    else:
        took = verbs.pack_raw_v1(source, packed)
    return took, 0.0 if o.no_roundtrip else verbs.decompress(spark, packed, back, overwrite=True)["seconds"]


def _free_name(source: str) -> str:
    base, n = f"{os.path.splitext(source)[0]}_tune", 0
    while os.path.exists(name := f"{base}{f'_{n}' if n else ''}.csv"):
        n += 1
    return name


def tune(
    spark: SparkSession, source: str, output: str | None = None, chunk_sizes_mb=(32, 64, 128, 256), threads=(1, 2, 4, 8), runs: int = 1, max_input_mb: int | None = None,
    skip_roundtrip: bool = False, no_hash: bool = False, adaptive: bool = False, keep_temp: bool = False, max_in_flight: int | None = None, force: bool = False, op: Operation = verbs.NONE,
) -> dict:
    """Packs with every chunk size and parallelism, writes one report row a run, and recommends by throughput, ratio and balance."""
    if runs < 1 or not chunk_sizes_mb or not threads or min(chunk_sizes_mb) < 1 or min(threads) < 1:
        raise BadOption("the grid needs sizes, threads and runs of at least 1")
    output = output or _free_name(source)
    if os.path.exists(output) and not force:
        raise OutputExists(output)
    total, rows = os.path.getsize(source), []
    with _Scratch(output, keep_temp) as folder:
        measured, cut = verbs.prefix_of(source, folder, None if max_input_mb is None else max_input_mb * MIB)
        size = os.path.getsize(measured)
        want = None if skip_roundtrip or no_hash else verbs._digest(measured)
        grid = [(c, t, r) for c in sorted(set(chunk_sizes_mb)) for t in sorted(set(threads)) for r in range(1, runs + 1)]
        scope = "sampled" if cut else "partial" if skip_roundtrip or no_hash else "full"
        status = "not_validated" if skip_roundtrip or no_hash else "partially_validated" if cut else "validated"
        with op.phase("benchmarking", size * len(grid), len(grid)) as advance:
            for c, t, r in grid:
                packed, back = os.path.join(folder, "packed"), os.path.join(folder, "restored")
                flight = max_in_flight or max(2 * t, 4)
                made = verbs.compress(spark, measured, packed, c * MIB, overwrite=True, adaptive=adaptive, threads=t)
                took = None if skip_roundtrip else verbs.decompress(spark, packed, back, overwrite=True)["seconds"]
                same = None if want is None else verbs._digest(back) == want
                rows.append({
                    "timestamp": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"), "engine_version": "", "input_path": source, "input_size_bytes": total, "measured_input_size_bytes": size,
                    "input_sampled": cut, "max_input_mb": max_input_mb, "backend": "chunked-raw-zstd", "archive_version": 2, "mode": "raw_zstd", "chunk_size_mb": c, "chunk_size_bytes": c * MIB, "threads": t,
                    "max_in_flight_chunks": flight, "adaptive_level": adaptive, "zstd_level_strategy": "adaptive" if adaptive else "fixed", "runs": runs, "run_index": r,
                    "output_size_bytes": made["archive_bytes"], "compression_ratio": made["ratio"], "compression_time_ms": 1000 * made["seconds"], "compression_mb_per_sec": size / MIB / max(made["seconds"], 1e-9),
                    "decompression_time_ms": None if took is None else 1000 * took, "decompression_mb_per_sec": None if took is None else size / MIB / max(took, 1e-9),
                    "total_time_ms": 1000 * (made["seconds"] + (took or 0)), "sha256_match": same, "validation_status": status, "benchmark_scope": scope,
                    "peak_memory_estimate_mb": c * (flight + min(t, flight)), "temp_path_used": folder, "notes": "", "error": "" if same is not False else "restored bytes differ",
                })
                advance(size)
    part = f"{output}.{uuid.uuid4().hex}.partial"
    try:
        with open(part, "w", newline="") as f:
            writer = csv.DictWriter(f, COLUMNS, lineterminator="\n")
            writer.writeheader()
            writer.writerows({k: str(v).lower() if isinstance(v, bool) else v for k, v in row.items()} for row in rows)
        os.replace(part, output)
    finally:
        if os.path.exists(part):
            os.remove(part)
    picks = {p.goal: {"chunk_size_mb": p.chunk_size // MIB, "threads": p.threads} for p in measure.recommendations(configurations(spark, rows)).collect()}
    op.emit("finalizing", "completed", size, size)
    return {"schema_version": 1, "report_type": "tune", "output": output, "rows": len(rows), "benchmark_scope": scope, "validation_status": status, "recommendations": picks}


def configurations(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Medians per configuration of a tuning report (bounded by the grid)."""
    by: dict = {}
    for r in rows:
        by.setdefault((r["chunk_size_bytes"], r["threads"]), []).append(r)

    def mid(group: list[dict], k: str) -> float:
        return float(statistics.median(r[k] for r in group))

    data = [(c, t, mid(g, "compression_mb_per_sec"), mid(g, "compression_ratio"), mid(g, "peak_memory_estimate_mb")) for (c, t), g in by.items()]
    return spark.createDataFrame(data, "chunk_size long, threads long, throughput double, ratio double, memory double").orderBy(F.col("chunk_size"), F.col("threads"))
