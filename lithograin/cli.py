"""Command line: python -m lithograin <command>. Reports go to stdout, progress and failures to stderr."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import trials, verbs
from .errors import BadProfile, OutputExists, RowsOutOfRange, describe
from .progress import Event, Operation
from .sources import synthetic
from .sources.bounded import Sample

MIB = 1 << 20


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lithograin", description="Profiles, plans and packs flat structured data on Spark.")
    top.add_argument("--master", help="Spark master; the session's own where unset")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *files: str, flags: str = "", **numbers):
        p = sub.add_parser(name)
        for f in files:
            p.add_argument(f)
        for f in flags.split():
            p.add_argument(f"--{f}", action="store_true")
        for n, default in numbers.items():
            p.add_argument(f"--{n.replace('_', '-')}", type=int, default=default)
        return p

    command("analyze", "input", flags="plan json pretty", sample_mb=64)
    p = command("compress", "input", "output", flags="verify-best chunked adaptive-level profile force keep-temp", sample_mb=64, max_dictionary_values=65_535, max_dictionary_mb=64, chunk_size_mb=None, threads=None, max_in_flight_chunks=None, max_memory_mb=None)
    p.add_argument("--mode", choices=("fast", "best"), default="fast")
    p.add_argument("--backend", choices=verbs.BACKENDS)
    command("decompress", "input", "output", flags="profile force keep-temp no-verify", max_output_mb=None, max_chunks=None, max_memory_mb=None)
    p = command("validate", "archive", flags="json pretty", max_output_mb=None, max_chunks=None, max_memory_mb=512)
    p.add_argument("--against")
    p = command("compare", "input", flags="json pretty", runs=3, max_input_mb=None)
    p.add_argument("--mode", choices=("quick", "full"), default="quick")
    command("advisor", "input", flags="json pretty", sample_mb=64)
    p = command("generate-test-data", "profile", "output", flags="force", seed=None)
    p.add_argument("--rows", default="10000")
    p = command("tune", "input", flags="skip-roundtrip no-hash adaptive-level keep-temp profile force", runs=1, max_input_mb=None, max_in_flight_chunks=None)
    p.add_argument("--output")
    p.add_argument("--chunk-sizes-mb", default="32,64,128,256")
    p.add_argument("--threads-list", default="1,2,4,8,max")
    command("benchmark", "input", flags="json keep-temp quick profile chunked adaptive-level no-zstd-baseline no-roundtrip no-hash estimate-only", runs=3, chunk_size_mb=None, threads=None, max_input_mb=None)
    return top


def text_of(report: dict, depth: int = 0) -> str:
    """A report as indented lines; a list of records becomes a table with columns of fixed width."""
    out, pad = [], "  " * depth
    for k, v in report.items():
        if isinstance(v, dict):
            out += [f"{pad}{k}:", text_of(v, depth + 1)]
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            names = list(dict.fromkeys(name for row in v for name in row))
            cells = [names] + [[_shown(row.get(name)) for name in names] for row in v]
            wide = [max(len(row[i]) for row in cells) for i in range(len(names))]
            out.append(f"{pad}{k}:")
            out += [f"{pad}  " + "  ".join(c.ljust(w) for c, w in zip(row, wide)).rstrip() for row in cells]
        else:
            out.append(f"{pad}{k}: {_shown(v)}")
    return "\n".join(x for x in out if x)


def _shown(value) -> str:
    """Control characters never reach the terminal; long values are cut."""
    text = f"{value:.4f}" if isinstance(value, float) else str(value)
    text = "".join(c if c.isprintable() else "�" for c in text)
    return text if len(text) <= 120 else text[:117] + "..."


def _sizes(text: str, top: int) -> list[int]:
    return [top if x.strip() == "max" else int(x) for x in text.split(",") if x.strip()]


def _mib(value: int | None) -> int | None:
    return None if value is None else value * MIB


def _generate(spark: SparkSession, a) -> dict:
    profile = a.profile.replace("-", "_")
    if profile not in synthetic.SEEDS:
        raise BadProfile(a.profile)
    if not a.rows.lstrip("-").isdigit() or not 1 <= int(a.rows) <= synthetic.MAX_ROWS:
        raise RowsOutOfRange(a.rows)
    if os.path.exists(a.output) and not a.force:
        raise OutputExists(a.output)
    rows = synthetic.csv_lines(synthetic.generate(spark, profile, int(a.rows), a.seed)).orderBy("row_index").select("line")
    with verbs._output(a.output, a.force) as f:
        for row in rows.toLocalIterator():
            f.write(row.line.encode() + b"\r\n")
        size = f.tell()
    return {"report_type": "generation", "profile": a.profile, "rows": int(a.rows), "bytes": size}


def run(spark: SparkSession, a, op: Operation) -> dict:
    limits = verbs.ArchiveLimits(_mib(a.max_output_mb), a.max_chunks, _mib(a.max_memory_mb)) if a.command in ("decompress", "validate") else None
    if a.command == "analyze":
        report = verbs.analyze(spark, a.input, sample=Sample(a.sample_mb), op=op).report()
        if not a.plan and not a.json:  # the text report gives the plan of single columns on demand
            report["planner"] = {"table": report["planner"]["table"]}
        return report
    if a.command == "advisor":
        return verbs.advise(spark, a.input, Sample(a.sample_mb), op)
    if a.command == "compress":
        if a.chunked or a.backend or a.adaptive_level or any(x is not None for x in (a.chunk_size_mb, a.threads, a.max_in_flight_chunks)):
            chunk = 64 * MIB if a.chunk_size_mb is None else _mib(a.chunk_size_mb)
            return verbs.compress(
                spark, a.input, a.output, chunk, overwrite=a.force, adaptive=a.adaptive_level, threads=a.threads, max_memory=_mib(a.max_memory_mb), keep_partial=a.keep_temp, op=op,
                in_flight=a.max_in_flight_chunks, backend=a.backend or verbs.BACKENDS[0],
            )
        return verbs.compress_v1(spark, a.input, a.output, a.mode, a.verify_best, a.max_dictionary_values, a.max_dictionary_mb, Sample(a.sample_mb), a.force, a.keep_temp, op)
    if a.command == "decompress":
        return verbs.decompress(spark, a.input, a.output, a.force, limits, a.keep_temp, op, not a.no_verify)
    if a.command == "validate":
        return verbs.validate(spark, a.archive, a.against, limits, op)
    if a.command == "compare":
        return verbs.compare(spark, a.input, os.path.dirname(os.path.abspath(a.input)), a.runs, max_input=_mib(a.max_input_mb), mode=a.mode, op=op)
    if a.command == "generate-test-data":
        return _generate(spark, a)
    if a.command == "tune":
        top = spark.sparkContext.defaultParallelism
        return trials.tune(
            spark, a.input, a.output, _sizes(a.chunk_sizes_mb, top), _sizes(a.threads_list, top), a.runs, a.max_input_mb, a.skip_roundtrip, a.no_hash, a.adaptive_level, a.keep_temp,
            a.max_in_flight_chunks, a.force, op,
        )
    options = trials.Options(
        1 if a.quick else a.runs, a.no_zstd_baseline, a.no_roundtrip, a.no_hash, a.estimate_only, a.max_input_mb, a.chunked, _mib(a.chunk_size_mb) or MIB, a.threads, a.adaptive_level, a.keep_temp
    )
    return trials.benchmark(spark, a.input, options, op)


def _to_stderr(event: Event) -> None:
    share = "" if event.percentage is None else f" {event.percentage:.0f} %"
    print(f"{event.operation} {event.phase} {event.state}{share}", file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("lithograin")
        spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    op = Operation(a.command, _to_stderr if getattr(a, "profile", False) is True else None)
    try:
        report = run(spark, a, op)
    except Exception as e:
        code, category, status = describe(e)
        print(json.dumps({"error": code, "category": category, "message": str(e)}), file=sys.stderr)
        return status
    for notice in report.get("notices", ()):
        print(notice, file=sys.stderr)
    if getattr(a, "json", False):
        print(json.dumps(report, default=str, indent=2 if getattr(a, "pretty", False) else None))
    else:
        print(text_of(report))
    return 0 if report.get("valid", True) else 1
