"""The engine over files: analyze, advise, compress, decompress, validate, compare; benchmark and tune are in trials.py.

Chunks are packed and proven in parallel by executors, which open the files by path: source and archive lie in a folder
that driver and executors share. The driver holds one chunk at a time; it keeps order and the digest of the whole.
Spark job tags (spark.addTag, spark.interruptTag) cancel a running verb; partial output is removed.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import statistics
import tempfile
import time
import uuid
import warnings
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BadInput, BadOption, MetadataError, OutputExists, UnreadableInput
from .operators import measure, profile, text
from .operators.chunks import level_of
from .operators.codec import columnar_modes, read_payload, write_payload
from .operators.codec import compress as frame_of
from .plans import policy
from .progress import Operation
from .sources import archive, archive_v1, bounded, delimited

SCHEMA_VERSION, CHUNK, LEVEL, MIB = 1, 1 << 20, 3, 1 << 20
NONE = Operation("none")
WIDTH = "row has other columns than the header"


def evidence(joined: str) -> list[dict]:
    """source:code[:column] items as report objects."""
    items = [item.split(":") for item in joined.split(",")]
    return [{"source": i[0], "code": i[1], "column_index": int(i[2]) if len(i) > 2 else None} for i in items]


@dataclass(frozen=True)
class Analysis:
    delimiter: bytes
    header: list[str]
    facts: DataFrame
    plan: DataFrame
    table: DataFrame
    diagnostics: DataFrame
    advice: DataFrame
    sampling: dict = field(default_factory=dict)
    limitations: list[str] = field(default_factory=list)

    def report(self, kind: str = "analysis") -> dict:
        """Facts, plan and diagnostics as one document (at most a row a column)."""

        def rows(df: DataFrame, *order: str) -> list[dict]:
            return [r.asDict() for r in df.orderBy(*order).collect()]

        out = {"schema_version": SCHEMA_VERSION, "report_type": kind, "sampling": self.sampling, "limitations": self.limitations}
        table = self.table.collect()
        columns = rows(self.plan.select("column_index", "column_name", "u", "repetition", "strategy", "reason", "reason_code", "encoded_bytes", "raw_bytes"), "column_index")
        columns = [{**r, "reason": policy.stored_reason(r["reason"])} for r in columns]
        dataset = {"delimiter": self.delimiter.decode(), "columns": rows(self.facts, "column_index")}
        planner = {"columns": columns, "table": table[0].asDict() if table else None}
        if kind == "advisor":
            return {**out, "policy": {"name": "planner_policy", "version": 1}, "analysis": {"dataset": dataset, "planner": planner}, "recommendations": [{**r, "evidence": evidence(r["evidence"])} for r in rows(self.advice, "ord")]}
        return {**out, "dataset": dataset, "planner": planner, "diagnostics": rows(self.diagnostics, "ord", "column_index")}


CELL = "column_index int, column_name string, value string"


def _cells(rows: DataFrame, header: list[str]) -> DataFrame:
    """rows(fields array<string>) -> (column_index, column_name, value); a row of another width fails the job."""
    width = F.size("fields")
    fits = F.when(width == len(header), F.col("fields")).otherwise(F.raise_error(F.concat(F.lit(f"{WIDTH}: "), width.cast("string"), F.lit(f", expected {len(header)}"))).cast("array<string>"))
    names = F.array(*(F.lit(h) for h in header))
    return rows.select(F.posexplode(fits).alias("column_index", "value")).select("column_index", names[F.col("column_index")].alias("column_name"), "value")


def _whole(spark: SparkSession, path: str, delimiter: bytes) -> DataFrame:
    """Every record behind the header. Physical lines are read in splits; only a file whose delimiter is not the comma and
    that holds a quote is one task, since its quoted fields may hold newlines."""
    lines = delimited.read_lines(spark, path)
    body = lines.filter("NOT is_first").select("line")
    if delimiter == b",":
        return delimited.split_lines(body)
    if lines.filter(F.contains("line", F.lit('"'))).isEmpty():
        return body.select(F.split("line", "\\" + delimiter.decode(), -1).alias("fields"))
    rows = delimited.read_records(spark, path, delimiter).filter("record_no > 0")
    return rows.select(F.transform("fields", lambda x: F.decode(x, "UTF-8")).alias("fields")).filter((F.size("fields") > 1) | (F.col("fields")[0] != ""))


def _no_columns(spark: SparkSession, dataset: str) -> DataFrame:
    """The table decision for a file that no column could be read of."""
    empty = spark.range(1).select(F.lit(dataset).alias("dataset"), *(F.lit(0).cast("double" if k == "memory_mb" else "long").alias(k) for k in policy.TABLE_AGGREGATES))
    return empty.select("*", F.lit(0.0).alias("savings_percent"), F.lit(policy.TABLE_CODES[1]).alias("code"), F.lit("raw_zstd").alias("mode"), F.lit("No column was read").alias("reason"))


def analyze(spark: SparkSession, path: str, delimiter: bytes | None = None, dataset: str | None = None, sample: bounded.Sample | None = None, limits: bounded.Limits = bounded.Limits(), scope: int | None = None, op: Operation = NONE) -> Analysis:
    """Facts per column, encoding per column, one storage decision, diagnostics and advice for a delimited file.

    Without a sample every record counts and sizes are exact; with one, the first records within it (and within the first
    scope bytes) are profiled and sizes scale by bytes.
    """
    dataset = dataset or os.path.basename(path)
    try:
        size = os.path.getsize(path)
    except OSError as e:
        raise UnreadableInput(str(e)) from e
    if not size:
        raise BadInput("file is empty")
    with op.phase("analyzing", size), op.jobs(spark):
        outcome = "given"
        if delimiter is None:
            outcome, delimiter = bounded.dialect(path, sample or bounded.Sample())
        if delimiter == b",":
            bounded.comma_gate(path, outcome == "undetected")
        seen = bounded.look(path, delimiter, sample or bounded.Sample(64, 1), limits, scope)
        header, limitations = seen.header, list(seen.limitations)
        if sample is None and header:
            seen.coverage.stop_reason, seen.coverage.bytes_read, seen.coverage.bytes_analyzed = "complete", size, size
            cells = _cells(_whole(spark, path, delimiter), header)
        else:
            cells = _cells(spark.createDataFrame([(r,) for r in seen.rows], "fields array<string>"), header) if header else spark.createDataFrame([], CELL)
        counted = profile.facts_of_cells(cells)
        try:
            got = counted.collect()  # a row a column, at most limits.columns
        except PySparkException as e:
            message = str(e)
            if WIDTH in message:
                raise BadInput(message[message.index(WIDTH) :].splitlines()[0]) from e
            if "unterminated quoted field" in message:
                raise BadInput("unterminated quoted field") from e
            raise
        facts = _every_column(spark, got, counted.schema, header).withColumn("dataset", F.lit(dataset))
        if sample is None:
            seen.coverage.records = max((r.observed_values for r in got), default=0)
        if seen.capacity is not None and sum(r.cardinality_value for r in got if r.cardinality_kind == "exact") > seen.capacity:
            limitations.append("CARDINALITY_MEMORY_LIMIT_REACHED")
    with op.phase("planning"):
        plan = policy.column_plan(facts, seen.coverage.byte_scale)
        table = policy.table_plan(plan) if header else _no_columns(spark, dataset)
        table = policy.with_limitation(table, limitations[0] if limitations else None)
        status = profile.name_status(spark.createDataFrame(list(enumerate(header)), "column_index int, column_name string")).withColumn("dataset", F.lit(dataset))
        limiting = ([f"SAMPLE_{seen.coverage.stop_reason.upper()}_REACHED"] if seen.coverage.stop_reason in ("byte_limit", "record_limit") else []) + limitations
        notes = [(dataset, None, code, 0) for code in limiting]
        notes = policy.diagnostics(plan, status).unionByName(spark.createDataFrame(notes, "dataset string, column_index int, code string, ord int"))
        sampling = seen.coverage.block(limitations)
    return Analysis(delimiter, header, facts, plan, table, notes, policy.advise(plan, table, sampling["completeness"] == "partial", tuple(limiting)), sampling, limitations)


def analyze_bytes(spark: SparkSession, name: str, data: bytes) -> dict:
    """Full-buffer statistics of bytes in hand, by the extension of name: columns of a comma file, lines and phrases of any
    other text. Bytes that are no UTF-8 are replaced."""
    kind, lines = archive_v1.file_type(name), data.decode(errors="replace")
    out = {"file_type": kind, "original_size": len(data), "csv": None, "txt": None}
    held = spark.createDataFrame([(lines,)], "text string")
    if kind != "csv":
        stats = text.line_stats(held).first().asDict()
        return {**out, "txt": {**stats, "phrases": [r.asDict() for r in text.top_phrases(held).collect()]}}
    delimiter, headers, newline = held.select(text.legacy_delimiter(F.col("text")), text.has_header(F.col("text")), text.newline_style(F.col("text"))).first()
    mark = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}[delimiter]
    rows = held.select(F.posexplode(text.lines(F.col("text"))).alias("row", "line")).filter("line <> ''").select("row", F.split("line", "\\" + mark, -1).alias("fields"))
    first = rows.orderBy("row").first()
    names = first.fields if first else []
    names = names if headers else [f"column_{i}" for i in range(1, len(names) + 1)]
    body = rows.filter(F.col("row") > first.row) if first and headers else rows
    cells = body.select(F.posexplode("fields").alias("column_index", "value")).filter(F.col("column_index") < len(names)) if names else spark.createDataFrame([], CELL)
    named = cells.withColumn("column_name", F.element_at(F.array(*map(F.lit, names)), F.col("column_index") + 1)) if names else cells
    columns = profile.legacy_stats(profile.value_counts(named)).orderBy("column_index").collect()  # a row a column
    return {**out, "csv": {"delimiter": delimiter, "has_header": headers, "newline": newline, "rows": body.count() if names else 0, "columns": [r.asDict() for r in columns]}}


def _every_column(spark: SparkSession, got: list, schema, header: list[str]) -> DataFrame:
    """Facts with an empty row for each column that no record gave a value."""
    have = {r.column_index for r in got}
    more = [(i, name, 0, 0, 0, None, None, 0.0, 0, "exact", 0) for i, name in enumerate(header) if i not in have]
    return spark.createDataFrame([*map(tuple, got), *more], schema)


def advise(spark: SparkSession, path: str, sample: bounded.Sample | None = None, op: Operation = NONE) -> dict:
    """Ordered recommendations with evidence; a source that cannot be profiled is still advised on."""
    try:
        return analyze(spark, path, sample=sample, op=op).report("advisor")
    except BadInput as e:
        why = evidence("analysis_status:STRUCTURED_ANALYSIS_UNAVAILABLE")
        advice = (("RAW_ZSTD_RECOMMENDED", policy.RAW_WITHOUT_ANALYSIS), ("FULL_COMPARISON_RECOMMENDED", policy.ADVICE["FULL_COMPARISON_RECOMMENDED"][1]))
        return {
            "schema_version": SCHEMA_VERSION, "report_type": "advisor", "policy": {"name": "planner_policy", "version": 1}, "analysis": None, "unavailable": str(e),
            "recommendations": [{"ord": i, "code": c, "category": policy.ADVICE[c][0], "message": m, "evidence": why} for i, (c, m) in enumerate(advice, 1)],
        }


@contextlib.contextmanager
def _output(path: str, overwrite: bool, *inputs: str, keep_partial: bool = False):
    """A sibling partial file that becomes path only when all went well."""
    for other in inputs:
        if os.path.realpath(other) == os.path.realpath(path):
            raise BadOption("the output is the input")
    if os.path.exists(path) and (not overwrite or not os.path.isfile(path)):
        raise OutputExists(path)
    part, backup = (f"{path}.{uuid.uuid4().hex}.{kind}" for kind in ("partial", "backup"))
    done = kept = False
    try:
        with open(part, "wb") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.replace(path, backup)
            kept = True
        os.replace(part, path)
        done = True
    finally:
        if kept and not done:
            os.replace(backup, path)
        if os.path.exists(part) and (done or not keep_partial):
            os.remove(part)
        if kept and done:
            try:
                os.remove(backup)
            except OSError as e:  # the output stands; what is left over is only reported
                warnings.warn(f"the previous output stays as {backup}: {e}", stacklevel=3)


def _checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lithograin-"))
    return df.checkpoint()


def _digest(path: str, advance=lambda n: None) -> tuple[int, bytes]:
    """Size and SHA-256 of a file, read in pieces."""
    seen, size = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while piece := f.read(4 * MIB):
            seen.update(piece)
            size += len(piece)
            advance(len(piece))
    return size, seen.digest()


#: Names of the packing backends: one thread a chunk, or the compressor's own threads within a chunk; both write the same format.
BACKENDS = ("chunked-raw-zstd", "zstd-mt-experimental")


def frames(spark: SparkSession, source: str, chunk: int, level: int | None, slots: int | None = None, inner: int = 0) -> DataFrame:
    """(chunk_id, size, level, sha256, frame, seconds) of a file, one chunk in memory per task; level None: by the chunk's
    bytes; inner: threads that the compressor takes within a chunk."""
    n = -(-os.path.getsize(source) // chunk)

    def run(batches):
        with open(source, "rb") as f:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    f.seek(i * chunk)
                    data = f.read(chunk)
                    how = level_of(data) if level is None else level
                    began = time.perf_counter()
                    frame = frame_of(data, how, inner)
                    out = [[i], [len(data)], [how], [hashlib.sha256(data).digest()], [frame], [time.perf_counter() - began]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64()))], names=["chunk_id", "size", "level", "sha256", "frame", "seconds"])

    slots = max(1, min(n, slots or 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, slots).mapInArrow(run, "chunk_id long, size long, level int, sha256 binary, frame binary, seconds double")


def compress(
    spark: SparkSession, source: str, target: str, chunk: int = CHUNK, level: int = LEVEL, overwrite: bool = False, adaptive: bool = False, threads: int | None = None,
    max_memory: int | None = None, keep_partial: bool = False, op: Operation = NONE, in_flight: int | None = None, backend: str = BACKENDS[0],
) -> dict:
    """Writes a chunked archive; the report gives sizes, digest, ratio, levels and times of the chunks. threads: partitions
    that pack at once (or, with the second backend, the compressor's threads within a chunk); in_flight: chunks that may be
    in memory at once, which bounds the partitions."""
    if not 1 <= chunk <= archive.MAX_CHUNK or not 1 <= level <= 22 or any(x is not None and x < 1 for x in (threads, in_flight)):
        raise BadOption("chunk size, level, threads or chunks in flight is out of range")
    if backend not in BACKENDS:
        raise BadOption(f"backend is one of {', '.join(BACKENDS)}")
    inner = threads or 0 if backend == BACKENDS[1] else 0
    slots = min((x for x in (None if inner else threads, in_flight) if x is not None), default=None)
    if max_memory is not None and (1 if slots is None else slots) * chunk > max_memory:
        raise BadOption("the chunks in memory need more than allowed")
    began = time.perf_counter()
    total, levels = os.path.getsize(source), {}
    with _output(target, overwrite, source, keep_partial=keep_partial) as f:
        with op.phase("compressing", total), op.jobs(spark):
            packed = _checkpointed(frames(spark, source, chunk, None if adaptive else level, slots, inner))
        with op.phase("hashing", total) as advance:
            seen, digest = _digest(source, advance)
        if seen != total:
            raise MetadataError("the source changed while it was read")
        count = -(-total // chunk)
        f.seek(archive.HEAD + archive.ENTRY * count)
        at, entries, times = f.tell(), [], []
        # range partitions keep chunk order, so no sort is needed
        with op.phase("writing_archive", total, count) as advance, op.jobs(spark):
            for row in packed.toLocalIterator():
                entries.append(archive.entry_bytes(archive.Entry(row.chunk_id, row.chunk_id * chunk, row.size, at, len(row.frame), row.level, bytes(row.sha256))))
                f.write(row.frame)
                at += len(row.frame)
                levels[row.level] = levels.get(row.level, 0) + 1
                times.append(row.seconds)
                advance(row.size)
        f.seek(0)
        f.write(archive.head_bytes(total, digest, count, chunk) + b"".join(entries))
        op.checkpoint()
    op.emit("finalizing", "completed", total, total)
    return {
        "schema_version": SCHEMA_VERSION, "report_type": "compression", "archive_version": 2, "selected_mode": "raw_zstd", "source_bytes": total, "archive_bytes": at, "chunks": count, "level": level,
        "levels": dict(sorted(levels.items())), "backend": backend, "chunk_seconds": {"average": sum(times) / len(times), "least": min(times), "most": max(times)} if times else None, "sha256": digest.hex(), "ratio": total / at, "seconds": time.perf_counter() - began, "diagnostics": [],
    }


def _columnar(data: bytes, delimiter: bytes, modes: list[str] | None) -> bytes | None:
    """The payload of a whole text, proven to restore it; None where the text does not allow one."""
    try:
        if delimited.detect(data) != ("detected", delimiter):
            return None
        rows = list(delimited.scan(data, delimiter, one_newline=True))
    except BadInput:
        return None
    fields = [r for r, _ in rows]
    if not fields or len({len(r) for r in fields}) != 1 or (modes is not None and len(modes) != len(fields[0])):
        return None
    payload = write_payload(fields, modes or columnar_modes(fields), delimiter, rows[0][1] or b"\n", bool(rows[-1][1]))
    return payload if read_payload(payload, len(data)) == data else None


def compress_v1(
    spark: SparkSession, source: str, target: str, mode: str = "fast", verify_best: bool = False, max_dictionary_values: int = policy.MAX_DICTIONARY, max_dictionary_mb: int = 64,
    sample: bounded.Sample | None = bounded.Sample(), overwrite: bool = False, keep_partial: bool = False, op: Operation = NONE,
) -> dict:
    """Writes a version-1 archive: columnar where the plan says so and the text allows it, else one raw frame.

    mode best (with savings under 15 %) and verify_best pack both ways and keep the smaller one. The columnar form holds
    the whole text on the driver: it is for small files.
    """
    if mode not in ("fast", "best"):
        raise BadOption("mode is fast or best")
    began, kind, total = time.perf_counter(), archive_v1.file_type(source), os.path.getsize(source)
    notes, modes, delimiter, chosen, savings = [], None, b",", "raw_zstd", 0.0
    try:
        seen = analyze(spark, source, sample=sample, op=op)
        delimiter, notes = seen.delimiter, list(seen.limitations)
        limited = policy.dictionary_limits(seen.plan, max_dictionary_values, max_dictionary_mb)
        plan = limited.orderBy("column_index").collect()  # a row a column
        notes += [f"{r.warning}:{r.column_index}" for r in plan if r.warning]
        modes = ["dictionary" if r.strategy == "dictionary" else "plain" for r in plan]
        table = seen.table.first()
        chosen, savings = table["mode"], table["savings_percent"]
        both = not seen.limitations and (verify_best or (mode == "best" and savings < 15.0))
    except BadInput:
        notes.append("STRUCTURED_ANALYSIS_UNAVAILABLE")
        both = False
    packed = saved = None
    if both or chosen == "csv_columnar_dictionary":
        with op.phase("reading_input", total), open(source, "rb") as f:
            data = f.read()
        with op.phase("compressing", total):
            payload = _columnar(data, delimiter, modes)
            if payload is None:
                notes.append("STRUCTURED_ENCODER_FALLBACK")
            else:
                packed = archive_v1.pack_payload(payload, kind, len(data))
                if both:
                    other = len(archive_v1.pack_raw(data, kind))
                    saved = abs(other - len(packed))
                    packed = None if other <= len(packed) else packed
    with _output(target, overwrite, source, keep_partial=keep_partial) as f:
        with op.phase("writing_archive", total) as advance:
            if packed is not None:
                f.write(packed)
            else:
                with open(source, "rb") as raw:
                    archive_v1.write_raw(raw, f, kind, total, advance=advance)
        size = f.tell()
        op.checkpoint()
    op.emit("finalizing", "completed", total, total)
    return {
        "schema_version": SCHEMA_VERSION, "report_type": "compression", "archive_version": 1, "selected_mode": "raw_zstd" if packed is None else "csv_columnar_dictionary", "source_bytes": total,
        "archive_bytes": size, "saved_against_other": saved, "ratio": total / size, "seconds": time.perf_counter() - began, "diagnostics": notes,
    }


def pack_raw_v1(source: str, target: str) -> float:
    """A version-1 archive of one raw frame, streamed; the seconds it took."""
    began = time.perf_counter()
    with _output(target, True, source) as f, open(source, "rb") as raw:
        archive_v1.write_raw(raw, f, archive_v1.file_type(source), os.path.getsize(source))
    return time.perf_counter() - began


@dataclass(frozen=True)
class ArchiveLimits:
    """Bounds that a reader sets on what an archive declares; None: no bound."""

    output_bytes: int | None = None
    chunks: int | None = None
    memory_bytes: int | None = None

    def check(self, total: int, chunks: int = 0, memory: int = 0) -> None:
        for value, bound, code in ((total, self.output_bytes, "DECLARED_OUTPUT_LIMIT_REACHED"), (chunks, self.chunks, "CHUNK_COUNT_LIMIT_REACHED"), (memory, self.memory_bytes, "VALIDATION_MEMORY_LIMIT_REACHED")):
            if bound is not None and value > bound:
                raise LimitReached(code)


class LimitReached(BadInput):
    code = "archive_limit"


def version(path: str) -> int:
    with open(path, "rb") as f:
        return archive_v1.version_of(f.read(7))


def _table(source: str, limits: ArchiveLimits):
    with open(source, "rb") as f:
        total, digest, target, entries = archive.read_table(f.read(archive.HEAD), f.read, os.path.getsize(source))
    limits.check(total, len(entries), archive.ENTRY * len(entries) + max((e.orig_size + e.comp_size for e in entries), default=0))
    return total, digest, entries


def _v1(source: str, f, limits: ArchiveLimits):
    """(declared size, pieces); pieces read f, which must stay open."""
    head = archive_v1.read_head(f, limits.memory_bytes)
    limits.check(head.original_size)
    return head, archive_v1.restore(f, head, limits.memory_bytes)


def decompress(spark: SparkSession, source: str, target: str, overwrite: bool = False, limits: ArchiveLimits = ArchiveLimits(), keep_partial: bool = False, op: Operation = NONE, verify: bool = True) -> dict:
    """Restores the file; chunks are decoded and proven by the archive reader, the whole by its digest (version 1: by its
    length). Without verify the whole's digest is neither made nor compared."""
    began, what = time.perf_counter(), version(source)
    seen, size, chunks = hashlib.sha256(), 0, 0
    with _output(target, overwrite, source, keep_partial=keep_partial) as f:
        if what == archive_v1.VERSION:
            with open(source, "rb") as packed:
                head, pieces = _v1(source, packed, limits)
                with op.phase("decompressing", head.original_size) as advance:
                    for piece in pieces:
                        f.write(piece)
                        if verify:
                            seen.update(piece)
                        size += len(piece)
                        advance(len(piece))
        else:
            total, digest, entries = _table(source, limits)
            chunks = len(entries)
            with op.phase("decompressing", total, chunks) as advance, op.jobs(spark):
                if entries:
                    spark.dataSource.register(archive.ArchiveSource)
                    for row in spark.read.format("lithograin-archive").load(source).toLocalIterator(prefetchPartitions=True):
                        f.write(row.data)
                        if verify:
                            seen.update(row.data)
                        size += len(row.data)
                        advance(len(row.data))
            if size != total:
                raise archive.InvalidArchive("restored_length", "sizes differ")
            if verify and seen.digest() != digest:
                raise archive.InvalidArchive("global_hash", "digests differ")
        op.checkpoint()
    op.emit("finalizing", "completed", size, size)
    return {"schema_version": SCHEMA_VERSION, "report_type": "decompression", "archive_version": what, "restored_bytes": size, "chunks": chunks, "sha256": seen.hexdigest() if verify else None, "seconds": time.perf_counter() - began}


def _first_bad_chunk(spark: SparkSession, source: str, entries: list) -> str | None:
    """The stage at which the first broken chunk fails; chunks are proven in parallel."""
    table = spark.createDataFrame([(e.chunk_id, e.orig_offset, e.orig_size, e.comp_offset, e.comp_size, e.level, e.sha256) for e in entries], "a long, b long, c long, d long, e long, f int, g binary")

    def run(batches):
        with open(source, "rb") as f:
            for batch in batches:
                bad = []
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    entry = archive.Entry(*row)
                    f.seek(entry.comp_offset)
                    try:
                        archive.unpack_chunk(entry, f.read(entry.comp_size))
                    except archive.InvalidArchive as e:
                        bad.append((entry.chunk_id, e.stage))
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in bad], pa.int64()), pa.array([b[1] for b in bad], pa.string())], names=["chunk_id", "stage"])

    worst = table.mapInArrow(run, "chunk_id long, stage string").agg(F.min_by("stage", "chunk_id").alias("stage")).first()
    return worst["stage"]


#: The failure code of each stage at which validation may stop.
FAILURES = {
    "header": "ARCHIVE_HEADER_INVALID", "metadata": "V2_HEADER_OR_CHUNK_TABLE_INVALID", "metadata_limit": "VALIDATION_MEMORY_LIMIT_REACHED", "chunk_table": "V2_HEADER_OR_CHUNK_TABLE_INVALID",
    "trailing_data": "V2_HEADER_OR_CHUNK_TABLE_INVALID", "v1_payload": "V1_PAYLOAD_INVALID", "v1_length": "RESTORED_LENGTH_MISMATCH", "v2_payload": "CHUNK_DECOMPRESSION_FAILED",
    "chunk_length": "RESTORED_LENGTH_MISMATCH", "chunk_hash": "CHUNK_HASH_MISMATCH", "restored_length": "RESTORED_LENGTH_MISMATCH", "global_hash": "GLOBAL_HASH_MISMATCH",
}
V1_MISSING = {"chunk_table": "not_applicable", "trailing_data": "not_available", "per_chunk_sha256": "not_available", "global_sha256": "not_available"}


def validate(spark: SparkSession, source: str, against: str | None = None, limits: ArchiveLimits = ArchiveLimits(), op: Operation = NONE) -> dict:
    """Nine checks, each passed, failed, not completed, not applicable or not available; writes nothing. against names the
    file it should restore."""
    stage, total, digest, entries, code, first = None, None, None, [], None, False
    seen, size = hashlib.sha256(), 0
    with op.phase("validating") as advance:
        try:
            what = version(source)
            first = what == archive_v1.VERSION
            if what not in (1, 2):
                raise archive.InvalidArchive("header", f"version {what}")
            if first:
                with open(source, "rb") as f:
                    head, pieces = _v1(source, f, limits)
                    total = head.original_size
                    for piece in pieces:
                        seen.update(piece)
                        size += len(piece)
                        advance(len(piece))
            else:
                total, digest, entries = _table(source, limits)
                with op.jobs(spark):
                    stage = _first_bad_chunk(spark, source, entries) if entries else None
                if stage is None:
                    with open(source, "rb") as f:
                        for e in entries:
                            f.seek(e.comp_offset)
                            seen.update(archive.unpack_chunk(e, f.read(e.comp_size)))
                            size += e.orig_size
                            advance(e.orig_size)
                    stage = None if seen.digest() == digest else "global_hash"
        except archive.InvalidArchive as e:
            stage = e.stage
        except LimitReached as e:
            stage, code = "limit", str(e)
    if stage == "limit":
        known = ("header", "metadata") if first else measure.CHECKS[:5]
        checks = {c: "passed" if c in known else "not_completed" for c in measure.CHECKS}
    else:
        checks = {c: "passed" if stage is None else measure.status_of(stage, c) for c in measure.CHECKS}
        code = None if stage is None else "V1_HEADER_OR_METADATA_INVALID" if first and stage in ("header", "metadata") else FAILURES[stage]
    if first:
        checks.update(V1_MISSING)
    same = None if against is None or stage else _digest(against) == (size, seen.digest())
    if same is False:
        code = "AGAINST_MISMATCH"
    op.emit("finalizing", "completed", size, size)
    return {
        "schema_version": SCHEMA_VERSION, "report_type": "validation", "valid": stage is None and same is not False, "archive": {"version": 1 if first else 2, "chunks": len(entries), "source_bytes": total},
        "checks": checks, "against": same, "diagnostics": [] if code is None else [code],
    }


def _standalone(source: str, packed: str, restored: str) -> tuple[float, float]:
    times = []
    for step, a, b in ((zstandard.ZstdCompressor(level=LEVEL).copy_stream, source, packed), (zstandard.ZstdDecompressor().copy_stream, packed, restored)):
        began = time.perf_counter()
        with open(a, "rb") as i, open(b, "wb") as o:
            step(i, o)
        times.append(time.perf_counter() - began)
    return times[0], times[1]


def prefix_of(source: str, folder: str, size: int | None) -> tuple[str, bool]:
    """source, or a copy of its first size bytes in folder; and whether it was cut."""
    if size is None or os.path.getsize(source) <= size:
        return source, False
    out = os.path.join(folder, f"{uuid.uuid4().hex}.prefix{os.path.splitext(source)[1]}")
    with open(source, "rb") as i, open(out, "wb") as o:
        left = size
        while left and (piece := i.read(min(left, 4 * MIB))):
            o.write(piece)
            left -= len(piece)
    return out, True


def snapshot(source: str, folder: str, size: int | None = None) -> tuple[str, bool]:
    """A copy in folder of the source as it is now (of its first size bytes), and whether it was cut. Raises where the source
    ends early or grows meanwhile, so that nothing is measured on bytes that change."""
    before = os.path.getsize(source)
    cut = size is not None and before > size
    out = os.path.join(folder, f"{uuid.uuid4().hex}.snapshot{os.path.splitext(source)[1]}")
    try:
        with open(source, "rb") as i, open(out, "wb") as o:
            left = size if cut else before
            while left and (piece := i.read(min(left, 4 * MIB))):
                o.write(piece)
                left -= len(piece)
            if left or not cut and i.read(1):
                raise MetadataError("the source changed while it was read")
    except BaseException:
        if os.path.exists(out):
            os.remove(out)
        raise
    return out, cut


def compare(spark: SparkSession, source: str, folder: str, runs: int = 3, chunk: int = CHUNK, max_input: int | None = None, mode: str = "quick", op: Operation = NONE) -> dict:
    """Archive against one standalone zstd stream: runs in alternating order on a snapshot of the source, medians, winners;
    folder, which driver and executors share, holds scratch files that are removed."""
    if not 1 <= runs <= 25 or mode not in ("quick", "full"):
        raise BadOption("runs are 1 to 25, mode is quick or full")
    took: dict = {"archive": [], "zstd": []}
    names = [os.path.join(folder, f"{uuid.uuid4().hex}.{k}") for k in ("archive", "zstd", "restored")]
    measured, cut = snapshot(source, folder, max_input if mode == "quick" else None)
    try:
        sizes, made, want = {}, {}, _digest(measured)
        with op.phase("comparing", want[0] * runs) as advance:
            for run in range(runs):
                for kind in ("archive", "zstd") if run % 2 == 0 else ("zstd", "archive"):
                    if kind == "archive":
                        times = (compress(spark, measured, names[0], chunk, overwrite=True)["seconds"], decompress(spark, names[0], names[2], overwrite=True)["seconds"])
                    else:
                        times = _standalone(measured, names[1], names[2])
                    if _digest(names[2]) != want:
                        raise archive.InvalidArchive("global_hash", f"{kind} did not restore the source")
                    artifact = _digest(names[0 if kind == "archive" else 1])
                    if made.setdefault(kind, artifact) != artifact:
                        raise archive.InvalidArchive("global_hash", f"{kind} differs between runs")
                    took[kind].append(times)
                    sizes[kind] = artifact[0]
                advance(want[0])
    finally:
        for name in [*names, measured]:
            if os.path.exists(name):
                os.remove(name)
    out = {k: {"bytes": sizes[k], "compress_seconds": statistics.median(t[0] for t in v), "decompress_seconds": statistics.median(t[1] for t in v)} for k, v in took.items()}
    for v in out.values():
        v["ratio"] = want[0] / v["bytes"] if v["bytes"] else 0.0
        v["compress_mib_s"] = want[0] / MIB / v["compress_seconds"] if want[0] and v["compress_seconds"] else None

    def best(metric: str) -> str:
        a, z = out["archive"][metric], out["zstd"][metric]
        return "tie" if a == z or not want[0] else "archive" if a < z else "zstd"

    limitations = (["QUICK_MODE_PARTIAL"] if mode == "quick" else []) + (["INPUT_PREFIX_LIMITED"] if cut else [])
    op.emit("finalizing", "completed", want[0], want[0])
    return {
        "schema_version": SCHEMA_VERSION, "report_type": "comparison", "mode": mode, "runs": runs, "scope": {"measured_bytes": want[0], "prefix": cut}, **out,
        "winners": {m: best(m) for m in ("bytes", "compress_seconds", "decompress_seconds")}, "limitations": limitations,
    }
