"""A bounded look at the start of a delimited file: header, records, and what was covered.

Comma files are read by physical lines, other delimiters by logical records whose quoted fields may hold newlines. The
sample ends at rows, bytes or a limit, whichever comes first; memory is bounded by the sample and the limits.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from ..errors import BadInput, BadOption, UnreadableInput
from .delimited import detect_growing, scan, split_legacy

MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Fixed defaults of the bounded analysis."""

    header_bytes: int = 1 << 20
    record_bytes: int = 8 << 20
    columns: int = 4096
    cardinality_entries: int = 262_144
    memory_bytes: int = 64 << 20
    column_bytes: int = 512
    entry_bytes: int = 32

    def capacity(self, header: int, columns: int) -> int | None:
        """Distinct values that may be held; None where the base alone needs more than the memory allowed."""
        left = self.memory_bytes - max(self.record_bytes, self.header_bytes) - 2 * header - columns * self.column_bytes
        return None if left < 0 else min(self.cardinality_entries, left // self.entry_bytes)


@dataclass(frozen=True)
class Sample:
    max_mb: int = 64
    max_rows: int = 10_000

    def __post_init__(self):
        if not 1 <= self.max_mb <= 2048 or self.max_rows < 1:
            raise BadOption("a sample has 1 to 2048 MiB and at least one row")


@dataclass
class Coverage:
    source_bytes: int
    scope_bytes: int
    max_bytes: int
    bytes_read: int = 0
    bytes_analyzed: int = 0
    records: int = 0
    stop_reason: str = "byte_limit"
    final_newline: bool | None = None

    def block(self, limitations: list[str]) -> dict:
        """The sampling part of a report."""
        named = {"byte_limit", "record_limit", "header_byte_limit", "record_byte_limit"}
        if self.stop_reason == "complete":
            scope, limit = "full", limitations[0].lower() if limitations else None
        elif self.stop_reason in named:
            scope, limit = "sampled", self.stop_reason
        else:
            scope, limit = "full" if self.bytes_analyzed >= self.source_bytes else "sampled", self.stop_reason
        whole = self.stop_reason == "complete" and not limitations
        return {
            "scope": scope, "completeness": "complete" if whole else "partial", "limited": not whole, "limit_reached": limit, "source_bytes": self.source_bytes,
            "scope_bytes": self.scope_bytes, "bytes_read": self.bytes_read, "bytes_analyzed": self.bytes_analyzed, "records": self.records, "final_newline": self.final_newline,
        }

    @property
    def byte_scale(self) -> float:
        return self.scope_bytes / self.bytes_read if self.bytes_read else 1.0


@dataclass
class Look:
    """What a bounded scan saw."""

    delimiter: bytes
    coverage: Coverage
    header: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    columns: int | None = None
    capacity: int | None = None
    limitations: list[str] = field(default_factory=list)


def physical(f: BinaryIO, left: int, cap: int) -> tuple[bytes, str]:
    """The next line and 'complete', 'end', 'sample' or 'record'; where both bounds are hit at once the record bound names it."""
    bound = min(left, cap)
    line = f.readline(bound + 1)
    if len(line) > bound:
        return line[:bound], "record" if cap <= left else "sample"
    return line, "complete" if line else "end"


def logical(f: BinaryIO, left: int, cap: int, delimiter: bytes) -> tuple[bytes, str]:
    """As physical, but a record goes on while a quoted field is open."""
    out, quoted, at = b"", False, 0
    while True:
        line, state = physical(f, left - len(out), cap - len(out))
        if state == "end":
            if quoted:
                raise BadInput("unterminated quoted field")
            return out, "complete" if out else "end"
        out += line
        quoted, at = _quote_state(out, at, quoted, delimiter)
        if state != "complete" or not quoted:
            return out, state


def _quote_state(data: bytes, at: int, quoted: bool, delimiter: bytes) -> tuple[bool, int]:
    """Is a quoted field open behind data, given the state at at?"""
    start = not quoted
    while at < len(data):
        if quoted:
            at = data.find(b'"', at)
            if at < 0:
                return True, len(data)
            if data[at + 1 : at + 2] == b'"':
                at += 2
                continue
            quoted, start, at = False, False, at + 1
            continue
        c = data[at : at + 1]
        if c == b'"' and start:
            quoted, start, at = True, False, at + 1
            continue
        nxt = min((x for x in (data.find(delimiter, at), data.find(b"\n", at)) if x >= 0), default=-1)
        if nxt < 0:
            return False, len(data)
        at, start = nxt + 1, True
    return quoted, at


def lines_of(path: str, limit: int = 1 << 20) -> Iterator[bytes]:
    """Physical lines; a line longer than limit comes as its first limit + 1 bytes, which no detector takes."""
    with open(path, "rb") as f:
        while line := f.readline(limit + 1):
            yield line


def dialect(path: str, sample: Sample = Sample()) -> tuple[str, bytes]:
    """(outcome, delimiter) of a file; raises BadInput where no delimiter may be taken."""
    outcome, delimiter, _ = detect_growing(lines_of(path), max_bytes=min(sample.max_mb * MIB, 1 << 20))
    if outcome == "ambiguous":
        raise BadInput("ambiguous delimiter")
    if outcome == "limited":
        raise BadInput("delimiter detection could not complete within its limits")
    return outcome, delimiter or b","


def comma_gate(path: str, undetected: bool) -> None:
    """The first 4 KiB of a comma file: not empty, no NUL, UTF-8, with a comma."""
    with open(path, "rb") as f:
        head = f.read(4096)
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
        fine = bool(head) and b"\0" not in head and b"," in head
    except UnicodeDecodeError:
        fine = False
    if not fine:
        raise BadInput("no supported delimiter was detected" if undetected else "file is not valid CSV within first 4 KB")


def _text(record: bytes) -> str:
    try:
        return record.decode()
    except UnicodeDecodeError as e:
        raise BadInput("record is not valid UTF-8") from e


def _name(raw: str) -> str:
    return raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] == '"' else raw


def look(path: str, delimiter: bytes, sample: Sample = Sample(), limits: Limits = Limits(), scope: int | None = None) -> Look:
    """Header and the first records within the sample."""
    try:
        source = os.path.getsize(path)
        f = open(path, "rb")
    except OSError as e:
        raise UnreadableInput(str(e)) from e
    scope = min(source, source if scope is None else scope)
    budget = min(sample.max_mb * MIB, scope)
    seen = Look(delimiter, Coverage(source, scope, sample.max_mb * MIB))
    cover, comma = seen.coverage, delimiter == b","

    def take(cap: int) -> tuple[bytes, str]:
        left = budget - cover.bytes_read
        got, state = physical(f, left, cap) if comma else logical(f, left, cap, delimiter)
        cover.bytes_read += len(got)
        return got, state

    def stop(reason: str, limitation: str | None = None) -> Look:
        cover.stop_reason = reason
        if limitation:
            seen.limitations.append(limitation)
        return seen

    def cut(record: bytes) -> list[str]:
        if comma:
            return split_legacy(_text(record.rstrip(b"\n").rstrip(b"\r")))
        rows = [r for r, _ in scan(record, delimiter, limits.columns + 1)]
        return [_text(v) for v in rows[0]]

    with f:
        head, state = take(limits.header_bytes)
        if state == "end":
            raise BadInput("empty file")
        if state == "sample":
            return stop("byte_limit", "INCOMPLETE_HEADER_SAMPLE")
        if state == "record":
            return stop("header_byte_limit", "HEADER_BYTE_LIMIT_REACHED")
        names = cut(head)
        seen.columns = len(names)
        cover.bytes_analyzed = cover.bytes_read
        newline = head.endswith((b"\n", b"\r"))
        if len(names) < 2:
            raise BadInput("expected at least two CSV columns")
        if len(names) > limits.columns:
            return stop("column_limit", "COLUMN_LIMIT_REACHED")
        seen.capacity = limits.capacity(len(head), len(names))
        if seen.capacity is None:
            return stop("memory_limit", "ANALYSIS_MEMORY_LIMIT_REACHED")
        seen.header = [_name(n) for n in names]
        hard = None
        while cover.records < sample.max_rows and cover.bytes_read < budget:
            record, state = take(limits.record_bytes)
            if state in ("end", "sample"):
                break
            if state == "record":
                hard = "record_byte_limit"
                seen.limitations.append("RECORD_BYTE_LIMIT_REACHED")
                break
            cover.bytes_analyzed, newline = cover.bytes_read, record.endswith((b"\n", b"\r"))
            if not (record.rstrip(b"\n").rstrip(b"\r") if comma else record.removesuffix(b"\n").removesuffix(b"\r")):
                continue
            fields = cut(record)
            if len(fields) != len(names):
                raise BadInput(f"row has {len(fields)} columns, expected {len(names)}")
            cover.records += 1
            seen.rows.append(fields)
    whole = cover.bytes_analyzed >= source
    cover.final_newline = newline if whole else None
    return stop(hard or ("complete" if whole else "record_limit" if cover.records >= sample.max_rows else "byte_limit"))


def safety(path: str, delimiter: bytes, size: int = 1 << 20) -> str:
    """'simple', 'requires_rfc4180' or 'unsupported' by the file's first MiB, cut at its last newline."""
    with open(path, "rb") as f:
        head = f.read(size + 1)
    if len(head) > size:
        head = head[: head.rfind(b"\n", 0, size) + 1] or head[:size]
    try:
        widths = {len(r) for r, _ in scan(head, delimiter)}
    except BadInput:
        return "unsupported"
    if len(widths) != 1:
        return "unsupported"
    return "requires_rfc4180" if b'"' in head else "simple"
