"""Quote-aware lexing of delimited bytes: one row per record, fields as physical bytes, quotes kept.

A quote opens a field only at its start, a doubled quote is an escape, bytes behind a closing quote are accepted.
Spark's CSV reader does not reproduce these edges, so records come from a scan over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput

#: Candidate delimiters in order, and the limits of a scan.
CANDIDATES = (b",", b";", b"\t", b"|")
MAX_FIELDS, MAX_RECORD, MAX_DETECT_RECORDS, MAX_DETECT_BYTES = 4096, 8 << 20, 32, 1 << 20
_STOP = {d: re.compile(rb"[\r\n" + re.escape(d) + rb"]") for d in CANDIDATES}


class Malformed(BadInput):
    """A record that the dialect does not allow; kind tells why, width counts the broken record's fields so far."""

    def __init__(self, kind: str, width: int = 0):
        super().__init__(kind.replace("_", " "))
        self.kind, self.width = kind, width


def scan(data: bytes, delimiter: bytes = b",", max_fields: int = MAX_FIELDS, max_record: int = MAX_RECORD, one_newline: bool = False) -> Iterator[tuple[list[bytes], bytes]]:
    """(fields, newline) of every record; empty input has none, a final newline opens no further record. LF and CRLF may
    mix unless one_newline is set; a bare CR outside quotes is malformed."""
    stop = _STOP.get(delimiter) or re.compile(rb"[\r\n" + re.escape(delimiter) + rb"]")
    style, at, n = None, 0, len(data)
    while at < n:
        begin, fields = at, []
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else n]
        # most records hold no quote and are a line
        if b'"' not in line:
            crlf = end >= 0 and line.endswith(b"\r")
            body = line[:-1] if crlf else line
            fields = body.split(delimiter) if b"\r" not in body and len(body) <= max_record else []
            if 0 < len(fields) <= max_fields:
                newline = b"\r\n" if crlf else b"\n" if end >= 0 else b""
                if newline:
                    if one_newline and style not in (None, newline):
                        raise Malformed("mixed_newlines", len(fields))
                    style = newline
                at += len(line) + (end >= 0)
                yield fields, newline
                continue
            fields = []
        while True:
            start = at
            if data[at : at + 1] == b'"':
                at += 1
                while True:
                    at = data.find(b'"', at)
                    if at < 0:
                        raise Malformed("unterminated_quoted_field", len(fields) + 1)
                    if data[at + 1 : at + 2] != b'"':
                        break
                    at += 2
                at += 1
            found = stop.search(data, at)
            at = found.start() if found else n
            if at - begin > max_record:
                raise Malformed("record_too_long", len(fields) + 1)
            if len(fields) >= max_fields:
                raise Malformed("too_many_fields", len(fields) + 1)
            fields.append(data[start:at])
            if found and found.group() == delimiter:
                at += 1
                continue
            break
        newline = found.group() if found else b""
        if newline == b"\r":
            if data[at + 1 : at + 2] != b"\n":
                raise Malformed("bare_carriage_return", len(fields))
            newline = b"\r\n"
        at += len(newline)
        if newline:
            if one_newline and style not in (None, newline):
                raise Malformed("mixed_newlines", len(fields))
            style = newline
        yield fields, newline


class Framer:
    """Cuts bytes that come in pieces of any size into records, without lexing a byte twice; the dialect is scan's."""

    def __init__(self, delimiter: bytes = b",", max_record: int = MAX_RECORD):
        self._delimiter, self._max = delimiter, max_record
        self._marks = re.compile(rb"[\"\r\n" + re.escape(delimiter) + rb"]")
        self._held: list[bytes] = []
        self._size = 0
        self._fresh, self._quoted, self._closing, self._cr = True, False, False, False

    def _hold(self, piece: bytes) -> None:
        self._size += len(piece)
        if self._size > self._max + 2:
            raise Malformed("record_too_long")
        if piece:
            self._held.append(piece)

    def _ordinary(self) -> None:
        """Bytes other than marks have passed."""
        if self._cr:
            raise Malformed("bare_carriage_return")
        if self._closing:
            self._closing = self._quoted = False
        if not self._quoted:
            self._fresh = False

    def push(self, piece: bytes) -> list[bytes]:
        """The records, newline included, that end in this piece."""
        out, begin, after = [], 0, 0
        for m in self._marks.finditer(piece):
            mark, between = m.group(), m.start() > after
            after = m.end()
            if between:
                self._ordinary()
            if self._cr and mark != b"\n":
                raise Malformed("bare_carriage_return")
            if self._closing:
                self._closing = False
                if mark == b'"':
                    continue  # a doubled quote
                self._quoted = self._fresh = False
            if self._quoted:
                self._closing = mark == b'"'
            elif mark == b'"':
                self._quoted, self._fresh = self._fresh, False
            elif mark == self._delimiter:
                self._fresh = True
            elif mark == b"\r":
                self._cr = True
            else:
                self._hold(piece[begin:after])
                out.append(b"".join(self._held))
                self._held, self._size, begin = [], 0, after
                self._fresh, self._cr = True, False
        if after < len(piece):
            self._ordinary()
        self._hold(piece[begin:])
        return out

    def finish(self) -> bytes | None:
        """The last record, where the input doesn't end in a newline."""
        if self._quoted and not self._closing:
            raise Malformed("unterminated_quoted_field")
        if self._cr:
            raise Malformed("bare_carriage_return")
        return b"".join(self._held) or None


def frame(pieces: Iterator[bytes], delimiter: bytes = b",", max_record: int = MAX_RECORD) -> Iterator[bytes]:
    """Records of bytes that come in pieces, a piece in memory at a time."""
    framer = Framer(delimiter, max_record)
    for piece in pieces:
        yield from framer.push(piece)
    if (last := framer.finish()) is not None:
        yield last


def records(data: bytes, delimiter: bytes = b",", max_fields: int = MAX_FIELDS, max_record: int = MAX_RECORD) -> list[list[bytes]]:
    """Fields of every record."""
    return [fields for fields, _ in scan(data, delimiter, max_fields, max_record)]


def split_legacy(record: str) -> list[str]:
    """Comma only; a quote toggles anywhere, doubled quotes inside quotes are skipped."""
    out, start, quoted, at = [], 0, False, 0
    while at < len(record):
        c = record[at]
        if c == '"':
            if quoted and record[at + 1 : at + 2] == '"':
                at += 1
            else:
                quoted = not quoted
        elif c == "," and not quoted:
            out.append(record[start:at])
            start = at + 1
        at += 1
    if quoted:
        raise Malformed("unterminated_quoted_field")
    return [*out, record[start:]]


class _Shape:
    """Widths of the significant records that a candidate has given so far."""

    def __init__(self):
        self.widths, self.quoted, self.separators = {}, 0, 0

    def add(self, fields: list[bytes]) -> None:
        self.separators += len(fields) - 1
        self.quoted += sum(f[:1] == b'"' for f in fields)
        if fields != [b""]:
            self.widths[len(fields)] = self.widths.get(len(fields), 0) + 1

    def score(self):
        if not self.widths or not self.separators:
            return None
        count, width = max((c, w) for w, c in self.widths.items())
        return (len(self.widths) == 1, self.quoted, count, self.separators, width)

    def could_match(self, error: Malformed) -> bool:
        """Would the candidate fit but for the failure?"""
        if not self.separators + error.width - 1:
            return False
        known = set(self.widths)
        if error.kind in ("unterminated_quoted_field", "bare_carriage_return", "mixed_newlines"):
            return len(known | {error.width}) == 1
        return len(known) <= 1 and all(error.width <= w for w in known)


def score(data: bytes, delimiter: bytes):
    """(consistent, quoted fields, modal records, separators, modal width) or None."""
    shape = _Shape()
    for fields, _ in scan(data, delimiter):
        shape.add(fields)
    return shape.score()


def detect(data: bytes) -> tuple[str, bytes | None]:
    """('detected', delimiter), ('ambiguous', None) or ('undetected', None).

    A malformed candidate that would otherwise fit raises its failure, as does the first malformed one where no other
    candidate has records of one width.
    """
    scores, failure = {}, None
    for d in CANDIDATES:
        shape = _Shape()
        try:
            for fields, _ in scan(data, d):
                shape.add(fields)
        except Malformed as e:
            if shape.could_match(e):
                raise
            failure = failure or e
            continue
        if got := shape.score():
            scores[d] = got
    if failure and not any(s[0] for s in scores.values()):
        raise failure
    if not scores:
        return "undetected", None
    best = max(scores.values())
    winners = [d for d, s in scores.items() if s == best]
    return ("detected", winners[0]) if len(winners) == 1 else ("ambiguous", None)


def tied(data: bytes) -> list[bytes]:
    """The candidates that share the best score."""
    scores = {d: s for d in CANDIDATES if (s := score(data, d))}
    return [d for d, s in scores.items() if s == max(scores.values())]


def detect_growing(lines: Iterator[bytes], max_records: int = MAX_DETECT_RECORDS, max_bytes: int = MAX_DETECT_BYTES) -> tuple[str, bytes | None, bytes]:
    """Detects on a prefix that grows by one physical line: (outcome, delimiter, prefix); the last prefix that lexes decides.

    At the end of the input a last prefix that does not lex leaves only an earlier detection, else 'legacy' (comma).
    Where max_bytes cuts a line, earlier success decides, else the cut line itself, else the outcome is 'limited'.
    """
    prefix, last, broken, count = b"", None, False, 0
    for line in lines:
        if count >= max_records:
            return (*(last or ("limited", None)), prefix)
        if len(prefix) + len(line) > max_bytes:
            if last is None:
                try:
                    last = detect(line[: max_bytes - len(prefix)])
                except Malformed:
                    last = ("limited", None)
                if last[0] != "detected":
                    last = ("limited", None)
            return (*last, prefix)
        prefix += line
        count += 1
        try:
            last, broken = detect(prefix), False
        except Malformed:
            broken = True
    if last is None or (broken and last[0] != "detected"):
        return "legacy", b",", prefix
    return (*last, prefix)


def _lex(delimiter: bytes | None):
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d = delimiter
                if d is None:
                    d = detect_growing(iter(content[: 2 * MAX_DETECT_BYTES].splitlines(keepends=True)))[1] or b","
                out: list[list[bytes]] = []
                first = 0
                for fields, _ in scan(content, d):
                    out.append(fields)
                    if len(out) == 4096:
                        yield _records(name, first, out)
                        first, out = first + len(out), []
                if out:
                    yield _records(name, first, out)

    return run


def _records(name: str, first: int, rows: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.binary()))], names=["path", "record_no", "fields"])


def read_records(spark: SparkSession, path: str, delimiter: bytes | None = None) -> DataFrame:
    """(path, record_no, fields array<binary>) of every file under path; the dialect is detected where none is given.

    A quoted field may hold newlines, so a file is one task; files without quotes are better read by read_lines.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_lex(delimiter), "path string, record_no long, fields array<binary>")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, is_first) of the physical lines of one file, in splits of any number; trailing CRs are dropped, blank lines too."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    first = (F.col("block") == 0) & (F.col("id") == 0)
    return rows.select(F.regexp_replace("value", r"\r+$", "").alias("line"), first.alias("is_first")).filter(F.col("is_first") | (F.col("line") != ""))


def split_lines(lines: DataFrame) -> DataFrame:
    """lines(line) plus fields array<string> by the comma rule of physical lines; lines without a quote stay JVM-side."""

    def run(batches):
        for batch in batches:
            cut = [split_legacy(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.list_(pa.string()))], names=["fields"])

    quoted = F.contains("line", F.lit('"'))
    return lines.filter(~quoted).select(F.split("line", ",", -1).alias("fields")).unionByName(lines.filter(quoted).select("line").mapInArrow(run, "fields array<string>"))
