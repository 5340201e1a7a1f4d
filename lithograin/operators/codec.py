"""Byte codecs on Arrow batches: zstd frames, and the columnar payload with plain and dictionary columns."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the payload's first bytes.
MAGIC = b"DCSV01"


def compress(data: bytes, level: int = 3, threads: int = 0) -> bytes:
    return zstandard.ZstdCompressor(level=level, write_content_size=True, threads=threads).compress(data)


def decompress(data: bytes, limit: int) -> bytes:
    """One whole frame of at most limit bytes."""
    got = zstandard.ZstdDecompressor().decompressobj()
    out = got.decompress(data)
    if len(out) > limit:
        raise ValueError("the frame is larger than allowed")
    if not got.eof or got.unused_data:
        raise ValueError("the frame is cut short or followed by other data")
    return out


def id_width(distinct: int) -> int:
    return 1 if distinct <= 0xFF else 2 if distinct <= 0xFFFF else 4


def columnar_modes(rows: list[list[bytes]]) -> list[str]:
    """Per column the mode that its sizes favour."""
    modes = []
    for column in zip(*rows):
        distinct = set(column)
        plain = 1 + sum(4 + len(v) for v in column)
        coded = 6 + sum(4 + len(v) for v in distinct) + len(column) * id_width(len(distinct))
        modes.append("dictionary" if coded < int(plain * 0.95) else "plain")
    return modes


def write_payload(rows: list[list[bytes]], modes: list[str], delimiter: bytes = b",", newline: bytes = b"\n", final: bool = True) -> bytes:
    """rows of physical fields, header included; modes: plain or dictionary per column."""
    if any(len(r) != len(modes) for r in rows):
        raise ValueError("rows differ in width")
    out = [MAGIC, delimiter, bytes([2 if newline == b"\r\n" else 1, final]), struct.pack("<QI", len(rows), len(modes))]
    for i, mode in enumerate(modes):
        values = [r[i] for r in rows]
        if mode == "plain":
            out += [b"\0", *(piece for v in values for piece in (len(v).to_bytes(4, "little"), v))]
            continue
        codes = {v: k for k, v in enumerate(dict.fromkeys(values))}
        width = id_width(len(codes))
        out += [b"\1", bytes([width]), struct.pack("<I", len(codes)), *(struct.pack("<I", len(v)) + v for v in codes), np.fromiter(map(codes.__getitem__, values), f"<u{width}", len(values)).tobytes()]
    return b"".join(out)


def read_payload(data: bytes, limit: int) -> bytes:
    """The original text of a payload, at most limit bytes."""
    at = len(MAGIC)

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the payload is cut short")
        at += n
        return data[at - n : at]

    if data[:at] != MAGIC:
        raise ValueError("not a columnar payload")
    delimiter, newline, final = take(1), take(1)[0], take(1)[0]
    if newline not in (1, 2) or final not in (0, 1):
        raise ValueError("bad newline flags")
    n, width = struct.unpack("<QI", take(12))
    if n * max(1, width) > limit + n + 1:
        raise ValueError("more fields than the limit allows")
    columns = []
    for _ in range(width):
        kind = take(1)[0]
        if kind == 0:
            columns.append([take(struct.unpack("<I", take(4))[0]) for _ in range(n)])
        elif kind == 1:
            size = take(1)[0]
            entries = [take(struct.unpack("<I", take(4))[0]) for _ in range(struct.unpack("<I", take(4))[0])]
            if size != id_width(len(entries)):
                raise ValueError("bad id width")
            codes = np.frombuffer(take(size * n), f"<u{size}")
            if n and int(codes.max()) >= len(entries):
                raise ValueError("a code is outside its dictionary")
            columns.append([entries[c] for c in codes.tolist()])
        else:
            raise ValueError("unknown column mode")
    if at != len(data):
        raise ValueError("data behind the payload")
    end = b"\r\n" if newline == 2 else b"\n"
    text = end.join(delimiter.join(r) for r in zip(*columns)) + (end if final and n else b"")
    if len(text) > limit:
        raise ValueError("the text is larger than allowed")
    return text


def zstd_roundtrip(chunks: DataFrame, key: list[str], data: str = "data", level: int = 3) -> DataFrame:
    """(key..., size, comp_size, identical): compresses and restores every chunk on Arrow batches."""

    def run(batches):
        for batch in batches:
            sizes, same = [], []
            for value in batch.column(len(key)).to_pylist():
                packed = compress(value, level)
                sizes.append(len(packed))
                same.append(decompress(packed, len(value)) == value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array([len(v) for v in batch.column(len(key)).to_pylist()], pa.int64()), pa.array(sizes, pa.int64()), pa.array(same)], names=[*key, "size", "comp_size", "identical"])

    kinds = ", ".join(f"{k} {dict(chunks.dtypes)[k]}" for k in key)
    return chunks.select(*key, F.col(data).cast("binary")).mapInArrow(run, f"{kinds}, size long, comp_size long, identical boolean")


def columnar_roundtrip(texts: DataFrame, group: str, stripe_rows: int = 4096) -> DataFrame:
    """texts(group, field...): record-aligned stripes, each encoded with its own dictionaries, restored and compared."""
    names = [c for c in texts.columns if c != group]

    def run(batches):
        for batch in batches:
            table = batch.to_pydict()
            groups: dict = {}
            for i, g in enumerate(table[group]):
                groups.setdefault(g, []).append([table[c][i].encode() for c in names])
            out = []
            for g, rows in groups.items():
                for a in range(0, len(rows), stripe_rows):
                    part = rows[a : a + stripe_rows]
                    modes = columnar_modes(part)
                    payload = write_payload(part, modes)
                    text = b"\n".join(b",".join(r) for r in part) + b"\n"
                    out.append((g, len(part), len(payload), read_payload(payload, len(text)) == text))
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=[group, "rows", "payload_bytes", "identical"])

    return texts.mapInArrow(run, f"{group} {dict(texts.dtypes)[group]}, rows long, payload_bytes long, identical boolean")
