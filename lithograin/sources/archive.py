"""Chunked archives as a Python data source: one partition per chunk, transactional writes, every byte proven by SHA-256.

Layout: a 64-byte head (magic, version, mode, original size, SHA-256, chunk count, chunk target), an 80-byte entry per
chunk, then the zstd frames in order.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ArchiveParseError
from ..operators.codec import compress, decompress

#: Fixed values of the format.
MAGIC, VERSION, MODE, HEAD, ENTRY = b"DPACK", 2, 1, 64, 80
MAX_CHUNKS, MAX_CHUNK = 1_000_000, 4096 << 20


class InvalidArchive(ArchiveParseError):
    def __init__(self, stage: str, what: str):
        super().__init__(f"{stage}: {what}")
        self.stage = stage


@dataclass(frozen=True)
class Entry:
    chunk_id: int
    orig_offset: int
    orig_size: int
    comp_offset: int
    comp_size: int
    level: int
    sha256: bytes


def head_bytes(total: int, digest: bytes, count: int, target: int) -> bytes:
    head = MAGIC + struct.pack("<HB", VERSION, MODE)
    return head + struct.pack("<Q", total) + digest + struct.pack("<QQ", count, target)


def entry_bytes(e: Entry) -> bytes:
    return struct.pack("<QQQQQBi", e.chunk_id, e.orig_offset, e.orig_size, e.comp_offset, e.comp_size, MODE, e.level) + e.sha256 + b"\0\0\0"


def pack(data: bytes, target: int, level: int = 3) -> bytes:
    """A whole archive."""
    if not 1 <= target <= MAX_CHUNK:
        raise ValueError("chunk target")
    pieces = [data[a : a + target] for a in range(0, len(data), target)]
    frames = [compress(p, level) for p in pieces]
    at, table = HEAD + ENTRY * len(pieces), []
    for i, (piece, frame) in enumerate(zip(pieces, frames)):
        table.append(entry_bytes(Entry(i, i * target, len(piece), at, len(frame), level, hashlib.sha256(piece).digest())))
        at += len(frame)
    return head_bytes(len(data), hashlib.sha256(data).digest(), len(pieces), target) + b"".join(table) + b"".join(frames)


def read_table(head: bytes, rest, size: int) -> tuple[int, bytes, int, list[Entry]]:
    """(original size, SHA-256, target, entries); rest(n) reads n bytes of the table. Raises InvalidArchive."""
    if len(head) < HEAD or head[:5] != MAGIC:
        raise InvalidArchive("header", "no archive")
    version, mode = struct.unpack("<HB", head[5:8])
    if version != VERSION or mode != MODE:
        raise InvalidArchive("header", f"version {version}, mode {mode}")
    total, digest, count, target = struct.unpack("<Q", head[8:16])[0], head[16:48], *struct.unpack("<QQ", head[48:64])
    if not 1 <= target <= MAX_CHUNK or count > MAX_CHUNKS or count != -(-total // target):
        raise InvalidArchive("metadata", "chunk count or target")
    if total == 0 and digest != hashlib.sha256(b"").digest():
        raise InvalidArchive("metadata", "an empty archive must carry the digest of nothing")
    raw = rest(ENTRY * count)
    if len(raw) != ENTRY * count:
        raise InvalidArchive("chunk_table", "cut short")
    entries, source, payload = [], 0, HEAD + ENTRY * count
    for i in range(count):
        row = raw[i * ENTRY : (i + 1) * ENTRY]
        chunk, off, n, comp_off, comp_n, how, level = struct.unpack("<QQQQQBi", row[:45])
        if chunk != i or how != MODE or row[77:] != b"\0\0\0" or not 0 < n <= target or off != source or comp_off != payload or not comp_n or not 1 <= level <= 22:
            raise InvalidArchive("chunk_table", f"entry {i}")
        entries.append(Entry(chunk, off, n, comp_off, comp_n, level, row[45:77]))
        source, payload = source + n, payload + comp_n
    if source != total:
        raise InvalidArchive("chunk_table", "sizes do not add up")
    if payload > size:
        raise InvalidArchive("chunk_table", "payload is cut short")
    if payload != size:
        raise InvalidArchive("trailing_data", "data behind the payload")
    return total, digest, target, entries


def table_of(data: bytes):
    return read_table(data[:HEAD], lambda n: data[HEAD : HEAD + n], len(data))


def unpack_chunk(entry: Entry, frame: bytes) -> bytes:
    try:
        got = decompress(frame, entry.orig_size)
    except Exception as e:
        raise InvalidArchive("v2_payload", f"chunk {entry.chunk_id}: {e}") from e
    if len(got) != entry.orig_size:
        raise InvalidArchive("chunk_length", f"chunk {entry.chunk_id}")
    if hashlib.sha256(got).digest() != entry.sha256:
        raise InvalidArchive("chunk_hash", f"chunk {entry.chunk_id}")
    return got


def unpack(data: bytes) -> bytes:
    total, digest, _, entries = table_of(data)
    out = b"".join(unpack_chunk(e, data[e.comp_offset : e.comp_offset + e.comp_size]) for e in entries)
    if len(out) != total:
        raise InvalidArchive("restored_length", "sizes differ")
    if hashlib.sha256(out).digest() != digest:
        raise InvalidArchive("global_hash", "digests differ")
    return out


def write_file(path: str, data: bytes, overwrite: bool = False) -> None:
    """A sibling partial file, then a rename; nothing is left behind on failure."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    part = f"{path}.{uuid.uuid4().hex}.partial"
    try:
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


@dataclass
class ChunkPartition(InputPartition):
    path: str
    entry: Entry


class ArchiveSource(DataSource):
    """spark.read.format("lithograin-archive").load(path): (chunk_id, orig_offset, size, sha256, data)."""

    @classmethod
    def name(cls) -> str:
        return "lithograin-archive"

    def schema(self) -> str:
        return "chunk_id long, orig_offset long, size long, sha256 string, data binary"

    def reader(self, schema):
        return ArchiveReader(self.options["path"])


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with open(self.path, "rb") as f:
            entries = read_table(f.read(HEAD), f.read, os.path.getsize(self.path))[3]
        return [ChunkPartition(self.path, e) for e in entries]

    def read(self, partition):
        e = partition.entry
        with open(partition.path, "rb") as f:
            f.seek(e.comp_offset)
            data = unpack_chunk(e, f.read(e.comp_size))
        yield (e.chunk_id, e.orig_offset, len(data), e.sha256.hex(), data)
