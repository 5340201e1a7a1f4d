"""Version-1 archives: a head, small metadata and one zstd frame of either the text or its columnar payload.

One frame is not splittable, so these archives are for small files and for exchange; chunked archives are the distributed
form. Raw archives stream in bounded memory, columnar ones hold one payload.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass
from typing import BinaryIO

import zstandard

from ..errors import MetadataError
from ..operators.codec import read_payload
from .archive import InvalidArchive

#: Fixed values of the format.
MAGIC, VERSION, FIXED = b"DPACK", 1, 16
FILE_TYPES = {"csv": 1, "txt": 2, "unknown": 255}
FILE_TYPE_TAGS = ("csv", "txt", "unknown")
PAYLOADS = ("raw_zstd", "csv_columnar_dictionary", "plain", "dictionary")
MAX_METADATA = 64 << 20
EXPANSION, ALLOWANCE = 16, 1 << 20
PIECE = 1 << 20


def file_type(path: str) -> str:
    ext = os.path.splitext(path)[1].lower()
    return "csv" if ext == ".csv" else "txt" if ext in (".txt", ".log") else "unknown"


@dataclass(frozen=True)
class Head:
    file_type: str
    original_size: int
    payload: str
    payload_offset: int


def head_bytes(kind: str, size: int, payload: str) -> bytes:
    """Head and metadata without analysis blocks or extensions."""
    meta = struct.pack("<HIQIBBQ", VERSION, FILE_TYPE_TAGS.index(kind), size, PAYLOADS.index(payload), 0, 0, 0)
    return MAGIC + struct.pack("<HBQ", VERSION, FILE_TYPES[kind], len(meta)) + meta


def version_of(prefix: bytes) -> int:
    """The version that the first seven bytes name."""
    if len(prefix) < 7 or prefix[:5] != MAGIC:
        raise InvalidArchive("header", "no archive")
    return struct.unpack("<H", prefix[5:7])[0]


#: The layout of the optional analysis blocks, field by field; u and f take 64 bits, w 32, s is a text, c a character,
#: e a variant number with its bound, [..] a list of records.
BLOCKS = (
    ("c", "e2", "b", "u", ["s", "u", "u", "u", "f", "e4"], ["s", "u", ["s"], ["w"]]),
    ("u", "u", ["s", "u"], "s"),
)


def _past_blocks(raw: bytes, at: int) -> int:
    """The offset behind the two optional analysis blocks; they describe the source and are only checked for form."""

    def number(n: int) -> int:
        nonlocal at
        if at + n > len(raw):
            raise InvalidArchive("metadata", "cut short")
        at += n
        return int.from_bytes(raw[at - n : at], "little")

    def text(n: int) -> None:
        nonlocal at
        if at + n > len(raw):
            raise InvalidArchive("metadata", "cut short")
        try:
            raw[at : at + n].decode()
        except UnicodeDecodeError as e:
            raise InvalidArchive("metadata", "text is not UTF-8") from e
        at += n

    def skip(fields) -> None:
        for f in fields:
            if isinstance(f, list):
                for _ in range(number(8)):
                    skip(f)
            elif f[0] == "e":
                if number(4) >= int(f[1:]):
                    raise InvalidArchive("metadata", "unknown variant")
            elif f == "b":
                if number(1) > 1:
                    raise InvalidArchive("metadata", "bad flag")
            elif f == "c":
                first = raw[at] if at < len(raw) else 0
                text(1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0))
            elif f == "s":
                text(number(8))
            else:
                number(4 if f == "w" else 8)

    for fields in BLOCKS:
        present = number(1)
        if present > 1:
            raise InvalidArchive("metadata", "bad flag")
        if present:
            skip(fields)
    return at


def _metadata(raw: bytes, kind: str) -> tuple[int, str]:
    def take(form: str):
        nonlocal at
        n = struct.calcsize(form)
        if at + n > len(raw):
            raise InvalidArchive("metadata", "cut short")
        at += n
        return struct.unpack(form, raw[at - n : at])

    at = 0
    version, tag, size, payload = take("<HIQI")
    if version != VERSION or tag >= len(FILE_TYPE_TAGS) or FILE_TYPE_TAGS[tag] != kind or payload >= len(PAYLOADS):
        raise InvalidArchive("metadata", "version, file type or payload kind")
    at = _past_blocks(raw, at)
    for _ in range(take("<Q")[0]):
        at += take("<Q")[0]
        if take("<B")[0]:
            raise InvalidArchive("metadata", "an extension is enabled")
    if at != len(raw):
        raise InvalidArchive("metadata", "data behind the metadata")
    return size, PAYLOADS[payload]


def read_head(f: BinaryIO, max_memory: int | None = None) -> Head:
    """Leaves f at the payload. Raises InvalidArchive with the failing stage."""
    fixed = f.read(FIXED)
    if version_of(fixed) != VERSION:
        raise InvalidArchive("header", "not version 1")
    if len(fixed) < FIXED:
        raise InvalidArchive("header", "cut short")
    code, length = struct.unpack("<BQ", fixed[7:])
    kind = next((k for k, v in FILE_TYPES.items() if v == code), None)
    if kind is None:
        raise InvalidArchive("header", f"file type {code}")
    if length > MAX_METADATA:
        raise InvalidArchive("metadata", "metadata is larger than allowed")
    if max_memory is not None and FIXED + length > max_memory:
        raise InvalidArchive("metadata_limit", "metadata needs more memory than allowed")
    raw = f.read(length)
    if len(raw) != length:
        raise InvalidArchive("metadata", "cut short")
    size, payload = _metadata(raw, kind)
    return Head(kind, size, payload, FIXED + length)


def write_raw(source: BinaryIO, target: BinaryIO, kind: str, size: int, level: int = 3, advance=lambda n: None) -> None:
    """One frame in bounded memory; the source must have exactly size bytes."""
    target.write(head_bytes(kind, size, "raw_zstd"))
    seen, packer = 0, zstandard.ZstdCompressor(level=level).compressobj(size=size)
    while piece := source.read(PIECE):
        seen += len(piece)
        if seen > size:
            break
        target.write(packer.compress(piece))
        advance(len(piece))
    if seen != size:
        raise MetadataError("the source changed while it was read")
    target.write(packer.flush())


def pack_payload(payload: bytes, kind: str, size: int, level: int = 3) -> bytes:
    """An archive of a columnar payload."""
    return head_bytes(kind, size, "csv_columnar_dictionary") + zstandard.ZstdCompressor(level=level).compress(payload)


def pack_raw(data: bytes, kind: str, level: int = 3) -> bytes:
    return head_bytes(kind, len(data), "raw_zstd") + zstandard.ZstdCompressor(level=level).compress(data)


def _pieces(f: BinaryIO, limit: int):
    """The bytes of exactly one frame, at most limit of them, with nothing behind it."""
    unpacker, seen = zstandard.ZstdDecompressor().decompressobj(), 0
    while not unpacker.eof:
        packed = f.read(PIECE // 8)
        if not packed:
            raise InvalidArchive("v1_payload", "the frame is cut short")
        try:
            got = unpacker.decompress(packed)
        except zstandard.ZstdError as e:
            raise InvalidArchive("v1_payload", str(e)) from e
        seen += len(got)
        if seen > limit:
            raise InvalidArchive("v1_length", "more bytes than declared")
        yield got
    if unpacker.unused_data or f.read(1):
        raise InvalidArchive("v1_payload", "data behind the frame")


def restore(f: BinaryIO, head: Head, max_memory: int | None = None):
    """Pieces of the original bytes; the length is proven when they end."""
    if head.payload == "csv_columnar_dictionary":
        limit = EXPANSION * head.original_size + ALLOWANCE
        if max_memory is not None and limit > max_memory:
            raise InvalidArchive("metadata_limit", "the payload needs more memory than allowed")
        payload = b"".join(_pieces(f, limit))
        try:
            text = read_payload(payload, head.original_size)
        except ValueError as e:
            raise InvalidArchive("v1_payload", str(e)) from e
        if len(text) != head.original_size:
            raise InvalidArchive("v1_length", "sizes differ")
        yield text
        return
    seen = 0
    for piece in _pieces(f, head.original_size):
        seen += len(piece)
        yield piece
    if seen != head.original_size:
        raise InvalidArchive("v1_length", "sizes differ")
