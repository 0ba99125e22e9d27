"""Framed chunks: a 16-byte header, little-endian, and a zstd body; the header has the body's checksum."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the wire format: magic, version, flag of a zstd body; then body size, raw size, xxHash32 of the body.
MAGIC, VERSION, ZSTD = 0x4C46, 1, 1
HEADER = struct.Struct("<HBBIII")


class ChunkError(ValueError):
    """Bytes that are no sound chunk."""


def pack(raw: bytes, level: int = 3) -> bytes:
    import zstandard
    from xxhash import xxh32_intdigest

    body = zstandard.ZstdCompressor(level=level).compress(raw)
    if max(len(raw), len(body)) >= 1 << 32:
        raise ChunkError("a chunk's sizes have 32 bits")
    return HEADER.pack(MAGIC, VERSION, ZSTD, len(body), len(raw), xxh32_intdigest(body)) + body


def unpack(data: bytes) -> Iterator[bytes]:
    """The raw bytes of each of the chunks that follow one another in data."""
    import zstandard
    from xxhash import xxh32_intdigest

    at = 0
    while at < len(data):
        if at + HEADER.size > len(data):
            raise ChunkError("a chunk's header is cut short")
        magic, version, flags, size, raw_size, check = HEADER.unpack_from(data, at)
        body = data[at + HEADER.size : at + HEADER.size + size]
        if magic != MAGIC or version != VERSION or flags & ~ZSTD:
            raise ChunkError("not a chunk of a known version")
        if len(body) < size or xxh32_intdigest(body) != check:
            raise ChunkError("a chunk's body is cut short or altered")
        raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=raw_size) if flags & ZSTD else body
        if len(raw) != raw_size:
            raise ChunkError("a chunk's raw size is not the one that its header names")
        yield raw
        at += HEADER.size + size


def packed(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Payloads (a text or binary column) as chunks in `content`, made on the executors."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw = part.column(0).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([None if x is None else pack(x) for x in raw], pa.binary())], names=["content"])

    return payloads.select(column).mapInArrow(run, "content binary")


def unpacked(contents: DataFrame) -> DataFrame:
    """The payloads (value, binary) of chunks, one or more in each row of `content`."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for x in part.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(list(unpack(x or b"")), pa.binary())], names=["value"])

    return contents.select("content").mapInArrow(run, "value binary")
