"""Segment files: a header, Arrow IPC streams one after another, and a footer with counts and a checksum."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format, all little-endian. Header: magic, version, flags, segment id, hash of the SQL, time in
# ms. Footer: rows, batches, bytes of the streams, xxHash32 of all before it, magic, footer size. File names.
MAGIC, VERSION, ZSTD, FOOTER_SIZE = b"LCHK", 1, 1, 32
HEADER, FOOTER = struct.Struct("<4sHHQQQ"), struct.Struct("<QIQI4sI")
NAME = "seg-{:010}.lchk"


@dataclass(frozen=True)
class Segment:
    segment_id: int
    sql_hash: int
    created_ms: int
    rows: int
    batches: list[pa.RecordBatch]


class SegmentError(ValueError):
    """A file that is no sound segment; kind: incomplete, corrupt or unsupported."""

    def __init__(self, kind: str) -> None:
        super().__init__(f"a segment is {kind}")
        self.kind = kind


def sql_hash(sql: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(sql.encode()) if sql else 0


def pack(batches: list[pa.RecordBatch], segment_id: int, sql: str = "", created_ms: int = 0) -> bytes:
    from xxhash import xxh32_intdigest

    out = io.BytesIO()
    out.write(HEADER.pack(MAGIC, VERSION, ZSTD, segment_id, sql_hash(sql), created_ms))
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=options) as w:
            w.write_batch(batch)
        out.write(sink.getvalue())
    rows, size = sum(b.num_rows for b in batches), out.tell() - HEADER.size
    head = struct.pack("<QIQ", rows, len(batches), size)
    check = xxh32_intdigest(out.getvalue() + head)
    return out.getvalue() + FOOTER.pack(rows, len(batches), size, check, MAGIC, FOOTER_SIZE)


def unpack(data: bytes) -> Segment:
    from xxhash import xxh32_intdigest

    if len(data) < HEADER.size or data[:4] != MAGIC:
        raise SegmentError("corrupt")
    _, version, flags, segment_id, of_sql, created = HEADER.unpack_from(data)
    if version != VERSION or flags & ~ZSTD:
        raise SegmentError("unsupported")
    if len(data) < HEADER.size + FOOTER.size or data[-8:-4] != MAGIC:
        raise SegmentError("incomplete")
    rows, n, size, check, _, footer_size = FOOTER.unpack_from(data, len(data) - FOOTER.size)
    if footer_size != FOOTER_SIZE or HEADER.size + size + FOOTER.size != len(data) or xxh32_intdigest(data[:-12]) != check:
        raise SegmentError("corrupt")
    stream, batches = io.BytesIO(data[HEADER.size : -FOOTER.size]), []
    while stream.tell() < size:
        with pa.ipc.open_stream(stream) as reader:
            batches.extend(reader)
    if len(batches) != n or sum(b.num_rows for b in batches) != rows:
        raise SegmentError("corrupt")
    return Segment(segment_id, of_sql, created, rows, batches)


def packed(df: DataFrame, first: int = 0, rows_each: int = 50_000, sql: str = "", created_ms: int = 0) -> DataFrame:
    """name and content of the segments of df's rows, about rows_each rows each; ids grow with the partitions, with gaps."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment, held, n = first + (TaskContext.get().partitionId() << 16), [], 0

        def one() -> pa.RecordBatch:
            content = pack(held, segment, sql, created_ms)
            return pa.RecordBatch.from_arrays([pa.array([NAME.format(segment)]), pa.array([content], pa.binary())], names=["name", "content"])

        for part in parts:
            held.append(part)
            n += part.num_rows
            if n >= rows_each:
                yield one()
                segment, held, n = segment + 1, [], 0
        if held:
            yield one()

    return df.mapInArrow(run, "name string, content binary")


def status(contents: DataFrame) -> DataFrame:
    """name, segment_id, rows and status (ok, incomplete, corrupt or unsupported) of segments (name, content)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for name, content in zip(*(c.to_pylist() for c in part.columns)):
                try:
                    s = unpack(content)
                    rows.append((name, s.segment_id, s.rows, "ok"))
                except SegmentError as e:
                    rows.append((name, None, None, e.kind))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["name", "segment_id", "rows", "status"])

    return contents.select("name", "content").mapInArrow(run, "name string, segment_id bigint, rows bigint, status string")


def rows_of(contents: DataFrame, schema: str, sql: str | None = None) -> DataFrame:
    """The rows of the sound segments (name, content), for replay; one of another SQL, or of an unknown version, is an error."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0).to_pylist():
                try:
                    s = unpack(content)
                except SegmentError as e:
                    if e.kind == "unsupported":
                        raise
                    continue
                if sql is not None and s.sql_hash != sql_hash(sql):
                    raise ValueError("a segment was written for another SQL")
                yield from s.batches

    return contents.select("content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """name and content of a folder's segment files, whatever they hold."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lchk").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
