"""Payloads to where they go: files, HTTP, TCP, UDP, nowhere, or several sinks at once."""

from __future__ import annotations

import gzip
import socket
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from silt.sinks import encode
from silt.sources import arrow_ipc
from silt.store import Versions, written

#: Bytes of one datagram.
DATAGRAM = 1400


def to_file(df: DataFrame, path: str, format: str = "json", mode: str = "append") -> None:
    lines = encode.json_lines(df) if format == "json" else encode.text_lines(df) if format == "text" else None
    if lines is None:
        raise ValueError(f"a file can't have the format {format!r}")
    lines.write.mode(mode).text(path)


def to_stdout(df: DataFrame, format: str = "console", write: Callable[[str], object] = print) -> int:
    lines = {"json": encode.json_lines, "text": encode.text_lines, "console": encode.console_lines}[format](df)
    n = 0
    for row in lines.toLocalIterator():
        write(row["value"])
        n += 1
    return n


def to_null(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


@dataclass(frozen=True)
class Outcome:
    """ok, retry (after seconds) or reject."""

    kind: str
    after: float = 0.0


def classify(status: int, retry_after: str | None = None) -> Outcome:
    """What an HTTP status asks for: 408 and 429 to wait (5 s unless told), 5xx to try again, 3xx and other 4xx to give up."""
    if 200 <= status < 300:
        return Outcome("ok")
    if status in (408, 429):
        return Outcome("retry", float(retry_after) if retry_after and retry_after.isdigit() else 5.0)
    return Outcome("retry") if status >= 500 else Outcome("reject")


Send = Callable[[bytes, Mapping[str, str]], tuple[int, str | None]]


def http_send(url: str, timeout: float = 30) -> Send:
    def send(body: bytes, headers: Mapping[str, str]) -> tuple[int, str | None]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, body, dict(headers)), timeout=timeout) as r:
                return r.status, None
        except HTTPError as e:
            return e.code, e.headers.get("Retry-After")

    return send


def compressed(body: bytes, codec: str) -> tuple[bytes, dict[str, str]]:
    if codec == "none":
        return body, {}
    if codec == "gzip":
        return gzip.compress(body, mtime=0), {"Content-Encoding": "gzip"}
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(body), {"Content-Encoding": "zstd"}
    raise ValueError(f"unknown codec {codec!r}")


def post(lines: DataFrame, send: Send, codec: str = "none", limit: int = 5 << 20, tries: int = 4, mime: str = "application/x-ndjson") -> None:
    """Posts lines (value, each with its line end) from the executors, in payloads of at most limit bytes.

    A payload that is rejected, or not taken after so many tries, fails the task, so the batch isn't acknowledged.
    """

    def part(rows) -> None:
        for row in rows:
            body, headers = compressed(row["payload"].encode(), codec)
            _take(send, body, {"Content-Type": mime, **headers}, tries, f"a payload of {row['lines']} lines")

    encode.batches(lines, limit).foreachPartition(part)


def post_each(bodies: DataFrame, send: Send, mime: str, codec: str = "none", tries: int = 4) -> None:
    """Posts each body (a text or binary column, the only one) by itself, with the same rules as post()."""

    def part(rows) -> None:
        for (body,) in rows:
            data, headers = compressed(body.encode() if isinstance(body, str) else bytes(body), codec)
            _take(send, data, {"Content-Type": mime, **headers}, tries, "a payload")

    bodies.foreachPartition(part)


def _take(send: Send, data: bytes, headers: Mapping[str, str], tries: int, what: str) -> None:
    for attempt in range(tries):
        outcome = classify(*send(data, headers))
        if outcome.kind == "ok":
            return
        if outcome.kind == "reject" or attempt == tries - 1:
            raise RuntimeError(f"{what} was not taken: {outcome.kind}")
        time.sleep(outcome.after or 0.1 * 2**attempt)


def to_loki(
    df: DataFrame, send: Send, labels: Mapping[str, str], static: Mapping[str, str] | None = None, observed_ns: int | None = None,
    state: str | None = None,
) -> None:
    """Labelled streams as push requests of about 1 MiB.

    state: a folder that keeps the last time of each stream, so that times grow across batches too; it is brought up to
    date once a batch is delivered.
    """
    spark = df.sparkSession
    kept = Versions(spark, state) if state else None
    before = kept.last() if kept else None
    rows = encode.streams(df, dict(labels), dict(static or {}), time.time_ns() if observed_ns is None else observed_ns, before)
    if kept:
        rows = written(rows)
    post_each(encode.pushes(rows), send, "application/json")
    if kept:
        kept.put(encode.last_times(rows, before))


def to_otlp(df: DataFrame, send: Send, protobuf: bool = True, codec: str = "none", observed_ns: int | None = None) -> None:
    """Log requests over HTTP, in protobuf or JSON."""
    from silt.sources import otlp_wire

    requests = encode.otlp_requests(df, time.time_ns() if observed_ns is None else observed_ns)
    if protobuf:
        post_each(otlp_wire.from_json(requests), send, "application/x-protobuf", codec)
    else:
        post_each(requests, send, "application/json", codec)


def to_arrow_ipc(df: DataFrame, send: Send, codec: str = "none") -> None:
    """Each partition's Arrow batches as IPC streams, made and posted on the executors."""
    post_each(arrow_ipc.streams(df), send, "application/vnd.apache.arrow.stream", codec)


def to_tcp(df: DataFrame, host: str, port: int) -> None:
    """JSON lines over a connection a partition; a broken one is opened once more."""

    def part(rows) -> None:
        s = None
        for row in rows:
            for attempt in (0, 1):
                try:
                    s = s or socket.create_connection((host, port), 10)
                    s.sendall((row["value"] + "\n").encode())
                    break
                except OSError:
                    s = None
                    if attempt:
                        raise
        if s:
            s.close()

    encode.json_lines(df).foreachPartition(part)


def datagrams(lines, size: int = DATAGRAM) -> list[bytes]:
    """Lines packed into datagrams of at most size bytes; a longer line has one of its own."""
    out, held = [], b""
    for line in lines:
        data = line.encode() + b"\n"
        if held and len(held) + len(data) > size:
            out.append(held)
            held = b""
        held += data
    return [*out, held] if held else out


def to_udp(df: DataFrame, host: str, port: int) -> None:
    def part(rows) -> None:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for data in datagrams(r["value"] for r in rows):
                s.sendto(data, (host, port))

    encode.json_lines(df).foreachPartition(part)


def fan_out(df: DataFrame, sinks: Mapping[str, Callable[[DataFrame], object]], tries: int = 3) -> dict[str, str]:
    """df to every sink; those that failed alone are tried again. The status of each: ok, or the error."""
    df = df.persist()
    status = dict.fromkeys(sinks, "pending")
    try:
        for _ in range(tries):
            for name, sink in sinks.items():
                if status[name] != "ok":
                    try:
                        sink(df)
                        status[name] = "ok"
                    except Exception as e:
                        status[name] = f"error: {e}"
            if all(s == "ok" for s in status.values()):
                break
    finally:
        df.unpersist()
    return status
