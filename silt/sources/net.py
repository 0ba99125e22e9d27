"""Line framing of network bytes, a spool for pushed payloads, and journal and process log exports."""

from __future__ import annotations

import os
import socket
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LINE_BYTES = 1 << 20


def frames(data: bytes) -> tuple[list[bytes], bytes]:
    """Whole messages of a TCP stream and what is left: octet-counted (`LEN SP bytes`) where it starts so, else by newline."""
    out = []
    while data:
        head, space, rest = data.partition(b" ")
        if space and head.isdigit() and 0 < len(head) < 8 and head[:1] != b"0":
            n = int(head)
            if len(rest) < n:
                break
            out.append(rest[:n].rstrip(b"\r\n")[:LINE_BYTES])
            data = rest[n:].lstrip(b"\n") if rest[n : n + 1] == b"\n" else rest[n:]
            continue
        line, end, rest = data.partition(b"\n")
        if not end:
            break
        out.append(line.rstrip(b"\r")[:LINE_BYTES])
        data = rest
    return [x for x in out if x], data


def spool(folder: str, payload: bytes) -> str:
    """A payload as a new file of a folder that a file stream watches: written aside, then moved in whole."""
    os.makedirs(folder, exist_ok=True)
    name = uuid.uuid4().hex
    aside = os.path.join(folder, f".{name}.part")
    with open(aside, "wb") as f:
        f.write(payload)
    os.rename(aside, os.path.join(folder, f"{name}.log"))
    return os.path.join(folder, f"{name}.log")


class _Polls(DataSourceStreamReader):
    """Datagrams of one socket, read by one task a trigger."""

    def __init__(self, options: dict) -> None:
        self.host, self.port = options.get("host", "127.0.0.1"), int(options["port"])
        self.most, self.wait = int(options.get("maxdatagrams", 256)), float(options.get("timeout", 0.2))
        self.turn = 0

    def initialOffset(self) -> dict:
        return {"turn": 0}

    def latestOffset(self) -> dict:
        self.turn += 1
        return {"turn": self.turn}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(end["turn"])]

    def read(self, partition: InputPartition):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            s.bind((self.host, self.port))
            s.settimeout(self.wait)
            for _ in range(self.most):
                try:
                    data = s.recv(65535)
                except TimeoutError:
                    return
                for line in data.decode("utf-8", "replace").splitlines():
                    if line:
                        yield (line,)


class UdpLines(DataSource):
    """readStream.format("udp_lines"): lines of datagrams to host and port. Datagrams aren't replayed after a failure."""

    @classmethod
    def name(cls) -> str:
        return "udp_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Polls(self.options)


def lines_of(spark: SparkSession, payload: str | bytes) -> DataFrame:
    """Lines of text at hand (standard input, a request body)."""
    text = payload.decode("utf-8", "replace") if isinstance(payload, bytes) else payload
    rows = [(x.removesuffix("\r"),) for x in text.split("\n") if x.strip("\r")]
    return spark.createDataFrame(rows, "value string")


def journal(lines: DataFrame, units: list[str] = (), identifiers: list[str] = (), priority: int | None = None) -> DataFrame:
    """Rows of a journal's JSON export, by unit, identifier and least severity (0 is the gravest)."""
    get = lambda k: F.get_json_object("value", f"$.{k}")
    rows = lines.select(
        (get("__REALTIME_TIMESTAMP").try_cast("bigint") * 1000).alias("timestamp"), get("PRIORITY").try_cast("int").alias("priority"),
        get("_SYSTEMD_UNIT").alias("unit"), get("SYSLOG_IDENTIFIER").alias("identifier"), get("MESSAGE").alias("body"),
        get("_HOSTNAME").alias("host"), get("_PID").try_cast("bigint").alias("pid"), get("__CURSOR").alias("cursor"))
    if units:
        rows = rows.where(F.col("unit").isin(*units))
    if identifiers:
        rows = rows.where(F.col("identifier").isin(*identifiers))
    return rows if priority is None else rows.where(F.col("priority") <= priority)


def system_log(lines: DataFrame, level: str | None = None, subsystems: list[str] = (), processes: list[str] = ()) -> DataFrame:
    """Rows of a desktop system log's JSON stream, at a level or above (default, info, debug) and by subsystem and process."""
    get = lambda k: F.get_json_object("value", f"$.{k}")
    process = F.element_at(F.split(get("processImagePath"), "/"), -1)
    rows = lines.select(
        get("timestamp").alias("timestamp"), get("messageType").alias("level"), get("subsystem").alias("subsystem"), get("category").alias("category"),
        process.alias("process"), get("processID").try_cast("bigint").alias("pid"), get("eventMessage").alias("body"))
    if level is not None:
        hidden = {"default": ("Info", "Debug"), "info": ("Debug",), "debug": ()}[level]
        rows = rows.where(~F.coalesce(F.col("level").isin(*hidden), F.lit(False))) if hidden else rows
    if subsystems:
        rows = rows.where(F.col("subsystem").isin(*subsystems))
    return rows.where(F.col("process").isin(*processes)) if processes else rows
