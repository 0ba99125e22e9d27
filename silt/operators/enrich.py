"""Lookup tables beside the log rows: from labels, the host, files, the environment and container metadata."""

from __future__ import annotations

import csv
import datetime
import getpass
import io
import json
import os
import platform
import re
import socket
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EnrichmentError(ValueError):
    """A lookup table that can't be built."""


def one_row(spark: SparkSession, values: Mapping[str, str]) -> DataFrame:
    if not values:
        raise EnrichmentError("a static table needs a label")
    schema = ", ".join(f"`{k}` string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema)


static = one_row


def _os_release(text: str | None = None) -> dict[str, str]:
    if text is None:
        try:
            with open("/etc/os-release", encoding="utf-8") as f:
                text = f.read()
        except OSError:
            text = ""
    return dict(read_kv(text, strict=False))


# Column names of the host table by style.
HOST_COLUMNS = {
    "raw": "hostname os_type os_arch os_name os_family os_version os_kernel host_id boot_id".split(),
    "ecs": "host.hostname host.os.type host.architecture host.os.name host.os.family host.os.version host.os.kernel host.id host.boot.id".split(),
    "otel": "host.name os.type host.arch os.name os.family os.version os.kernel host.id host.boot.id".split(),
}


def host_info(spark: SparkSession, style: str = "raw") -> DataFrame:
    style = {"beats": "ecs"}.get(style, style)
    if style not in HOST_COLUMNS:
        raise EnrichmentError(f"unknown host_info style {style!r}")
    release = _os_release()

    def read(path: str) -> str:
        try:
            with open(path, encoding="utf-8") as f:
                return f.read().strip()
        except OSError:
            return ""

    values = [
        socket.gethostname(), platform.system().lower(), platform.machine(), release.get("name", platform.system()),
        release.get("id_like", release.get("id", "")), release.get("version_id", ""), platform.release(),
        read("/etc/machine-id"), read("/proc/sys/kernel/random/boot_id"),
    ]
    return one_row(spark, dict(zip(HOST_COLUMNS[style], values)))


POD_PATH = r"^(.*/pods/([^_/]+)_(.+)_([0-9a-fA-F-]{36})/([^/]+)/)"


def k8s_path(paths: DataFrame, column: str = "path") -> DataFrame:
    """log_path_prefix, namespace, pod_name, pod_uid and container_name of distinct pod log paths."""
    part = lambda g: F.regexp_extract(column, POD_PATH, g)
    names = ("log_path_prefix", "namespace", "pod_name", "pod_uid", "container_name")
    return paths.where(F.col(column).rlike(POD_PATH)).select(*[part(g + 1).alias(n) for g, n in enumerate(names)]).distinct()


def pod_prefix(path):
    """The log_path_prefix of a path, to join k8s_path's rows by equality; null if it is no pod's."""
    return F.when(path.rlike(POD_PATH), F.regexp_extract(path, POD_PATH, 1))


def csv_table(spark: SparkSession, text: str) -> DataFrame:
    """All columns text, in the header's order: an empty cell is '', one that is missing at a row's end null."""
    rows = list(csv.reader(io.StringIO(text.removeprefix("﻿"))))
    if not rows:
        raise EnrichmentError("an empty CSV")
    header = [h.strip() for h in rows[0]]
    if not header or any(not h for h in header):
        raise EnrichmentError("an empty column name in the CSV header")
    if len({h.lower() for h in header}) < len(header):
        raise EnrichmentError("a column name twice in the CSV header")
    out = []
    for n, row in enumerate(rows[1:], 2):
        if not row:
            continue
        if len(row) > len(header):
            raise EnrichmentError(f"line {n} of the CSV has more cells than the header")
        out.append(tuple(row) + (None,) * (len(header) - len(row)))
    return spark.createDataFrame(out, ", ".join(f"`{h}` string" for h in header))


def jsonl_table(spark: SparkSession, text: str) -> DataFrame:
    """Columns of all objects in order of first sight; values as text, JSON null and missing ones null."""
    names: dict[str, None] = {}
    rows = []
    for line in text.splitlines():
        if line.strip():
            row = json.loads(line)
            if not isinstance(row, dict):
                raise EnrichmentError("a JSON line that is no object")
            names |= dict.fromkeys(row)
            rows.append(row)
    if not names:
        raise EnrichmentError("JSON lines without a field")

    def shown(x) -> str | None:
        return x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)

    return spark.createDataFrame([tuple(shown(r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def env_vars(spark: SparkSession, prefix: str = "", environ: Mapping[str, str] | None = None) -> DataFrame:
    found: dict[str, str] = {}
    for k, v in (os.environ if environ is None else environ).items():
        if k.startswith(prefix) and (name := k[len(prefix) :].lower()):
            if name in found:
                raise EnrichmentError(f"two variables are called {name}")
            found[name] = v
    if not found:
        raise EnrichmentError(f"no variable starts with {prefix!r}")
    return one_row(spark, dict(sorted(found.items())))


def process_info(spark: SparkSession, version: str = "0.1.0") -> DataFrame:
    start = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return one_row(spark, {"agent_name": "silt", "agent_version": version, "pid": str(os.getpid()), "start_time": start})


def read_kv(text: str, strict: bool = True) -> Iterable[tuple[str, str]]:
    """KEY=value lines: comments and blanks skipped, one layer of quotes taken off, names lower-cased, in order."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        k, _, v = line.partition("=")
        k, v = k.strip().lower(), v.strip()
        if len(v) >= 2 and v[0] == v[-1] and v[0] in "'\"":
            v = v[1:-1]
        if strict and k in found:
            raise EnrichmentError(f"{k} twice in a key-value file")
        found[k] = v
    return sorted(found.items())


def kv_file(spark: SparkSession, text: str) -> DataFrame:
    return one_row(spark, dict(read_kv(text)))


def network_info(spark: SparkSession) -> DataFrame:
    v4, v6 = [], []
    try:
        for kind, *_, addr in socket.getaddrinfo(socket.gethostname(), None):
            where = v4 if kind == socket.AF_INET else v6
            if addr[0] not in where and not addr[0].startswith(("127.", "::1")):
                where.append(addr[0])
    except OSError:
        pass
    values = {"hostname": socket.gethostname(), "primary_ipv4": v4[0] if v4 else "", "primary_ipv6": v6[0] if v6 else ""}
    return one_row(spark, values | {"all_ipv4": ",".join(v4), "all_ipv6": ",".join(v6)})


_CONTAINER = re.compile(r"(?:(docker|containerd|crio|cri-containerd|libpod)[-/:]|/)([0-9a-f]{64})")


def container_info(spark: SparkSession, cgroup: str | None = None) -> DataFrame:
    if cgroup is None:
        try:
            with open("/proc/self/cgroup", encoding="utf-8") as f:
                cgroup = f.read()
        except OSError:
            cgroup = ""
    m = _CONTAINER.search(cgroup)
    runtime = {"libpod": "podman", "cri-containerd": "containerd"}.get(m[1], m[1]) if m and m[1] else ""
    return one_row(spark, {"container_id": m[2] if m else "", "container_runtime": runtime or ""})


def k8s_cluster_info(spark: SparkSession, environ: Mapping[str, str] | None = None) -> DataFrame:
    e = os.environ if environ is None else environ
    first = lambda *names: next((e[n] for n in names if e.get(n)), "")
    return one_row(spark, {
        "namespace": first("POD_NAMESPACE", "K8S_NAMESPACE"), "pod_name": first("POD_NAME", "K8S_POD_NAME"),
        "node_name": first("NODE_NAME", "K8S_NODE_NAME"), "service_account": first("SERVICE_ACCOUNT", "K8S_SERVICE_ACCOUNT"),
        "cluster_name": first("CLUSTER_NAME", "K8S_CLUSTER_NAME"),
    })


class Reloading:
    """A table built anew when it is older than `seconds`; if that fails, the table before stays."""

    def __init__(self, build, seconds: float) -> None:
        self.build, self.seconds = build, seconds
        self.at, self.table = None, None

    def snapshot(self) -> DataFrame:
        now = datetime.datetime.now().timestamp()
        if self.at is None or now - self.at >= self.seconds:
            try:
                self.table = self.build()
            except Exception:
                if self.table is None:
                    raise
            self.at = now
        return self.table


def user() -> str:
    return getpass.getuser()
