"""YAML pipelines: read, checked, and run as a batch or a stream."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from silt.functions import geo
from silt.operators import enrich
from silt.plans.dialect import DialectError, names_in, translate
from silt.plans.runner import run_sql, validate_plan
from silt.sinks import deliver, encode
from silt.sources import arrow_ipc, generator, net, otlp, otlp_wire, receive, schemas, text
from silt.streaming.runner import run_stream

#: Inputs that are read to their end, and those that are pushed to: the latter go through a folder that a stream reads.
READ = ("file", "generator", "stdin", "s3", "journald", "macos_log", "host_metrics", "linux_ebpf_sensor", "macos_es_sensor", "windows_ebpf_sensor")
PUSHED = ("http", "tcp", "udp", "otlp", "arrow_ipc")
INPUTS = (*READ, *PUSHED)
NEEDS_PATH = ("file", "s3", "journald", "macos_log", "host_metrics", "linux_ebpf_sensor", "macos_es_sensor", "windows_ebpf_sensor")
FORMATS = ("json", "raw", "cri", "auto")
OUTPUTS = ("stdout", "file", "null", "http", "elasticsearch", "tcp", "udp", "loki", "otlp", "arrow_ipc")
#: What an output can't do without.
NEEDED = {
    "file": ("path",), "http": ("endpoint",), "elasticsearch": ("endpoint",), "tcp": ("host", "port"), "udp": ("host", "port"),
    "loki": ("endpoint",), "otlp": ("endpoint",), "arrow_ipc": ("endpoint",),
}
TABLES = (
    "static", "host_info", "csv", "jsonl", "env_vars", "process_info", "kv_file", "network_info", "container_info", "k8s_cluster_info",
    "k8s_path", "geo_database",
)
PASS = "SELECT * FROM logs"


class ConfigError(ValueError):
    """A configuration that can't run."""


def expand(value: str, environ: Mapping[str, str] | None = None) -> str:
    """${NAME} replaced by the variable; one that isn't set is an error."""
    e = os.environ if environ is None else environ

    def put(m: re.Match) -> str:
        if m[1] not in e:
            raise ConfigError(f"the variable {m[1]} is not set")
        return e[m[1]]

    return re.sub(r"\$\{([A-Za-z_]\w*)\}", put, value)


@dataclass
class Pipeline:
    inputs: list[dict]
    outputs: list[dict]
    transform: str = PASS
    enrichment: list[dict] = field(default_factory=list)
    source_metadata: str = "none"


def load(text_: str, environ: Mapping[str, str] | None = None) -> dict[str, Pipeline]:
    """Pipelines by name; a document without `pipelines` is one, called default."""
    import yaml

    def walk(x):
        if isinstance(x, str):
            return expand(x, environ)
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    data = walk(yaml.safe_load(text_) or {})
    if not isinstance(data, dict):
        raise ConfigError("a configuration is a mapping")
    out = {}
    for name, p in (data.get("pipelines") or {"default": data}).items():
        many = lambda a, b, p=p: p.get(b) or ([p[a]] if a in p else [])
        pipe = Pipeline(
            many("input", "inputs"), many("output", "outputs"), p.get("transform") or PASS,
            p.get("enrichment") or data.get("enrichment") or [], p.get("source_metadata", "none"),
        )
        check(pipe, name)
        out[name] = pipe
    return out


def check(p: Pipeline, name: str = "default") -> None:
    """Raises ConfigError for what can't run."""
    if not p.inputs or not p.outputs:
        raise ConfigError(f"{name}: a pipeline needs an input and an output")
    for i in p.inputs:
        if i.get("type") not in INPUTS:
            raise ConfigError(f"{name}: unknown input {i.get('type')!r}")
        if (f := i.get("format", "auto")) not in FORMATS:
            raise ConfigError(f"{name}: the format {f!r} is not supported")
        if i["type"] in NEEDS_PATH and not i.get("path"):
            raise ConfigError(f"{name}: the input {i['type']} needs a path")
        if i["type"] == "arrow_ipc" and not i.get("schema"):
            raise ConfigError(f"{name}: an arrow_ipc input needs the schema of its rows")
    if len({i["type"] in PUSHED for i in p.inputs}) > 1:
        raise ConfigError(f"{name}: inputs that are read and inputs that are pushed to need pipelines of their own")
    for o in p.outputs:
        if o.get("type") not in OUTPUTS:
            raise ConfigError(f"{name}: unknown output {o.get('type')!r}")
        if missing := [k for k in NEEDED.get(o["type"], ()) if o.get(k) in (None, "")]:
            raise ConfigError(f"{name}: the output {o['type']} needs {', '.join(missing)}")
        if bad := {"compression", "rotation", "delimiter", "path_template"} & o.keys() and o["type"] == "file":
            raise ConfigError(f"{name}: a file output doesn't take {bad}")
    for sql in [p.transform, *[i["sql"] for i in p.inputs if "sql" in i]]:
        try:
            translate(sql)
        except DialectError as e:
            raise ConfigError(f"{name}: {e}") from e
    seen = {"logs"}
    for e in p.enrichment:
        if e.get("type") not in TABLES:
            raise ConfigError(f"{name}: unknown enrichment {e.get('type')!r}")
        table = e.get("table_name") or e.get("name") or e.get("type")
        if table in seen:
            raise ConfigError(f"{name}: two tables are called {table}")
        seen.add(table)


def read_input(spark: SparkSession, i: dict, style: str = "none") -> DataFrame:
    if i["type"] == "generator":
        n = int(i.get("total_events", 1000))
        if i.get("profile", "logs") == "record":
            sequence = i.get("sequence") and (i["sequence"]["field"], int(i["sequence"].get("start", 0)))
            numbers = spark.range(n).withColumnRenamed("id", "i")
            return generator.records(numbers, i.get("attributes") or {}, sequence, i.get("event_created_unix_nano_field"))
        if i.get("profile", "logs") != "logs":
            raise ConfigError(f"the generator has no profile {i['profile']!r}")
        stamp = i.get("timestamp") or {}
        return generator.logs(
            spark, n, int(stamp.get("start_epoch_ms", 1705276800000)), int(stamp.get("step_ms", 1)), i.get("complexity", "simple"),
            message=i.get("message_template"))
    if i["type"] in ("host_metrics", "linux_ebpf_sensor", "macos_es_sensor", "windows_ebpf_sensor"):
        return spark.read.schema(schemas.of(i["type"])).json(i["path"])
    if i["type"] == "journald":
        return net.journal(spark.read.text(i["path"]), i.get("units", ()), i.get("identifiers", ()), i.get("priority"))
    if i["type"] == "macos_log":
        return net.system_log(spark.read.text(i["path"]), i.get("level"), i.get("subsystems", ()), i.get("processes", ()))
    if i["type"] == "stdin":
        import sys

        rows = [(x, "stdin", n) for n, x in enumerate(sys.stdin.read().splitlines()) if x]
        lines = spark.createDataFrame(rows, "value string, path string, line_no bigint")
    elif i["type"] == "s3" or str(i["path"]).endswith((".zst", ".zstd", ".sz", ".snappy")):
        # Objects tell their codec by their first bytes, whatever they are called.
        lines = text.read_packed(spark, i["path"])
    else:
        lines = text.read_lines(spark, i["path"])
    return rows_of(lines, i, style)


def rows_of(lines: DataFrame, i: dict, style: str = "none") -> DataFrame:
    """The log rows of lines (value, path, line_no) in an input's format."""
    form = i.get("format", "auto")
    if form == "raw":
        rows = text.raw(lines)
    else:
        if form in ("cri", "auto"):
            lines = text.cri(lines) if form == "cri" else text.auto(lines)
        have = tuple(c for c in ("path", "line_no", "body", "_timestamp", "_stream") if c in lines.columns)
        fields = text.discover(lines.where("value is not null"))
        own = {f.name for f in fields}
        keep = tuple(c for c in have if c not in own)
        rows = text.json_rows(lines.withColumnsRenamed({c: f"silt_{c}" for c in have}), fields, tuple(f"silt_{c}" for c in have))
        rows = rows.withColumnsRenamed({f"silt_{c}": c for c in keep})
        for c in set(have) - set(keep):
            rows = rows.withColumn(c, F.coalesce(F.col(f"silt_{c}").cast("string"), F.col(f"`{c}`").cast("string"))).drop(f"silt_{c}")
    rows = text.attach_source(rows, style)
    return rows.drop("path", "line_no")


def read_tables(spark: SparkSession, p: Pipeline) -> dict[str, DataFrame]:
    out = {}
    for e in p.enrichment:
        kind, name = e["type"], e.get("table_name") or e.get("name") or e["type"]

        def content(e=e) -> str:
            with open(e["path"], encoding="utf-8") as f:
                return f.read()

        build = {
            "static": lambda e=e: enrich.static(spark, {k: str(v) for k, v in (e.get("labels") or {}).items()}),
            "host_info": lambda e=e: enrich.host_info(spark, e.get("style", "raw")), "csv": lambda: enrich.csv_table(spark, content()),
            "jsonl": lambda: enrich.jsonl_table(spark, content()), "env_vars": lambda e=e: enrich.env_vars(spark, e.get("prefix", "")),
            "process_info": lambda: enrich.process_info(spark), "kv_file": lambda: enrich.kv_file(spark, content()),
            "network_info": lambda: enrich.network_info(spark), "container_info": lambda: enrich.container_info(spark),
            "k8s_cluster_info": lambda: enrich.k8s_cluster_info(spark),
            "k8s_path": lambda e=e: enrich.k8s_path(spark.read.text(e["path"]).select(F.col("_metadata.file_path").alias("path")).distinct()),
        }
        if kind == "geo_database":
            # No table but the function geo_lookup(ip) over it.
            geo.register(spark, geo.read_database(e["path"], e.get("format", "csv_range")))
        else:
            out[name] = build[kind]()
    return out


def write_output(df: DataFrame, o: dict) -> None:
    kind = o["type"]
    if kind == "stdout":
        deliver.to_stdout(df, o.get("format", "console"))
    elif kind == "file":
        deliver.to_file(df, o["path"], o.get("format", "json"))
    elif kind == "null":
        deliver.to_null(df)
    elif kind == "http":
        lines = encode.json_lines(df).select(F.concat("value", F.lit("\n")).alias("value"))
        deliver.post(lines, deliver.http_send(o["endpoint"]), o.get("compression", "none"))
    elif kind == "elasticsearch":
        deliver.post(encode.bulk_lines(df, o.get("index", "logs")), deliver.http_send(o["endpoint"].rstrip("/") + "/_bulk"), o.get("compression", "none"))
    elif kind == "loki":
        labels = o.get("label_columns") or o.get("labels_from") or {}
        labels = labels if isinstance(labels, dict) else {c: c for c in labels}
        send = deliver.http_send(o["endpoint"].rstrip("/") + "/loki/api/v1/push")
        deliver.to_loki(df, send, labels, o.get("static_labels"), state=o.get("state"))
    elif kind == "otlp":
        deliver.to_otlp(df, deliver.http_send(o["endpoint"]), o.get("encoding", "protobuf") == "protobuf", o.get("compression", "none"))
    elif kind == "arrow_ipc":
        deliver.to_arrow_ipc(df, deliver.http_send(o["endpoint"]), o.get("compression", "none"))
    elif kind == "tcp":
        deliver.to_tcp(df, o["host"], int(o["port"]))
    else:
        deliver.to_udp(df, o["host"], int(o["port"]))


def run(spark: SparkSession, p: Pipeline) -> DataFrame:
    """Runs a pipeline over what its inputs hold now; the rows that were delivered."""
    tables, parts = read_tables(spark, p), []
    for i in p.inputs:
        rows = read_input(spark, i, i.get("source_metadata", p.source_metadata))
        parts.append(run_sql(i.get("sql", p.transform), rows, tables))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    deliver.fan_out(out, {f"{n}:{o['type']}": lambda df, o=o: write_output(df, o) for n, o in enumerate(p.outputs)})
    return out


def receiver(i: dict, folder: str):
    """What listens for an input that is pushed to, spooling to a folder; close() ends it."""
    host, _, port = str(i.get("listen", "127.0.0.1:0")).rpartition(":")
    at = {"host": host or "127.0.0.1", "port": int(port)}
    if i["type"] == "tcp":
        return receive.TcpReceiver(folder, **at)
    if i["type"] == "udp":
        return receive.UdpReceiver(folder, **at)
    path = i.get("path") or {"http": "/", "otlp": "/v1/logs", "arrow_ipc": "/v1/arrow"}[i["type"]]
    return receive.HttpReceiver(folder, path, lines=i["type"] == "http", **at)


def _spooled(spark: SparkSession, i: dict, folder: str) -> DataFrame:
    """What a folder gets, as a stream: lines, or whole bodies in `content`."""
    if i["type"] in ("http", "tcp", "udp"):
        return text.stream_lines(spark, folder)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return files.load(folder).select("content")


def _prepared(i: dict, style: str):
    """Log rows of a micro-batch of what an input was sent."""

    def rows(df: DataFrame) -> DataFrame:
        if i["type"] == "arrow_ipc":
            return arrow_ipc.rows_of(df, i["schema"])
        if i["type"] == "otlp":
            is_json = F.ltrim(F.col("content").cast("string")).startswith("{")
            requests = otlp_wire.to_json(df.where(~is_json)).union(df.where(is_json).select(F.col("content").cast("string").alias("value")))
            return otlp.read_requests(requests, i.get("attributes", ()), i.get("resources", ()))
        return rows_of(df.withColumn("line_no", F.monotonically_increasing_id()), i, style)

    return rows


@dataclass
class Served:
    """Receivers and the streams behind them."""

    receivers: list
    queries: list

    def close(self) -> None:
        for r in self.receivers:
            r.close()
        for q in self.queries:
            q.processAllAvailable()
            q.stop()


def serve(spark: SparkSession, p: Pipeline, folder: str, interval: str = "1 second") -> Served:
    """A pipeline whose inputs are pushed to: micro-batches of what comes go to the outputs until it is closed.

    folder, which the executors share, holds what is spooled, and the checkpoints: what was spooled and not yet delivered
    is delivered when the pipeline is served again from the same folder.
    """
    tables, out = read_tables(spark, p), Served([], [])
    for n, i in enumerate(p.inputs):
        spool = f"{folder}/{n}-{i['type']}"
        os.makedirs(spool, exist_ok=True)
        out.receivers.append(receiver(i, spool))

        def sink(df: DataFrame, _: int, n=n) -> None:
            outputs = {f"{k}:{o['type']}": {"state": f"{folder}/{n}-{k}-state"} | o for k, o in enumerate(p.outputs)}
            status = deliver.fan_out(df, {k: lambda d, o=o: write_output(d, o) for k, o in outputs.items()})
            if failed := {k: v for k, v in status.items() if v != "ok"}:
                raise RuntimeError(f"not delivered: {failed}")

        prepare = _prepared(i, i.get("source_metadata", p.source_metadata))
        stream = _spooled(spark, i, spool)
        out.queries.append(run_stream(stream, i.get("sql", p.transform), sink, f"{folder}/{n}-checkpoint", tables, interval=interval, prepare=prepare))
    return out


def validate(spark: SparkSession, p: Pipeline, name: str = "default") -> dict[str, str]:
    """The output schema of each input's SQL, by input; a query that can't be planned is a ConfigError.

    Inputs whose rows are known without data (generator, sensors, otlp, arrow_ipc) are planned as they are; the columns
    of line formats come from data, so such a query is planned over the text columns that it names.
    """
    tables, out = read_tables(spark, p), {}
    for n, i in enumerate(p.inputs):
        sql = i.get("sql", p.transform)
        if i["type"] == "arrow_ipc":
            schema = StructType.fromDDL(i["schema"])
        elif i["type"] == "otlp":
            schema = otlp.read_requests(spark.createDataFrame([], "value string"), i.get("attributes", ()), i.get("resources", ())).schema
        elif i["type"] in ("generator", "journald") or i["type"] in NEEDS_PATH[4:]:
            schema = read_input(spark, {**i, "total_events": 0}).schema
        else:
            taken = {c.lower() for t in tables.values() for c in t.columns}
            schema = StructType([StructField(c, StringType()) for c in names_in(sql) if c.lower() not in taken])
        try:
            out[f"{n}:{i['type']}"] = validate_plan(spark, sql, schema, tables).simpleString()
        except (ValueError, PySparkException) as e:
            raise ConfigError(f"{name}: {e}") from e
    return out
