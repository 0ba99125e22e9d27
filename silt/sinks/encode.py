"""Rows as payloads: JSON lines, text, console lines, bulk requests, labelled streams and OTLP JSON.

Rows are encoded by Spark's own functions; Python only joins encoded rows to payloads, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    MapType,
    NumericType,
    StringType,
    StructType,
)

from silt import schema as names
from silt.functions.scalar import epoch_nanos, severity_number
from silt.schema import double_text, is_conflict

#: Records that a task holds back to send with others of their resource.
HELD_RECORDS = 50_000
#: Bytes of a push of labelled streams, about.
PUSH_BYTES = 1 << 20

_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def json_string(x: Column) -> Column:
    """A JSON string literal; control characters as \\u00XX."""
    plain = x
    for a, b in _ESCAPES:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), plain, F.lit('"'))
    # Other control characters are rare: Spark's own writer escapes those.
    odd = F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")
    return F.when(x.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), odd).otherwise(quoted)


def json_value(x: Column, kind: DataType) -> Column:
    """JSON text of a value, null for SQL null: numbers bare, non-finite ones null, binary 0x…, structs as objects."""
    if is_conflict(kind):
        have = {f.name: f.dataType for f in kind}
        parts = [json_value(x.getField(n), have[n]) for n in ("int", "float", "bool", "str") if n in have]
        return F.coalesce(*parts)
    if isinstance(kind, (DoubleType, FloatType)):
        finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
        return F.when(finite, double_text(x.cast("double")))
    if isinstance(kind, BooleanType) or isinstance(kind, NumericType):
        return x.cast("string")
    if isinstance(kind, BinaryType):
        return F.when(x.isNotNull(), F.concat(F.lit('"0x'), F.lower(F.hex(x)), F.lit('"')))
    if isinstance(kind, (StructType, ArrayType, MapType)):
        return F.to_json(x, {"ignoreNullFields": "false"})
    return json_string(x if isinstance(kind, StringType) else x.cast("string"))


def _fields(df: DataFrame):
    return [f for f in df.schema if f.name != names.SOURCE_ID]


def row_json(df: DataFrame, skip_nulls: bool = False, extra: list[Column] = ()) -> Column:
    """A row as one JSON object in column order; internal columns are left out. extra: further `"k":v` texts."""
    parts = []
    for f in _fields(df):
        value = json_value(F.col(f"`{f.name}`"), f.dataType)
        key = '"' + f.name.replace("\\", "\\\\").replace('"', '\\"') + '":'
        text = F.concat(F.lit(key), value)
        parts.append(text if skip_nulls else F.coalesce(text, F.lit(key + "null")))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts, *extra), F.lit("}"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(row_json(df).alias("value"))


def text_lines(df: DataFrame, message: str = "body") -> DataFrame:
    """Each row's message: the first that isn't null of body, the column named, message and msg; rows without one are skipped.

    JSON lines if there is no such column.
    """
    wanted = dict.fromkeys(["body", message, "message", "msg"])
    have = [c for w in wanted for c in df.columns if c.lower() == w.lower()]
    if not have:
        return json_lines(df)
    value = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in have])
    return df.select(value.alias("value")).where("value is not null")


def console_lines(df: DataFrame, message: str = "message") -> DataFrame:
    """Time of day, the level five wide, the message, then k=v of the other columns that have a value."""
    time, level = names.role(df, names.TIMESTAMP), names.role(df, names.SEVERITY)
    have = {c.lower(): c for c in df.columns}
    body = next((have[c] for c in dict.fromkeys([message.lower(), *names.BODY]) if c in have), None)
    parts = []
    if time:
        t = F.col(f"`{time}`").cast("string")
        parts.append(F.coalesce(F.concat(F.when(t.contains("T"), F.substring_index(t, "T", -1)).otherwise(t), F.lit("  ")), F.lit("")))
    if level:
        v = F.col(f"`{level}`").cast("string")
        parts.append(F.coalesce(F.concat(F.when(F.length(v) < 5, F.rpad(v, 5, " ")).otherwise(v), F.lit("  ")), F.lit("")))
    if body:
        parts.append(F.coalesce(F.col(f"`{body}`").cast("string"), F.lit("")))
    others = []
    for f in _fields(df):
        if f.name not in (time, level, body):
            x = F.col(f"`{f.name}`")
            shown = json_value(x, f.dataType) if not isinstance(f.dataType, StringType) else x
            others.append(F.concat(F.lit(f"{f.name}="), shown))
    if others:
        tail = F.concat_ws(" ", *others)
        parts.append(F.when(tail != "", F.concat(F.lit("  "), tail)).otherwise(F.lit("")))
    return df.select(F.concat(*parts).alias("value"))


def nanos_text(nanos: Column) -> Column:
    day = F.date_format(F.timestamp_seconds(F.floor(nanos / 10**9)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(day, F.lit("."), F.lpad(F.pmod(nanos, F.lit(10**9)).cast("string"), 9, "0"), F.lit("Z"))


def bulk_lines(df: DataFrame, index: str, observed_ns: int = 0) -> DataFrame:
    """Action line and document of each row in `value`; @timestamp is the observed time unless a time column is there."""
    stamped = names.role(df, names.TIMESTAMP)
    extra = [] if stamped else [F.concat(F.lit('"@timestamp":"'), nanos_text(F.lit(observed_ns)), F.lit('"'))]
    action = '{"index":{"_index":"' + index + '"}}\n'
    return df.select(F.concat(F.lit(action), row_json(df, skip_nulls=True, extra=extra), F.lit("\n")).alias("value"))


def batches(lines: DataFrame, limit: int = 5 << 20) -> DataFrame:
    """Payloads of at most limit bytes from lines (value), in each partition's order; a longer line stands alone."""
    import pandas as pd

    def run(parts):
        held, size = [], 0
        for part in parts:
            for x in part["value"]:
                n = len(x.encode())
                if held and size + n > limit:
                    yield pd.DataFrame({"payload": ["".join(held)], "lines": [len(held)]})
                    held, size = [], 0
                held.append(x)
                size += n
        if held:
            yield pd.DataFrame({"payload": ["".join(held)], "lines": [len(held)]})

    return lines.mapInPandas(run, "payload string, lines bigint")


def label_name(name: str) -> str:
    """A label's name: letters, digits and underscores, no digit first."""
    clean = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return "_" + clean if clean[:1].isdigit() else clean


def streams(
    df: DataFrame, labels: dict[str, str], static: dict[str, str] | None = None, observed_ns: int = 0, after: DataFrame | None = None
) -> DataFrame:
    """Rows by label set: labels (a map), ns and line, with times strictly growing within a stream.

    Times come from _timestamp, @timestamp or another time column, else the observed one (also for negative numbers);
    a time not above the one before becomes that plus one. That is a running maximum of time less place, over one
    window in time order. labels: {column: label}; empty values have no label. after: the last time of streams in batches
    before this one (see last_times), which these must pass.
    """
    have = {c.lower(): c for c in df.columns}
    time = next((have[c] for c in ("_timestamp", "@timestamp", "timestamp", "time", "ts") if c in have), None)
    ns = epoch_nanos(F.col(f"`{time}`").cast("string")) if time else F.lit(None).cast("bigint")
    ns = F.coalesce(F.when(ns >= 0, ns), F.lit(observed_ns))
    pairs = [F.struct(F.lit(label_name(k)).alias("key"), F.lit(v).alias("value")) for k, v in (static or {}).items()]
    for column, label in labels.items():
        value = F.col(f"`{column}`").cast("string")
        pairs.append(F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.lit(label_name(label)).alias("key"), value.alias("value"))))
    sets = F.array_sort(F.array_compact(F.array(*pairs)))
    rows = df.select(sets.alias("silt_labels"), ns.alias("silt_ns"), row_json(df).alias("line"), F.monotonically_increasing_id().alias("silt_id"))
    w = Window.partitionBy("silt_labels").orderBy("silt_ns", "silt_id")
    place = F.row_number().over(w)
    rows = rows.withColumn("silt_place", place).withColumn("silt_free", F.col("silt_ns") - F.col("silt_place"))
    least = F.max("silt_free").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("silt_least", least).withColumn("labels", F.map_from_entries("silt_labels"))
    if after is not None:
        rows = rows.join(after.select(F.col("stream").alias("silt_stream"), F.col("ns").alias("silt_last")), F.to_json("labels") == F.col("silt_stream"), "left")
        rows = rows.withColumn("silt_least", F.greatest("silt_least", "silt_last"))
    return rows.select("labels", (F.col("silt_least") + F.col("silt_place")).alias("ns"), "line")


def last_times(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """stream (its labels as JSON) and ns, the last time of each stream of labelled rows, and of those before."""
    now = rows.select(F.to_json("labels").alias("stream"), "ns")
    return (now if before is None else now.unionByName(before)).groupBy("stream").agg(F.max("ns").alias("ns"))


def pushes(rows: DataFrame, limit: int = PUSH_BYTES) -> DataFrame:
    """Push bodies (value) of labelled rows (see streams) of about `limit` bytes, a stream's rows in order of time.

    Rows are dealt by label set, so a stream's pushes come from one task in order; a stream may take many pushes.
    """
    flat = rows.select(F.to_json("labels").alias("labels"), "ns", "line")
    flat = flat.repartition("labels").sortWithinPartitions("labels", "ns")
    return flat.mapInArrow(partial(_pushed, limit), "value string")


def _pushed(limit: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def body() -> pa.RecordBatch:
        streams = [f'{{"stream":{labels or "{}"},"values":[{",".join(values)}]}}' for labels, values in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(['{"streams":[' + ",".join(streams) + "]}"], pa.string())], names=["value"])

    for part in parts:
        for labels, ns, line in zip(*(c.to_pylist() for c in part.columns)):
            value = f'["{ns}",{json.dumps(line, ensure_ascii=False)}]'
            new = size + len(value.encode("utf-8", "surrogatepass")) + (0 if labels in held else len(labels or "") + 32)
            if held and new > limit:
                yield body()
                new = len(value) + len(labels or "") + 32
            held.setdefault(labels, []).append(value)
            size = new
    if held:
        yield body()


def _any_value(x: Column, kind: DataType) -> Column:
    if isinstance(kind, BooleanType):
        return F.concat(F.lit('{"boolValue":'), x.cast("string"), F.lit("}"))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.concat(F.lit('{"doubleValue":'), json_value(x, kind), F.lit("}"))
    if isinstance(kind, NumericType):
        return F.concat(F.lit('{"intValue":"'), x.cast("string"), F.lit('"}'))
    if isinstance(kind, BinaryType):
        return F.concat(F.lit('{"bytesValue":"'), F.base64(x), F.lit('"}'))
    return F.concat(F.lit('{"stringValue":'), json_string(x.cast("string")), F.lit("}"))


def _attribute_list(df: DataFrame, columns: dict[str, str]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema}
    parts = [
        F.concat(F.lit('{"key":"' + k.replace('"', '\\"') + '","value":'), _any_value(F.col(f"`{c}`"), kinds[c]), F.lit("}"))
        for c, k in columns.items()
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")) if parts else F.lit("[]")


def otlp_requests(df: DataFrame, observed_ns: int = 0, rows_each: int = 10_000) -> DataFrame:
    """OTLP JSON requests (value), a resource and scope each, of at most rows_each records.

    Records are grouped by resource attributes and scope within each partition, in order; nothing is shuffled, a large
    group is cut into several requests, and a partition of very many resources sends them off when HELD_RECORDS wait.
    """
    df = names.normalize_conflicts(df)
    time, level, body = (names.role(df, r) for r in (names.TIMESTAMP, names.SEVERITY, names.BODY))
    trace, span, flags = (names.role(df, r) for r in (names.TRACE_ID, names.SPAN_ID, names.FLAGS))
    resource = {c: c[len(p) :] for c in df.columns for p in names.RESOURCE_PREFIXES if c.startswith(p)}
    used = {c for c in (time, level, body, trace, span, flags) if c} | set(resource) | {names.SOURCE_ID, names.SCOPE_NAME, names.SCOPE_VERSION}
    attrs = {c: c for c in df.columns if c not in used}
    text = lambda c: F.col(f"`{c}`").cast("string")
    parts = []
    if time:
        parts.append(F.concat(F.lit('"timeUnixNano":"'), epoch_nanos(text(time)).cast("string"), F.lit('"')))
    parts.append(F.lit(f'"observedTimeUnixNano":"{observed_ns}"'))
    if level:
        parts.append(F.concat(F.lit('"severityNumber":'), severity_number(text(level)).cast("string"), F.lit(',"severityText":'), json_string(text(level))))
    if body:
        parts.append(F.concat(F.lit('"body":{"stringValue":'), json_string(text(body)), F.lit("}")))
    for c, k, n in ((trace, "traceId", 32), (span, "spanId", 16)):
        if c:
            parts.append(F.when(text(c).rlike(f"^[0-9a-fA-F]{{{n}}}$"), F.concat(F.lit(f'"{k}":"'), F.lower(text(c)), F.lit('"'))))
    if flags:
        parts.append(F.concat(F.lit('"flags":'), text(flags).try_cast("bigint").cast("string")))
    parts.append(F.concat(F.lit('"attributes":'), _attribute_list(df, attrs)))
    scope = [F.concat(F.lit(f'"{k}":'), json_string(text(c))) for c, k in ((names.SCOPE_NAME, "name"), (names.SCOPE_VERSION, "version")) if c in df.columns]
    rows = df.select(
        _attribute_list(df, resource).alias("resource"), (F.concat(F.lit("{"), F.concat_ws(",", *scope), F.lit("}")) if scope else F.lit("{}")).alias("scope"),
        F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("record"),
    )
    return rows.select("resource", "scope", "record").mapInArrow(partial(_requests, rows_each), "value string")


def _requests(rows_each: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests of a partition's records by resource and scope; one is sent off when it is full, or all when many are held."""
    held: dict[tuple[str, str], list[str]] = {}

    def request(key: tuple[str, str]) -> str:
        records = ",".join(held.pop(key))
        return f'{{"resourceLogs":[{{"resource":{{"attributes":{key[0]}}},"scopeLogs":[{{"scope":{key[1]},"logRecords":[{records}]}}]}}]}}'

    def batch(values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])

    n = 0
    for part in parts:
        full = []
        for resource, scope, record in zip(*(c.to_pylist() for c in part.columns)):
            own = held.setdefault((resource, scope), [])
            own.append(record)
            n += 1
            if len(own) == rows_each:
                full.append(request((resource, scope)))
                n -= rows_each
        if n >= HELD_RECORDS:
            full += [request(key) for key in list(held)]
            n = 0
        if full:
            yield batch(full)
    if held:
        yield batch([request(key) for key in list(held)])
