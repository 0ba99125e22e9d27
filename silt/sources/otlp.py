"""OTLP logs in JSON: requests to flat rows, and flat rows to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANY = "STRUCT<stringValue: STRING, boolValue: BOOLEAN, intValue: STRING, doubleValue: DOUBLE, bytesValue: STRING>"
_ATTRS = f"ARRAY<STRUCT<key: STRING, value: {_ANY}>>"
REQUEST = f"""resourceLogs ARRAY<STRUCT<resource: STRUCT<attributes: {_ATTRS}>, scopeLogs: ARRAY<STRUCT<
    scope: STRUCT<name: STRING, version: STRING>, logRecords: ARRAY<STRUCT<timeUnixNano: STRING,
    observedTimeUnixNano: STRING, severityNumber: INT, severityText: STRING, body: {_ANY}, attributes: {_ATTRS},
    flags: BIGINT, traceId: STRING, spanId: STRING>>>>>>"""


def _any(v: Column) -> Column:
    return F.coalesce(
        v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["bytesValue"]
    )


def _map(attributes: Column) -> Column:
    """Attributes as a map; the first of equal keys wins."""
    pairs = F.transform(attributes, lambda a: F.struct(a["key"].alias("key"), _any(a["value"]).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(F.coalesce(first, F.array().cast("array<struct<key:string,value:string>>")))


def _first(attributes: Column, key: str) -> Column:
    """The value of the first attribute of a name."""
    return _any(F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"])


def read_requests(requests: DataFrame, attributes: list[str] = (), resources: list[str] = ()) -> DataFrame:
    """A row for each log record of requests (value: JSON text), with the attributes and resource attributes named.

    All attributes are in `attributes` and `resource` as maps; event time falls back to observed time.
    """
    r = requests.select(F.from_json("value", REQUEST).alias("r")).select(F.explode("r.resourceLogs").alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeLogs").alias("s"))
    rec = s.select("resource", "s.scope", F.explode("s.logRecords").alias("l"))
    event, seen = F.col("l.timeUnixNano").try_cast("bigint"), F.col("l.observedTimeUnixNano").try_cast("bigint")
    kept = [
        F.coalesce(F.when(event > 0, event), seen).alias("timestamp"), seen.alias("observed_timestamp"),
        F.col("l.severityText").alias("level"), F.col("l.severityNumber").alias("severity_number"), _any(F.col("l.body")).alias("body"),
        F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), F.col("l.flags").alias("flags"),
        F.col("scope.name").alias("scope.name"), F.col("scope.version").alias("scope.version"),
        _map(F.col("l.attributes")).alias("attributes"), _map(F.col("resource")).alias("resource"),
    ]
    # Attributes by name are looked up in the list: where the maps aren't read, none is built.
    named = [_first(F.col("l.attributes"), a).alias(a) for a in attributes]
    named += [_first(F.col("resource"), a).alias(f"resource.attributes.{a}") for a in resources]
    return rec.select(*kept, *named)
