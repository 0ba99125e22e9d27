"""Column roles, and columns that hold several JSON types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

# Canonical column names and the variants accepted for them.
TIMESTAMP = ("timestamp", "time", "ts", "@timestamp", "_timestamp")
SEVERITY = ("level", "severity", "log_level", "loglevel", "lvl")
BODY = ("body", "message", "msg", "_msg")
TRACE_ID, SPAN_ID = ("trace_id",), ("span_id",)
FLAGS = ("trace_flags", "flags")
OBSERVED, SEVERITY_NUMBER = "observed_timestamp", "severity_number"
SCOPE_NAME, SCOPE_VERSION = "scope.name", "scope.version"
RESOURCE_PREFIXES = ("resource.attributes.", "_resource_")
SOURCE_ID = "__source_id"
SOURCE_PATHS = {"native": "file.path", "ecs": "file.path", "otel": "log.file.path", "vector": "file"}
CRI_TIMESTAMP, CRI_STREAM = "_timestamp", "_stream"
CONFLICT_CHILDREN = ("int", "float", "bool", "str")


def role(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The column of df that plays a role: the first of names that it has, ignoring case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n] for n in names if n in have), None)


def is_conflict(kind) -> bool:
    return isinstance(kind, StructType) and len(kind) > 0 and all(f.name in CONFLICT_CHILDREN for f in kind)


def double_text(x: Column) -> Column:
    """The shortest text of a double, without an exponent up to 1e16, with a small e beyond."""
    trimmed = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1")
    trimmed = F.regexp_replace(trimmed, r"\.$", ".0")
    exponent = F.regexp_replace(F.regexp_replace(F.lower(x.cast("string")), r"\.0e", "e"), r"e\+?", "e")
    big = (F.abs(x) >= 1e7) & (F.abs(x) < 1e16)
    return F.when(big, trimmed).when(x.cast("string").contains("E"), exponent).otherwise(x.cast("string"))


def flat_text(col: Column, kind: StructType) -> Column:
    """A conflict struct as text: int before float before bool before str."""
    have = {f.name: f.dataType for f in kind}
    parts = []
    for name in CONFLICT_CHILDREN:
        if name in have:
            child = col.getField(name)
            parts.append(double_text(child) if isinstance(have[name], (DoubleType, FloatType)) else child.cast("string"))
    return F.coalesce(*parts)


def normalize_conflicts(df: DataFrame) -> DataFrame:
    """df with each conflict struct as a text column; other structs stay."""
    out = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        out.append(flat_text(col, f.dataType).cast(StringType()).alias(f.name) if is_conflict(f.dataType) else col)
    return df.select(*out)
