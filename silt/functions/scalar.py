"""Scalar functions for logs, as Column functions and as the SQL text that the dialect puts in their place."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

# FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def quoted(text: str) -> str:
    """A SQL string literal that means text, whatever backslashes it has."""
    return "r'" + text + "'" if "'" not in text and "\\" in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Casts: null where the text isn't a number.


def int_sql(x: str) -> str:
    return f"try_cast({x} AS BIGINT)"


def float_sql(x: str) -> str:
    return f"try_cast({x} AS DOUBLE)"


def to_int(x: Column) -> Column:
    return x.try_cast("bigint")


def to_float(x: Column) -> Column:
    return x.try_cast("double")


# Regular expressions: null for no match, for a group that took no part, and for a group that isn't there.


def _places(pattern: str) -> list[tuple[int, int]]:
    """Start and number of each parenthesis of a pattern that opens a capturing group; Java's and Python's spelling."""
    at, out = 0, []
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at + 2)
            at = len(pattern) if end < 0 else end + 2
            continue
        if c == "\\":
            at += 2
            continue
        if c == "[":
            at = _class_end(pattern, at)
            continue
        if c == "(" and (pattern[at + 1 : at + 2] != "?" or re.match(r"\(\?P?<[A-Za-z_]", pattern[at:])):
            out.append((at, len(out) + 1))
        at += 1
    return out


def _class_end(pattern: str, at: int) -> int:
    """The place after a character class that starts at `at`; classes may be nested, as Java's are."""
    depth, i = 0, at
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            depth += 1
            i += pattern[i + 1 : i + 2] == "^"
            i += pattern[i + 1 : i + 2] == "]"
        elif pattern[i] == "]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(pattern)


@lru_cache(256)
def groups_of(pattern: str) -> int:
    """How many capturing groups a pattern has; an error if Java's engine, which runs it, refuses it.

    Without a running JVM (a configuration is checked) the pattern is taken as it is.
    """
    sc = SparkContext._active_spark_context
    if sc is None or sc._jvm is None:
        return len(_places(pattern))
    try:
        return sc._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (Py4JJavaError, PySparkException) as e:
        raise ValueError(f"bad regular expression {pattern!r}: {e}") from e


def may_be_empty(pattern: str) -> bool:
    """Whether a pattern can match the empty text (yes if it can't be told)."""
    try:
        return re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern)).fullmatch("") is not None
    except re.error:
        return True


def java(pattern: str) -> str:
    """A pattern with its named groups, which may have names that Java refuses, as plain ones."""
    return pattern if "\\k<" in pattern else re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)


def regexp_extract_sql(s: str, pattern: str, group: int) -> str:
    """Spark gives '' for a group that took no part; a back reference to the group after the first match tells that from
    an empty one, for it fails if the group took no part."""
    pattern = java(pattern)
    if group < 0 or group > groups_of(pattern):
        return "CAST(NULL AS STRING)"
    p = quoted(pattern)
    found = f"regexp_extract({s}, {p}, {group})"
    if not group:
        return f"CASE WHEN {s} RLIKE {p} THEN {found} END"
    took_part = quoted(rf"\A(?>(?s:.*?)(?:{pattern}))\{group}")
    return f"CASE WHEN {found} <> '' THEN {found} WHEN {s} RLIKE {took_part} THEN '' END"


def regexp_extract(column: str, pattern: str, group: int = 1) -> Column:
    """regexp_extract of a column, by name."""
    return F.expr(regexp_extract_sql(f"`{column}`", pattern, group))


# JSON text: keys of the top level only; a key is a name, dots and all.


def _path(key: str) -> str:
    """SQL literal of the JSON path to a top-level key."""
    return quoted(f"$['{key}']").replace("r'", "'", 1) if "\\" in key else "'$[\\'" + key + "\\']'"


def json_sql(x: str, key: str) -> str:
    return f"get_json_object({x}, {_path(key)})"


def _json_type(x: str, key: str) -> str:
    return f"schema_of_variant(try_variant_get(try_parse_json({x}), {_path(key)}, 'variant'))"


def json_int_sql(x: str, key: str) -> str:
    """A JSON integer that fits 64 bits; null for text, booleans and fractions."""
    return f"CASE WHEN {_json_type(x, key)} = 'BIGINT' THEN try_cast({json_sql(x, key)} AS BIGINT) END"


def json_float_sql(x: str, key: str) -> str:
    """Any JSON number; null for text and booleans."""
    kind = _json_type(x, key)
    return f"CASE WHEN {kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%' THEN try_cast({json_sql(x, key)} AS DOUBLE) END"


# Hash.


def fnv1a_64(texts: list[bytes | None]) -> np.ndarray:
    """FNV-1a of many byte strings, a byte of each at a time; as int64 with the same bits."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or b""))
    size = np.array([len(texts[i] or b"") for i in order], np.int64)
    buf = np.frombuffer(b"".join(texts[i] or b"" for i in order), np.uint8).astype(np.uint64)
    at = np.cumsum(size) - size
    h = np.full(len(texts), FNV_OFFSET, np.uint64)
    prime = np.uint64(FNV_PRIME)
    for k in range(int(size[0]) if size.size else 0):
        n = int(np.searchsorted(-size, -k))  # those longer than k
        h[:n] = (h[:n] ^ buf[at[:n] + k]) * prime
    out = np.empty(len(texts), np.uint64)
    out[order] = h
    return out.view(np.int64)


@pandas_udf(LongType())
def fnv1a_64_signed(s: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, as a signed 64-bit number; null for null."""
    h = fnv1a_64([None if x is None else x.encode("utf-8", "surrogatepass") for x in s])
    return pd.Series([None if x is None else int(v) for x, v in zip(s, h)], dtype="Int64")


def unsigned(h: str) -> str:
    """SQL: a signed 64-bit number's bits as DECIMAL(20, 0)."""
    return f"CAST(CAST({h} AS DECIMAL(20, 0)) + IF({h} < 0, 18446744073709551616BD, 0BD) AS DECIMAL(20, 0))"


def hash_sql(x: str) -> str:
    return unsigned(f"lg_fnv1a({x})")


def register(spark: SparkSession) -> None:
    """The Python-backed helpers that generated SQL calls."""
    spark.udf.register("lg_fnv1a", fnv1a_64_signed)


# Times and severities.

# Severity texts and numbers.
SEVERITIES = {
    "TRACE": 1, "TRACE2": 2, "TRACE3": 3, "TRACE4": 4, "DEBUG": 5, "DEBUG2": 6, "DEBUG3": 7, "DEBUG4": 8,
    "INFO": 9, "INFO2": 10, "INFO3": 11, "INFO4": 12, "WARN": 13, "WARNING": 13, "WARN2": 14, "WARN3": 15, "WARN4": 16,
    "ERROR": 17, "ERROR2": 18, "ERROR3": 19, "ERROR4": 20, "FATAL": 21, "FATAL2": 22, "FATAL3": 23, "FATAL4": 24,
}


def severity_number(level: Column) -> Column:
    """1 to 24, 0 if the text is none of those."""
    table = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(level)), F.lit(0))


def epoch_nanos(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text, or of a number of s, ms, µs or ns by its size; null otherwise."""
    zone = F.regexp_extract(text, r"([Zz]|[+-]\d\d:?\d\d)$", 1)
    whole = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.\d+)?(?:[Zz]|[+-]\d\d:?\d\d)?$", 0) != ""
    seconds = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8), F.when(zone == "", "Z").otherwise(F.upper(zone)))
    stamp = F.try_to_timestamp(seconds, F.lit("yyyy-MM-dd HH:mm:ss[XXX][XX][X]"))
    part = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 9), 9, "0").try_cast("bigint")
    number = text.try_cast("bigint")
    size = F.abs(number)
    scaled = (
        F.when(size < 10**11, number * 10**9)
        .when(size < 10**14, number * 10**6)
        .when(size < 10**17, number * 10**3)
        .otherwise(number)
    )
    return F.when(whole, F.unix_seconds(stamp) * 10**9 + F.coalesce(part, F.lit(0))).when(number.isNotNull(), scaled)
