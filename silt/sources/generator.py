"""Deterministic log rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What rows are made of.
LEVELS = ("INFO", "DEBUG", "WARN", "ERROR")
PATHS = ("/api/v1/users", "/api/v1/orders", "/api/v2/products", "/health", "/api/v1/auth")
METHODS = ("GET", "POST", "PUT", "DELETE")
SERVICES = ("myapp", "gateway", "auth-svc")
REQUEST_STEP = 0x517CC1B727220A95
CONTENT_TYPE, TAG, UPSTREAMS = "application/json", "web", ("10.0.0.1", "10.0.0.2")


def _pick(i: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(i, F.lit(len(values))).cast("int"))


def _wrapped_hex(i: Column, step: int) -> Column:
    """i * step modulo 2^64 in hex, for i below 2^32: in two halves that 64-bit numbers hold."""
    low, high = step & 0xFFFFFFFF, step >> 32
    d = lambda x: x.cast("decimal(38,0)")
    product = d(i) * F.lit(low).cast("decimal(20,0)") + F.pmod(d(i) * F.lit(high).cast("decimal(20,0)"), F.lit(1 << 32).cast("decimal(20,0)")) * F.lit(1 << 32).cast("decimal(20,0)")
    top = F.floor(product / F.lit(1 << 32).cast("decimal(20,0)"))
    part = lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint"))), 8, "0")
    return F.concat(part(top), part(product))


def logs(
    spark: SparkSession, n: int, start_ms: int = 1705276800000, step_ms: int = 1, complexity: str = "simple", first: int = 0, message: str | None = None
) -> DataFrame:
    """Rows first to first + n - 1 of the logs profile; message: a text that all rows have in place of their own."""
    return logs_of(spark.range(first, first + n).withColumnRenamed("id", "i"), start_ms, step_ms, complexity, message)


def logs_of(
    numbers: DataFrame, start_ms: int = 1705276800000, step_ms: int = 1, complexity: str = "simple", message: str | None = None
) -> DataFrame:
    """The rows of numbers (i), a batch or a stream."""
    i = F.col("i")
    status = F.when(i % 20 == 0, 500).when((i % 20).isin(1, 2), 404).when(i % 20 == 3, 429).otherwise(200)
    path, method = _pick(i, PATHS), _pick(i, METHODS)
    ident = F.lit(10000) + (i * 7) % 90000
    stamp = F.timestamp_millis(F.lit(start_ms) + i * step_ms)
    cols = [
        F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("timestamp"),
        _pick(i, LEVELS).alias("level"),
        F.concat(method, F.lit(" "), path, F.lit("/"), ident.cast("string"), F.lit(" "), status.cast("string")).alias("message"),
        (F.lit(1) + (i * 13) % 500).alias("duration_ms"),
        _wrapped_hex(i, REQUEST_STEP).alias("request_id"),
        _pick(i, SERVICES).alias("service"),
        status.cast("bigint").alias("status"),
    ]
    if message:
        cols[2] = F.lit(message).alias("message")
    if complexity == "complex":
        # Nested values as raw JSON text, as a scan of the JSON rows gives them; every fifth row, else every seventh.
        five, seven = i % 5 == 0, (i % 5 != 0) & (i % 7 == 0)
        text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        headers = text(f'{{"content-type":"{CONTENT_TYPE}","x-request-id":"', _wrapped_hex(i, REQUEST_STEP), '"}')
        tags = text(f'["{TAG}","', _pick(i, SERVICES), '","', _pick(i, LEVELS), '"]')
        upstream = text(f'[{{"host":"{UPSTREAMS[0]}","latency_ms":', (F.lit(1) + (i * 19) % 200).cast("string"),
                        f'}},{{"host":"{UPSTREAMS[1]}","latency_ms":', (F.lit(1) + (i * 13) % 500).cast("string"), "}]")
        cols += [(F.lit(128) + (i * 17) % 8192).alias("bytes_in"), (F.lit(64) + (i * 31) % 4096).alias("bytes_out")]
        cols += [F.when(five, headers).alias("headers"), F.when(five, tags).alias("tags"), F.when(seven, upstream).alias("upstream")]
    elif complexity != "simple":
        raise ValueError(f"unknown complexity {complexity!r}")
    return numbers.select(*cols)


def records(
    numbers: DataFrame, attributes: Mapping[str, str | int | float | bool | None], sequence: tuple[str, int] | None = None,
    created: str | None = None,
) -> DataFrame:
    """The record profile over numbers (i): static attributes, a sequence (name, first value), and a column of the time in ns."""
    cols = [F.lit(v).cast("string" if v is None else type_of(v)).alias(k) for k, v in attributes.items()]
    if sequence:
        cols.append((F.lit(sequence[1]) + F.col("i")).cast("bigint").alias(sequence[0]))
    if created:
        cols.append((F.unix_micros(F.current_timestamp()) * 1000).alias(created))
    return numbers.select(*cols)


def type_of(value: str | int | float | bool) -> str:
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")


def stream(spark: SparkSession, rows_per_second: int = 1000) -> DataFrame:
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return logs_of(rate.select(F.col("value").alias("i")))
