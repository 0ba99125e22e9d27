"""What may follow the SQL: a block list, and a lookup by HTTP. A chain is DataFrame.transform after transform."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys up to which a block list is broadcast; a longer one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000


class ProcessorError(ValueError):
    """A batch that a processor can never take."""


def read_blocklist(spark: SparkSession, text: str) -> DataFrame:
    """key and category of CSV lines key[,category]; blank keys are skipped, the last of equal keys counts."""
    found = {}
    for n, line in enumerate(text.splitlines()):
        key, _, category = line.partition(",")
        if n == 0 and key.strip().lower() == "key":
            continue
        if key.strip():
            found[key.strip()] = category.strip() or None
    return spark.createDataFrame(list(found.items()), "key string, category string")


def blocklist(df: DataFrame, column: str, entries: DataFrame, prefix: str = "blocklist") -> DataFrame:
    """df with {prefix}_match, never null, and {prefix}_category, by exact match of a text column."""
    names = (f"{prefix}_match", f"{prefix}_category")
    if column not in df.columns:
        raise ProcessorError(f"there is no column {column}")
    if not isinstance(df.schema[column].dataType, StringType):
        raise ProcessorError(f"{column} is no text column")
    if taken := [n for n in names if n in df.columns]:
        raise ProcessorError(f"the column {taken[0]} is there already")
    keys = entries.groupBy("key").agg(F.first("category").alias("category"))
    keys = keys.select(F.col("key").alias("silt_key"), F.col("category").alias(names[1]), F.lit(True).alias("silt_hit"))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    out = df.join(keys, F.col(f"`{column}`") == F.col("silt_key"), "left")
    return out.withColumn(names[0], F.coalesce("silt_hit", F.lit(False))).select(*df.columns, *names)


Fetch = Callable[[str], tuple[int, str]]


def classify(status: int, body: str) -> tuple[str | None, str]:
    """JSON text and status of a reply: hit, miss (404, 204 or empty), or error."""
    if status == 200 and body.strip():
        try:
            json.loads(body)
        except ValueError:
            return None, "error: the reply is no JSON"
        return body, "hit"
    if status in (200, 204, 404):
        return None, "miss"
    return None, f"error: status {status}"


def http_fetch(template: str, timeout: float = 5.0) -> Fetch:
    """GETs template with {key} in it."""

    def fetch(key: str) -> tuple[int, str]:
        from urllib.error import HTTPError
        from urllib.parse import quote
        from urllib.request import urlopen

        try:
            with urlopen(template.replace("{key}", quote(key, safe="")), timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except HTTPError as e:
            return e.code, ""

    return fetch


_cache: dict = {}


def http_enrich(df: DataFrame, column: str, fetch: Fetch, prefix: str = "http", concurrency: int = 16, ttl: float = 300) -> DataFrame:
    """df with {prefix}_json and {prefix}_status (hit, miss or error: ...) for each row's key; a null key is a miss.

    Distinct keys are asked once, on the executors, `concurrency` at a time; replies but errors are kept there for ttl.
    """
    concurrency = max(1, min(concurrency, 64))
    js, st = f"{prefix}_json", f"{prefix}_status"
    if column not in df.columns:
        return df.withColumn(js, F.lit(None).cast("string")).withColumn(st, F.lit("miss"))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(key: str) -> tuple[str | None, str]:
            at, reply = _cache.get((prefix, key), (0, None))
            if reply and time.time() - at < ttl:
                return reply
            try:
                reply = classify(*fetch(key))
            except Exception as e:
                reply = (None, f"error: {e}")
            if not reply[1].startswith("error"):
                _cache[prefix, key] = (time.time(), reply)
            return reply

        with ThreadPoolExecutor(concurrency) as pool:
            for part in parts:
                replies = list(pool.map(one, part["silt_key"]))
                yield pd.DataFrame({"silt_key": part["silt_key"], js: [r[0] for r in replies], st: [r[1] for r in replies]})

    keys = df.select(F.col(f"`{column}`").cast("string").alias("silt_key")).where("silt_key is not null").distinct()
    replies = keys.mapInPandas(ask, f"silt_key string, `{js}` string, `{st}` string")
    out = df.join(replies, F.col(f"`{column}`").cast("string") == F.col("silt_key"), "left").drop("silt_key")
    return out.withColumn(st, F.coalesce(F.col(f"`{st}`"), F.lit("miss")))
