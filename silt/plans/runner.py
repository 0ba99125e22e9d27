"""Runs one SELECT over a logs DataFrame and lookup tables."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from silt.functions import scalar
from silt.plans import asof, pivot
from silt.plans.dialect import translate
from silt.schema import normalize_conflicts

LOGS = "logs"
QUOTED = "spark.sql.ansi.doubleQuotedIdentifiers"


class PlanError(ValueError):
    """A query that can't be planned over the tables given."""


def run_sql(sql: str, logs: DataFrame, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The rows of sql, where `logs` names the log rows and tables the lookup tables beside it.

    The names are this query's own: they are common table expressions before it, over views that no other query names and
    that go once it is analysed, so queries may run side by side. Conflict columns are flattened first; output names
    must differ.
    """
    tables = dict(tables or {})
    names = [n.lower() for n in tables]
    if LOGS in names:
        raise PlanError("the name logs is taken by the log rows")
    if twice := [n for n, k in Counter(names).items() if k > 1]:
        raise PlanError(f"two tables are called {twice[0]}")
    spark = logs.sparkSession
    if spark.conf.get(QUOTED, "false") != "true":
        spark.conf.set(QUOTED, "true")
    scalar.register(spark)
    named = {LOGS: normalize_conflicts(logs), **tables}
    sql, matches = asof.rewrite(sql, named)
    named |= matches
    views = {n: f"silt_{uuid.uuid4().hex}" for n in named}
    for name, df in named.items():
        df.createOrReplaceTempView(views[name])
    try:
        sql = pivot.rewrite(sql, lambda q: [r[0] for r in spark.sql(with_tables(translate(q), views)).collect()])
        out = spark.sql(with_tables(translate(sql), views))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    out = out.drop(asof.AT)
    if twice := [n for n, k in Counter(c.lower() for c in out.columns).items() if k > 1]:
        raise PlanError(f"two output columns are called {twice[0]}")
    return out.toDF(*out.columns)


def with_tables(sql: str, views: Mapping[str, str]) -> str:
    """A SELECT, which may have common table expressions of its own, with more of them for names that stand for views."""
    before = ", ".join(f'"{name}" AS (SELECT * FROM {view})' for name, view in views.items())
    own = re.match(r"\s*WITH\s+(?!RECURSIVE\b)", sql, re.I)
    if re.match(r"\s*WITH\b", sql, re.I):
        # Its own names come after, unless one of them hides a table.
        hides = any(re.search(rf'(?i)[\s,"]{re.escape(n)}"?\s*(?:\([^()]*\)\s*)?AS\s*\(', sql) for n in views)
        return f"WITH {before}, {sql[own.end() :]}" if own and not hides else f"WITH {before} SELECT * FROM ({sql})"
    return f"WITH {before} {sql}"


def validate_plan(spark: SparkSession, sql: str, schema: StructType, tables: Mapping[str, DataFrame] | None = None) -> StructType:
    """The output schema of sql over logs of a schema; only analysed, nothing runs."""
    return run_sql(sql, spark.createDataFrame([], schema), tables).schema


def with_columns(logs: DataFrame, names: list[str]) -> DataFrame:
    """logs with the columns that a query names and it lacks, as nulls."""
    have = {c.lower() for c in logs.columns}
    return logs.withColumns({n: F.lit(None).cast("string") for n in names if n.lower() not in have})
