"""A join that survives hot keys, for a table with one row a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import shuffle_partitions


def join_unique(big: DataFrame, small: DataFrame, key: str, rows: str, total: int, how: str = "left") -> DataFrame:
    """big with the columns of small, which has one row for each key and in `rows` how many rows of big have it.

    Keys that hold more than 1/(2P) of the `total` rows, P being the shuffle partitions, are at most 2P in number;
    they are broadcast, so rows of big with such a key stay where they are. The other keys are joined by a shuffle in
    which no key is hot; there the rows of hot keys travel under a null key, spread by a random-looking salt of theirs.
    how: left or inner. Null keys match nothing. small is read twice: cut its lineage first if it is dear.
    """
    limit = max(100, total // (2 * shuffle_partitions(big.sparkSession)))
    cols = [c for c in small.columns if c != key]
    hot = small.where(F.col(rows) > limit).select(F.col(key).alias("silt_hot"), F.struct(*cols).alias("silt_hot_row"))
    cold = small.where(F.col(rows) <= limit).select(F.col(key).alias("silt_cold"), F.struct(*cols).alias("silt_cold_row"))
    out = big.join(F.broadcast(hot), F.col(key) == F.col("silt_hot"), "left")
    is_hot, spread = F.col("silt_hot").isNotNull(), F.xxhash64(*_hashable(big)).cast(big.schema[key].dataType)
    out = out.withColumn("silt_key", F.when(is_hot, spread).otherwise(F.col(key)))
    out = out.join(cold, (F.col("silt_key") == F.col("silt_cold")) & ~is_hot, "left")
    out = out.withColumn("silt_row", F.coalesce("silt_hot_row", "silt_cold_row"))
    if how == "inner":
        out = out.where(F.col("silt_row").isNotNull())
    return out.select(*big.columns, *[F.col(f"silt_row.{c}").alias(c) for c in cols])


def _hashable(df: DataFrame) -> list[Column]:
    plain = ("bigint", "int", "string", "smallint", "tinyint", "double", "boolean")
    return [F.col(c) for c, kind in df.dtypes if kind in plain] or [F.lit(0)]
