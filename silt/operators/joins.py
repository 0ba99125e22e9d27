"""Joins that SQL has no words for here: as-of, and address in range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], prefix: str = "right_", how: str = "left") -> DataFrame:
    """Each row of left with right's latest row of equal `by` whose `on` is not later.

    Both sides go through one window over (by) in order of `on`: one shuffle, no pairs. Right's columns but `by` get
    the prefix; right's row at the same time as left's counts as not later. Of right's rows with equal `on`, the
    greatest by the other columns is taken.
    """
    rest = [c for c in right.columns if c not in by]
    there = F.struct(*[F.col(f"`{c}`") for c in [on, *[c for c in rest if c != on]]])
    r = right.select(*by, F.col(on).alias("silt_on"), there.alias("silt_right"), F.lit(0).alias("silt_side"), F.lit(None).alias("silt_left"))
    here = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    lt = left.select(*by, F.col(on).alias("silt_on"), F.lit(None).alias("silt_right"), F.lit(1).alias("silt_side"), here.alias("silt_left"))
    both = r.withColumn("silt_left", F.lit(None).cast(lt.schema["silt_left"].dataType)).unionByName(
        lt.withColumn("silt_right", F.lit(None).cast(r.schema["silt_right"].dataType)))
    w = Window.partitionBy(*by).orderBy("silt_on", "silt_side", "silt_right").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("silt_met", F.last("silt_right", ignorenulls=True).over(w)).where("silt_side = 1")
    if how == "inner":
        met = met.where("silt_met is not null")
    return met.select("silt_left.*", *[F.col(f"silt_met.`{c}`").alias(f"{prefix}{c}") for c in rest])


def range_join(left: DataFrame, value: Column, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Left rows with the rows of ranges that hold the value, ends included, by an equi-join on cells of `width`.

    A range is copied to each cell it meets, so choose a width near the ranges' own; value and bounds are integers.
    """
    cells = ranges.withColumn("silt_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    keyed = left.withColumn("silt_value", value).withColumn("silt_cell", F.floor(F.col("silt_value") / width))
    cells = cells.withColumnRenamed("silt_cell", "silt_range_cell")
    met = (F.col("silt_cell") == F.col("silt_range_cell")) & F.col("silt_value").between(F.col(low), F.col(high))
    return keyed.join(cells, met, "left").drop("silt_cell", "silt_range_cell", "silt_value")
