"""Places and running sums over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.engine.session import Scratch


def running(df: DataFrame, order: list[str | Column], value: str | None = None) -> DataFrame:
    """``df`` with ``place_``, from 1, and ``before_``, the sum of ``value`` over the rows before, in an order that should
    tell all rows apart.

    Rows are sorted into ranges; a range is numbered by itself, and one row per range says what lies before it. Null
    values add nothing.
    """
    with Scratch(df.sparkSession) as scratch:
        part = F.spark_partition_id().alias("part_")
        ranged = scratch.keep(df.repartitionByRange(*order).select("*", part))
        amount = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
        totals = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.sum(amount).alias("v_"))
        # As many rows as there are ranges.
        earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select("part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("rows_"), F.coalesce(F.sum("v_").over(earlier), F.lit(0)).alias("sum_"))
        here = Window.partitionBy("part_").orderBy(*order)
        out = ranged.withColumn("place_", F.row_number().over(here)).withColumn("before_", F.coalesce(F.sum(amount).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        out = out.join(F.broadcast(starts), "part_")
        return scratch.hand_over(out.withColumn("place_", F.col("place_") + F.col("rows_")).withColumn("before_", F.col("before_") + F.col("sum_")).drop("part_", "rows_", "sum_"))
