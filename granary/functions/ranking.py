"""Ranks over whole tables without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored


def running(df: DataFrame, by: str, weight: str | None = None) -> DataFrame:
    """df with upto: the running sum of weight, or the row number, in the order of by.

    Rows are dealt to ranges of by and stored, as ranges are drawn from a sample; each range gets the sum of those before
    it, and windows run within ranges. Equal values share a range, so weighted tables should have one row a value.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.repartitionByRange(parts, by).withColumn("_p", F.spark_partition_id()), "ranges")
    size = F.sum(weight) if weight else F.count("*")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    offsets = dealt.groupBy("_p").agg(size.alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_before")
    within = Window.partitionBy("_p").orderBy(by)
    own = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(within)
    return dealt.withColumn("upto", own).join(F.broadcast(offsets), "_p").withColumn("upto", F.col("upto") + F.col("_before")).drop("_p", "_before")
