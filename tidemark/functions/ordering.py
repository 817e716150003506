"""Dense numbers for rows in a total order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import new_folder


def dense_numbers(df: DataFrame, order: list[str], out: str, within: list[str] | None = None, start: int = 0) -> DataFrame:
    """Add ``out``: start, start + 1, ... in the order of ``order``, which must be total.

    Within groups, the groups' rows are numbered by a window. Over all rows, the rows are dealt out by ranges of the order, numbered in
    each range, and shifted by what the ranges before hold: one row for each range meets the others.
    """
    if within:
        w = Window.partitionBy(*within).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) + F.lit(start - 1)).cast("long"))
    path = new_folder(df.sparkSession, "ranges")  # the ranges are cut from a sample: written once, they stay as they are when an executor is lost
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order)
    numbered = ranged.withColumn("__at", F.row_number().over(inside)).join(counts, "__part")
    return numbered.withColumn(out, (F.col("__before") + F.col("__at") + F.lit(start - 1)).cast("long")).drop("__part", "__n", "__at", "__before")


def latest(value: Column) -> Column:
    """The last value that is not null."""
    return F.last(value, ignorenulls=True)
