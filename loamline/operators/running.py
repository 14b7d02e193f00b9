"""Running sums over a whole table or large groups, without a task that sees a whole group.

Rows are dealt into ranges of (group, order); sums run within a range and group, the sums of ranges run over a small table
(a row for each range and group), and are joined back.  A group that holds a third of all rows lies in many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.shared import cut, small


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str = "upto") -> DataFrame:
    """``name``: the sum of ``value`` up to and with each row, within ``by`` (null is a group), by ``order``, which must not tie within a group."""
    keyed = df.withColumn("_v", value).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    keyed = cut(keyed)  # ranges are drawn anew when they are computed again
    sums = keyed.groupBy("_range", *by).agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = small(sums.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], (F.sum("_s").over(w) - F.col("_s")).alias("_before")))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inner = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed.withColumn("_in", F.sum("_v").over(inner)).join(before, same).withColumn(name, F.col("_before") + F.col("_in")).select(*df.columns, name)
