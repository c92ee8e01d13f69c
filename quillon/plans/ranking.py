"""Global ranks and running sums without gathering all rows in one task.

Rows are sorted into ranges and written once; a row's place is then its place in its range plus the rows
of the ranges before it, of which there is one small row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: monotonically_increasing_id keeps the row's place in its partition in the low 33 bits.
_LOW = (1 << 33) - 1


def _sorted(rows: DataFrame, order: list) -> DataFrame:
    ranges = rows.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)))
    return staged(ranges, "sorted")


def _before(rows: DataFrame, value: Column) -> DataFrame:
    """(_range, _before): the sum over all earlier ranges; one row for each range."""
    sums = rows.groupBy("_range").agg(F.sum(value).alias("s"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("_before"))


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Rows with their place in the order, from 1."""
    found = _sorted(rows, order)
    return found.join(F.broadcast(_before(found, F.lit(1))), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def tied(rows: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Rows with the competition rank of a value, highest first: equal values share the first one's place."""
    places = ranked(rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), [F.desc(column)], "_order")
    found = _sorted(places, ["_order"])
    earlier = Window.partitionBy("_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    first = found.withColumn("_inside", inside).join(F.broadcast(_before(found, F.col("_n"))), "_range").select(column, (F.col("_before") + F.col("_inside") + 1).alias(name))
    return rows.join(first, column)


def running(rows: DataFrame, order: list, value: str, name: str = "total") -> DataFrame:
    """Rows with the sum of a value up to and with each row, and their place as ``rank``."""
    found = _sorted(rows, order)
    upto = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_inside", F.sum(value).over(upto))
    counts = _before(found, F.lit(1)).withColumnRenamed("_before", "_rows")
    sums = _before(found, F.col(value))
    out = found.join(F.broadcast(counts), "_range").join(F.broadcast(sums), "_range")
    return out.withColumn("rank", F.col("_rows") + F.col("_at") + 1).withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_at", "_inside", "_rows", "_before")
