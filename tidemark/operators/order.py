"""The row before, where one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, key: str, order: str, column: str, into: str, width: int = 4096) -> DataFrame:
    """rows with the column of the row before (by order, a distinct whole number) of the same key; null for the first.

    A key's rows are cut by ranges of the order, so that no task sorts a whole key; only the last row of each range is
    carried over to the first row of the key's next one.
    """
    cut = rows.withColumn("__range", F.floor(F.col(order) / width))
    part = Window.partitionBy(key, "__range").orderBy(order)
    inside = cut.withColumn(into, F.lag(column).over(part)).withColumn("__first", F.row_number().over(part) == 1)
    lasts = cut.groupBy(key, "__range").agg(F.max_by(column, order).alias("__last"))
    carried = lasts.withColumn("__carried", F.lag("__last").over(Window.partitionBy(key).orderBy("__range"))).select(F.col(key).alias("__key"), F.col("__range").alias("__at"), "__carried")
    joined = inside.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at")), "left")
    return joined.withColumn(into, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col(into))).drop("__range", "__first", "__key", "__at", "__carried")
