"""Tables in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailquarry.operators.store import written


def ordered(df: DataFrame, *order: Column) -> DataFrame:
    """df written in a global order, with `at`: its upper bits number the file, the lower 33 the row in it.

    Rows are dealt by ranges of the whole order, so a key with many rows is spread as long as the order tells its rows apart.
    """
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))[0]


def file_of(at: Column) -> Column:
    return F.shiftright(at, 33)


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """What ordered() gives with each row's number in the whole order, from 0. One count a file is all that one task sees."""
    sizes = rows.groupBy(file_of(F.col("at")).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", before.alias("before"))
    met = rows.join(F.broadcast(starts), file_of(F.col("at")) == F.col("file"))
    return met.withColumn(name, F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")).drop("file", "before")
