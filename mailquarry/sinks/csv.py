"""CSV exports: UTF-8 with a byte order mark, semicolons, a heading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.operators.labels import BOM, HEADINGS, csv_line


def export_results(results: DataFrame, path: str, zone: str = "UTC") -> None:
    """Result rows, in their order, as one file in the folder `path`. One task writes, since it is one file for one reader."""
    head = results.sparkSession.createDataFrame([(BOM + HEADINGS, -1)], "value string, place long")
    lines = results.select(csv_line(zone).alias("value"), F.monotonically_increasing_id().alias("place"))
    head.union(lines).coalesce(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)
