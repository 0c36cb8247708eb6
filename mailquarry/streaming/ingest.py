"""Incremental ingest: new message files since the last run, committed in small batches.

The stream's checkpoint knows which files are done. A batch is written under its own number, so a batch that
is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailquarry.sources.msg import parse_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, inbox: str, target: str, checkpoint: str, files_per_batch: int = 250, glob: str = "*.msg") -> int:
    """Parses the files below inbox that no earlier run has, and appends their messages to target. Returns the
    number of batches. Stops when there are no more new files."""
    new = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(inbox)

    def commit(batch: DataFrame, number: int) -> None:
        parse_files(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = new.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])


def ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)
