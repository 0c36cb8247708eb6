"""The corpus pipeline: documents that can be told apart by language, once each, without near-copies and without
benchmark passages, packed into training windows.

Every stage works on all that its predecessor kept. Between stages the rows are written to the shared folder
and read again, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailquarry.llm import decontam, exact_dedup, langid, packing, simhash
from mailquarry.llm.common import new_path, shared_dir, table
from mailquarry.operators.store import delete, exists, passing

STAGES = [
    ("language_id", langid.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", simhash.stage),
    ("decontamination", decontam.stage),
    ("packing", packing.stage),
]

#: SQL has no centroids, sketches, alignment or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, job: str | None = None) -> DataFrame:
    """The pieces of all documents that the stages keep, as packing.pack() gives them.

    A stage's rows and what it kept on the way are deleted once its successor is written. With a name for the job, a run that
    was broken off goes on after the last stage that was written whole.
    """
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{job}" if job else new_path(spark, "pipeline")
    places = [f"{base}/{name}" for name, _ in STAGES[:-1]]
    done = max((k for k, place in enumerate(places) if exists(spark, f"{place}/_SUCCESS")), default=-1)
    for k in range(done + 1, len(places)):
        docs = spark.read.parquet(places[k - 1]) if k else table(spark, sf_dir, "documents")
        with passing(spark):
            STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(places[k])
        if k:
            delete(spark, places[k - 1])
    return STAGES[-1][1](spark, spark.read.parquet(places[-1]), sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
