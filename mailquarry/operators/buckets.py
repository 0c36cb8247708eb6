"""A table in buckets by a hash of its key, updated by rewriting only the buckets that a batch meets.

A batch reads and writes its rows' buckets to a new folder; a manifest then names, for each bucket, the folder that has it. A point lookup reads
the buckets of its keys. With as many buckets as make one some tens of MB, what a batch of 250 rows costs doesn't grow with the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailquarry.operators.manifest import Manifests, delete_others
from mailquarry.operators.store import merge_messages, replace_by_key

#: From the old rows of some buckets and a batch to their new rows.
Rule = Callable[[DataFrame, DataFrame], DataFrame]


def upsert_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new merged in by the rules for messages, and the rows of new that old doesn't have."""
    fresh = new.join(old.select("id"), "id", "left_anti")
    return merge_messages(old, new).unionByName(fresh, allowMissingColumns=True)


class BucketedTable:
    """A table at a shared path. schema, key and buckets belong to it and are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None, key: str = "id", buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)
        if self.manifests.newest() is None:
            if schema is None:
                raise ValueError("a new table needs a schema")
            self.manifests.commit(0, {"schema": schema.json(), "key": key, "buckets": buckets, "folders": {}})
        first = self.manifests.read()
        self.key, self.buckets = first["key"], first["buckets"]
        self.schema = StructType.fromJson(json.loads(first["schema"]))

    def bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def folders(self, version: int | None = None) -> dict[int, str]:
        return {int(k): v for k, v in self.manifests.read(version)["folders"].items()}

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table as of a version, or some of its buckets."""
        places = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in self.folders(version).items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: list) -> DataFrame:
        """Rows of some keys; only their buckets are read."""
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        met = {r.b for r in asked.select(self.bucket(F.col(self.key).cast(kind)).alias("b")).distinct().collect()}
        return self.read(buckets=met).join(F.broadcast(asked.distinct()), self.key, "left_semi")

    def merge(self, batch: DataFrame, rule: Rule | None = None) -> int:
        """The version with a batch merged in; by default its rows take the place of those with the same key."""
        rule = rule or (lambda old, new: replace_by_key(old, new, self.key))
        return self._rewrite(batch, rule)

    def remove(self, keys: DataFrame) -> int:
        return self._rewrite(keys.select(self.key), lambda old, gone: old.join(gone, self.key, "left_anti"))

    def _rewrite(self, batch: DataFrame, rule: Rule) -> int:
        state = self.manifests.read()
        # at most as many numbers as there are buckets
        met = {r.b for r in batch.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()}
        if not met:
            return self.manifests.newest()
        version, folder = self.manifests.newest(), uuid.uuid4().hex
        new = rule(self.read(version, met), batch).select(*self.schema.names).withColumn("bucket", self.bucket(F.col(self.key)))
        new.repartition(min(len(met), 4096), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        left = {r.bucket for r in self.spark.read.schema("bucket int").parquet(f"{self.path}/data/{folder}").select("bucket").distinct().collect()}
        folders = {b: f for b, f in self.folders(version).items() if b not in met} | {b: folder for b in left}
        self.manifests.commit(version + 1, state | {"folders": folders})
        return version + 1

    def vacuum(self, keep: int = 2) -> None:
        """Deletes old versions and what only they name. Only for times without writers."""
        delete_others(self.spark, f"{self.path}/data", {f for state in self.manifests.forget(keep) for f in state["folders"].values()})
