"""Numbered states of a folder of files that are each written once.

A state is put in its place whole or not at all, and never over another, so of two writers that start from the same one
the second fails, what a failed writer left is never seen, and a reader keeps the state that it opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from mailquarry.operators.store import delete, exists, file_system


class Conflict(Exception):
    """Another writer was first."""


class Manifests:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/manifests"

    def _file(self, version: int) -> str:
        return f"{self.path}/{version:09d}.json"

    def versions(self) -> list[int]:
        place, system = file_system(self.spark, self.path)
        names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())

    def newest(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int | None = None) -> dict:
        version = self.newest() if version is None else version
        return json.loads(self.spark.read.text(self._file(version), wholetext=True).first()[0])

    def commit(self, version: int, state: dict) -> None:
        """Puts a state in its place, unless there is one."""
        jvm = self.spark._jvm.org.apache.hadoop
        own, system = file_system(self.spark, f"{self.path}/.{uuid.uuid4().hex}")
        out = system.create(own)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        place, _ = file_system(self.spark, self._file(version))
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.fs, "Options$Rename"), 0)
        try:
            jvm.fs.FileContext.getFileContext(system.getUri(), self.spark._jsc.hadoopConfiguration()).rename(own, place, never)
        except Exception as e:
            system.delete(own, False)
            if exists(self.spark, self._file(version)):
                raise Conflict(f"version {version} is there already") from e
            raise

    def forget(self, keep: int) -> list[dict]:
        """Deletes all states but the newest ones, which it returns."""
        versions = self.versions()
        for v in versions[:-keep]:
            delete(self.spark, self._file(v))
        return [self.read(v) for v in versions[-keep:]]


def delete_others(spark: SparkSession, folder: str, used: set[str]) -> None:
    """Deletes what a folder holds, but for some names."""
    place, system = file_system(spark, folder)
    for f in system.listStatus(place) if system.exists(place) else []:
        if f.getPath().getName() not in used:
            system.delete(f.getPath(), True)
