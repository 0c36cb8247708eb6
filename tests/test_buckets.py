"""Tables in buckets: what a batch rewrites, what a reader sees."""

import pytest
from mailquarry.operators.buckets import BucketedTable, upsert_messages
from mailquarry.operators.manifest import Conflict
from mailquarry.operators.store import merge_messages
from pyspark.sql.types import StructType

SCHEMA = StructType().add("id", "long").add("subject", "string").add("size", "long").add("spoof_flags", "integer").add("error", "string")


@pytest.fixture
def kept(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/t", SCHEMA, buckets=16)
    t.merge(spark.range(2000).selectExpr("id", "concat('s', id) subject", "id size", "CAST(id % 64 AS INT) spoof_flags", "CAST(NULL AS STRING) error"))
    return t


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_rewrites_only_its_buckets(spark, kept):
    old, before = kept.read(), kept.folders()
    batch = spark.createDataFrame([(3, None, 0, 1, None), (3000, "new", 9, 2, None)], SCHEMA)
    version = kept.merge(batch, upsert_messages)
    after = kept.folders()
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) <= 2
    want = rows(merge_messages(old, batch)) + [(3000, "new", 9, 2, None)]
    assert rows(kept.read()) == want and rows(kept.read(version - 1)) == rows(old)
    assert rows(BucketedTable(spark, kept.path).read()) == want


def test_replace_remove_and_lookup(spark, kept):
    kept.merge(spark.createDataFrame([(5, "other", 1, 0, "e")], SCHEMA))
    kept.remove(spark.createDataFrame([(6,), (99999,)], "id long"))
    assert rows(kept.lookup([5, 6, 7])) == [(5, "other", 1, 0, "e"), (7, "s7", 7, 7, None)]
    assert len(kept.lookup([5]).inputFiles()) <= 2 and kept.read().count() == 1999
    kept.vacuum(1)
    assert kept.read().count() == 1999 and len(kept.manifests.versions()) == 1
    version = kept.manifests.newest()
    assert kept.merge(spark.createDataFrame([], SCHEMA)) == version
    kept.remove(spark.range(0, 3000).toDF("id"))
    assert kept.read().count() == 0 and kept.folders() == {}


def test_failed_and_late_writers_leave_nothing(spark, kept, monkeypatch):
    before = rows(kept.read())

    def fails(old, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        kept.merge(spark.createDataFrame([(1, "x", 1, 1, None)], SCHEMA), fails)
    stale = kept.manifests.newest()
    kept.merge(spark.createDataFrame([(1, "first", 1, 1, None)], SCHEMA))
    with monkeypatch.context() as m:
        plain = kept.manifests.newest
        m.setattr(kept.manifests, "newest", lambda: stale)
        with pytest.raises(Conflict):
            kept.merge(spark.createDataFrame([(1, "late", 1, 1, None)], SCHEMA))
        assert plain() == stale + 1
    assert [r.subject for r in kept.lookup([1]).collect()] == ["first"] and len(rows(kept.read())) == len(before)


def test_new_tables_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        BucketedTable(spark, f"{tmp_path}/none")
    assert BucketedTable(spark, f"{tmp_path}/empty", SCHEMA).read().count() == 0
