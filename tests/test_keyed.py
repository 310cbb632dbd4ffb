"""Keyed updates write the buckets that change; the city dimension is cleaned by one, or shown what would be."""

import pytest
from pyspark.sql import functions as F

from hireframe.operators import keyed


def files(spark, path):
    return {f for f in spark.read.parquet(path).inputFiles()}


def bucket_of(name):
    return int(name.split("_bucket=")[1].split("/")[0])


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, f"n{i}", i * 2 if i % 3 else None) for i in range(200)] + [(None, "none", 1)]
    keyed.save_bucketed(spark.createDataFrame(rows, "id long, name string, n int"), path, "id", buckets=8)
    return path, rows


def test_only_changed_buckets_are_written(spark, stored):
    path, rows = stored
    before = files(spark, path)
    changes = spark.createDataFrame([(5, None, 99), (6, "n6", None), (7, "seven", None), (7000, "x", 1), (None, "y", 2)], "id long, name string, n long")
    shown = keyed.update_bucketed(spark, path, changes, "id", dry_run=True)
    assert files(spark, path) == before
    wanted = [(5, "n5", "n5", 10, 99), (7, "n7", "seven", 14, 14)]
    assert sorted(tuple(r) for r in shown.collect()) == wanted
    changed = keyed.update_bucketed(spark, path, changes, "id")
    assert sorted(tuple(r) for r in changed.collect()) == wanted
    hit = {r["b"] for r in spark.createDataFrame([(5,), (7,)], "id long").select(keyed.bucket("id", 8).alias("b")).collect()}
    after = files(spark, path)
    assert {f for f in before if bucket_of(f) not in hit} == {f for f in after if bucket_of(f) not in hit}
    assert not {f for f in before if bucket_of(f) in hit} & after
    want = [(i, {7: "seven"}.get(i, name), {5: 99}.get(i, n)) for i, name, n in rows]
    assert sorted(map(repr, (tuple(r) for r in keyed.read_bucketed(spark, path).collect()))) == sorted(map(repr, want))


def test_nothing_to_change(spark, stored):
    path, rows = stored
    before = files(spark, path)
    none = spark.createDataFrame([], "id long, name string")
    assert keyed.update_bucketed(spark, path, none, "id").count() == 0
    assert keyed.update_bucketed(spark, path, spark.createDataFrame([(1, "n1")], "id long, name string"), "id").count() == 0
    assert files(spark, path) == before and keyed.read_bucketed(spark, path).count() == len(rows)


def test_changes_are_read_by_bucket(spark, stored):
    path, _ = stored
    plan = spark.read.parquet(path).where(F.col("_bucket").isin([1]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[1][:200]


def test_dimension(spark, tmp_path):
    path = str(tmp_path / "cities")
    keyed.save_bucketed(spark.createDataFrame([("武汉", '"湖北"'), ("北京", "北京市"), ("x", "火星"), ("y", None)], "short_name string, full_name string"), path, "short_name", buckets=4)
    before = files(spark, path)
    shown = [("北京", "北京市", "北京"), ("武汉", '"湖北"', "湖北省")]
    assert sorted(tuple(r) for r in keyed.clean_dimension(spark, path).collect()) == shown and files(spark, path) == before
    assert sorted(tuple(r) for r in keyed.clean_dimension(spark, path, dry_run=False).collect()) == shown
    assert {tuple(r) for r in keyed.read_bucketed(spark, path).collect()} == {("武汉", "湖北省"), ("北京", "北京"), ("x", "火星"), ("y", None)}
