"""Tables stored in buckets of their key, and updates that write those buckets only that hold a row that changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from .quality import clean_cities

BUCKETS = 64
LAYOUT = ["_of", "_bucket"]


def bucket(key: str, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def save_bucketed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Stores df by buckets of its key; their number is part of the layout, so readers need not know it."""
    rows = df.withColumns({"_of": F.lit(buckets), "_bucket": bucket(key, buckets)})
    rows.repartition("_bucket").write.mode("overwrite").partitionBy(*LAYOUT).parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(*LAYOUT)


def update_bucketed(spark: SparkSession, path: str, changes: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """Keyed UPDATE: non-null values of changes (unique keys) replace those of the same key. Returns (key, old and new values) of the rows that differ.

    Only the buckets of the changes' keys are read, and only those with a differing row are written, over their old
    files; all other files stay as they are. What is written is staged first, so a run that fails can run again. A dry
    run writes nothing. Keys that the table has not are left out.
    """
    stored = spark.read.parquet(path)
    of = stored.select("_of").first()
    if of is None:
        return changes.limit(0).select(key)
    fields = [c for c in changes.columns if c != key and c in stored.columns]
    asked = changes.select(bucket(key, of[0]).alias("_bucket"), F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{i}") for i, c in enumerate(fields)])
    asked = written(asked, "update-asked")
    touched = sorted(r[0] for r in asked.select("_bucket").distinct().collect())  # at most the number of buckets
    known = stored.where(F.col("_bucket").isin(touched))
    both = known.join(asked.drop("_bucket"), F.col(key) == F.col("_key"), "left")
    differs = [F.col(f"_new_{i}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_new_{i}")) for i, c in enumerate(fields)]
    both = both.withColumn("_differs", reduce(Column.__or__, differs, F.lit(False)))
    shown = [x for i, c in enumerate(fields) for x in (F.col(c).alias(f"old_{c}"), F.coalesce(f"_new_{i}", c).alias(f"new_{c}"))]
    changed = written(both.where("_differs").select(key, "_bucket", *shown), "update-changed")
    hit = sorted(r[0] for r in changed.select("_bucket").distinct().collect())
    if hit and not dry_run:
        new = both.where(F.col("_bucket").isin(hit)).withColumns({c: F.coalesce(f"_new_{i}", c).cast(stored.schema[c].dataType) for i, c in enumerate(fields)})
        staged = written(new.select(*stored.columns), "update-staged")
        staged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)
    return changed.drop("_bucket")


def clean_dimension(spark: SparkSession, path: str, dry_run: bool = True) -> DataFrame:
    """Cleans full_name of the stored city dimension (short_name, full_name); returns what changes, which a dry run only shows."""
    found = clean_cities(read_bucketed(spark, path)).where("changed").select("short_name", F.col("cleaned").alias("full_name"))
    return update_bucketed(spark, path, found, "short_name", dry_run)
