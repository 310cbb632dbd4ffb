"""De-duplication over a long run: the keys that were seen lie in buckets of their hash, and a batch reads its own buckets.

A stream's state of all keys would have to be in the store for ever. Here a batch's rows are compared with those files
only whose bucket its keys fall into, and the keys that are new become a file of each such bucket. The folders of a batch
are named by its number, so a batch that runs again replaces its own and is compared with the other batches' alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from .incremental import run_available

BUCKETS = 256


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def by_bucket(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows with the bucket of their keys."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def seen_in(spark: SparkSession, path: str, keys: T.StructType, buckets: list[int], number: int) -> DataFrame | None:
    """Keys of these buckets that other batches than ``number`` have seen; None before the first. The schema is given, so no other file is opened."""
    if not exists(spark, f"{path}/seen"):
        return None
    rows = spark.read.schema(T.StructType([*keys, T.StructField("_bucket", T.IntegerType()), T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/seen")
    return rows.where(F.col("_bucket").isin(buckets) & (F.col("_batch") != number))


def unseen(batch: DataFrame, path: str, keys: list[str], number: int, buckets: int = BUCKETS) -> DataFrame:
    """The batch's rows, one for each of its keys that no other batch has seen; null keys are keys like others."""
    spark = batch.sparkSession
    rows = written(by_bucket(batch.dropDuplicates(keys), keys, buckets), "seen-batch")
    touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most as many as there are buckets
    known = seen_in(spark, path, batch.select(*keys).schema, touched, number)
    if known is None:
        return rows
    known = known.select(F.col("_bucket").alias("_b"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col("_bucket") == F.col("_b"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    return rows.join(known, same, "left_anti")


def append_unseen(stream: DataFrame, path: str, checkpoint: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Runs a stream through; returns the table of first rows of each key."""
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        fresh = written(unseen(batch, path, keys, number, buckets), "seen-fresh")
        fresh.drop("_bucket").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        # rows before keys: a run that stops between the two writes its rows again
        marks = fresh.select(*keys, "_bucket", F.lit(number).alias("_batch")).repartition("_bucket")
        marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(f"{path}/seen")

    run_available(stream, checkpoint, each)
    return spark.read.parquet(f"{path}/rows").drop("batch")
