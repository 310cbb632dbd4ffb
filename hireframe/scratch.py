"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the setting is absent and there is one machine, as in tests."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = tempfile.mkdtemp(prefix="hireframe-")
        spark.sparkContext.setCheckpointDir(name)
    return name


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that a lost executor costs no recomputation.

    Columns without a type become text, as Parquet has no such columns.
    """
    df = df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema if isinstance(f.dataType, T.NullType)})
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
