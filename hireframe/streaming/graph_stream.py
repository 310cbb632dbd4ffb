"""The resumable graph build: a stream of listings to stored nodes and edges.

Each micro-batch is turned into documents, extracted, cleaned and loaded against what is stored. Its rows go
to a folder of the batch's number, so a batch that runs again replaces its own rows; what other batches
stored is excluded by anti-joins, so a node's first writer stays. Documents whose extraction failed go to a
side table, from which a later run takes them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators import extraction as X
from ..operators import graph as G
from ..scratch import written
from .incremental import run_available


def stored(spark: SparkSession, path: str, kind: str, but: int | None = None) -> DataFrame:
    """Stored nodes or edges of all batches, or of all but one; an empty table before the first."""
    tables = {"nodes": schema.nodes(), "edges": schema.edges(), "failed": schema.struct("id long, error_msg string")}
    columns = tables[kind].add("batch", T.IntegerType())
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], columns).drop("batch")
    rows = spark.read.schema(columns).parquet(f"{path}/{kind}")
    return (rows if but is None else rows.where(F.col("batch") != but)).drop("batch")


def load_batch(spark: SparkSession, path: str, number: int, extracted: DataFrame) -> None:
    """Stores a batch's nodes, edges and failures."""
    extracted = written(extracted, "graph-extracted")
    nodes, edges = X.graph_rows(extracted.where("success"))
    nodes = written(nodes, "graph-nodes")
    known = stored(spark, path, "nodes", but=number)
    fresh = nodes.join(known.select("id"), "id", "left_anti")
    ends = known.select("id").unionByName(fresh.select("id"))
    links = G.new_edges(edges, ends, stored(spark, path, "edges", but=number))
    # edges before nodes would dangle if the run stopped between the two
    fresh.write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")
    links.write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
    extracted.where("NOT success").select("id", "error_msg").write.mode("overwrite").parquet(f"{path}/failed/batch={number}")


def build_graph(listings: DataFrame, path: str, checkpoint: str, extractor: Callable = X.rule_based) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of listings that are there into the graph under path; returns (nodes, edges). Run again, it goes on."""
    spark = listings.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        load_batch(spark, path, number, X.extract(X.read_by(X.documents(batch), extractor), extractor))

    run_available(listings, checkpoint, each)
    return stored(spark, path, "nodes"), stored(spark, path, "edges")


def retry_failed(listings: DataFrame, path: str, number: int, extractor: Callable = X.rule_based) -> None:
    """Extracts the stored failures again, as a batch of its own (give it a number no stream uses, such as -1)."""
    spark = listings.sparkSession
    failed = written(stored(spark, path, "failed").select("id").distinct(), "graph-failed")
    load_batch(spark, path, number, X.extract(X.read_by(X.documents(listings.join(failed, "id", "left_semi")), extractor), extractor))
