"""Incremental, resumable processing: keyset pages, state, and streams of the same steps.

A stream's offsets and batch numbers are its checkpoint. A batch is written to a folder of its own number,
so a batch that is run again replaces itself: at-least-once runs give exactly-once tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dialogue as D
from ..functions import text


def next_page(rows: DataFrame, last: int = 0, failed: list[int] | None = None, limit: int | None = 500, key: str = "id") -> DataFrame:
    """Rows after the cursor and those that failed before, in order of their id; a top-k, not a full sort."""
    wanted = F.col(key) > last
    if failed:
        wanted = wanted | F.col(key).isin(failed)
    out = rows.where(wanted).orderBy(key)
    return out.limit(limit) if limit else out


# State: two cursors and the failed ids.

EMPTY_STATE = {"last_extracted_id": 0, "last_imported_id": 0, "failed_ids": []}


def migrated_state(stored: dict | None) -> dict:
    """A stored state in today's form; older ones had one cursor, or a list of all processed ids."""
    stored = stored or {}
    one = stored.get("last_processed_id") or max(stored.get("processed_ids") or [0])
    out = {k: stored.get(k, one) for k in ("last_extracted_id", "last_imported_id")}
    out["failed_ids"] = sorted(set(stored.get("failed_ids") or []))
    return out


def advanced_state(state: dict, outcome: dict) -> dict:
    """state after a page; outcome: max_id, failed and succeeded ids. Cursors never go back."""
    failed = (set(state["failed_ids"]) - set(outcome.get("succeeded", []))) | set(outcome.get("failed", []))
    cursor = max(state["last_extracted_id"], outcome.get("max_id") or 0)
    return {"last_extracted_id": cursor, "last_imported_id": max(state["last_imported_id"], cursor), "failed_ids": sorted(failed)}


def page_outcome(results: DataFrame, key: str = "id", success: str = "success") -> DataFrame:
    """One row: successes, failures, the largest id that succeeded."""
    return results.agg(F.count_if(success).alias("succeeded"), F.count_if(~F.col(success)).alias("failed"), F.max(F.when(F.col(success), F.col(key))).alias("max_id"))


# Streams.


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of a folder's (or one file's) Parquet; the pattern makes a single file a listing of one."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path[:-1] + f"[{path[-1]}]")


#: Files of a part that is added to a folder.
FILES = 4


def append_files(rows: DataFrame, path: str, keys: list[str], files: int = FILES) -> None:
    """Adds rows to a folder as some files, rows of equal keys in one, so that a stream of the folder takes them in one batch."""
    rows.repartition(files, *keys).write.mode("append").parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs what is there through ``each`` and ends; run again with the same checkpoint, it goes on from there."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def append_batches(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The stream's batches through ``step``, each in its own folder under path; returns the table."""

    def each(batch: DataFrame, number: int) -> None:
        out = step(batch) if step else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(stream, checkpoint, each)
    spark = stream.sparkSession
    return spark.read.parquet(path).drop("batch")


def without_repeats(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First row of each key; with an event time the state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if time else stream.dropDuplicates(keys)


def event_output(name: Column | None = None) -> list[Column]:
    """Columns of the output types chunk, tool_start, tool_end and tool_error, of raw agent events."""
    event = F.col("event")
    kind = F.when(event == "on_chat_model_stream", "chunk").when(event == "on_tool_start", "tool_start").when(event == "on_tool_end", "tool_end").when(event == "on_tool_error", "tool_error")
    return [
        kind.alias("type"),
        F.when(event != "on_chat_model_stream", F.col("name")).alias("name"),
        F.when(event == "on_chat_model_stream", F.col("content")).alias("content"),
        F.when(event == "on_tool_start", F.left(text.strip(F.col("query")), F.lit(240))).alias("cypher_preview"),
        F.when(event == "on_tool_end", D.output_preview(F.col("output"))).alias("output_preview"),
        F.when(event == "on_tool_error", F.coalesce("error", F.lit(""))).alias("error"),
    ]


def agent_events(events: DataFrame) -> DataFrame:
    """Output events of raw ones (thread, seq, event, name, query, output, error, content); stateless, for batch and stream."""
    out = events.select("thread", "seq", *event_output())
    return out.where(F.col("type").isNotNull() & ((F.col("type") != "chunk") | (F.coalesce("content", F.lit("")) != "")))


def text_events(events: DataFrame) -> DataFrame:
    return agent_events(events).where("type = 'chunk'").select("thread", "seq", "content")


def windowed_counts(events: DataFrame, time: str, width: str = "1 hour", delay: str = "1 day", keys: list[str] | None = None) -> DataFrame:
    """An addition: counts in tumbling windows of event time."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), *(keys or [])).agg(F.count("*").alias("cnt"))


def with_fallback(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks (thread, seq, content); a thread whose stream gave none gets its non-streaming result as the only one."""
    silent = results.join(chunks.select("thread").distinct(), "thread", "left_anti")
    return chunks.select("thread", "seq", "content").unionByName(silent.select("thread", F.lit(0).cast("long").alias("seq"), "content"))


def merge_thread_state(state: DataFrame | None, messages: DataFrame, keep: int = 6) -> DataFrame:
    """Per thread: number of messages, last seq, and the last ``keep`` messages, from the stored state and new messages."""
    tail = lambda c: F.slice(F.reverse(F.array_sort(c)), 1, keep)
    # the newest of the batch come first, so at most keep messages of a thread are collected
    newest = F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("seq")))
    ranked = messages.withColumn("_back", newest)
    kept = F.collect_list(F.when(F.col("_back") <= keep, F.struct("seq", "role", "content")))
    new = ranked.groupBy("thread").agg(F.count("*").alias("messages"), F.max("seq").alias("last_seq"), tail(kept).alias("tail"))
    if state is None:
        return new
    both = state.unionByName(new).groupBy("thread").agg(F.sum("messages").alias("messages"), F.max("last_seq").alias("last_seq"), tail(F.flatten(F.collect_list("tail"))).alias("tail"))
    return both


def clicked_cards(cards: DataFrame, per_page: int = 15, pages: int = 10) -> DataFrame:
    """Cards (keyword, page, pos, jid, ...) that a run by clicks takes: the first of each page up to an empty one, each id once a run.

    per_page and pages are the run's own limits; a page without cards ends its keyword.
    """
    gap = cards.select("keyword", "page").distinct()
    order = Window.partitionBy("keyword").orderBy("page")
    reached = gap.withColumn("nth", F.row_number().over(order)).where((F.col("nth") == F.col("page")) & (F.col("page") <= pages)).select("keyword", "page")
    taken = cards.where(F.col("pos") <= per_page).join(reached, ["keyword", "page"])
    first = Window.partitionBy("jid").orderBy("keyword", "page", "pos")
    return taken.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
