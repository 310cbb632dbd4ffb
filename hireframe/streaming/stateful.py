"""State that a stream keeps itself: memories of threads and quotas of turns, in the state store, with a time to live.

A micro-batch touches the state of the keys it has rows of and no other; what it gives out are these keys' rows. The state
is part of the query's checkpoint: stopped and started again, it goes on from the last batch, and a batch that runs again
starts from the state before it. With a time to live, state of a key that has no rows for so long is dropped; such a query
asks for expired state batch after batch and never ends by itself, so it is for a stream that stays up.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import dialogue as D
from ..functions.guards import preflight
from ..operators.conversation import dedupe_key
from ..shipping import ship
from .incremental import run_available

# A processor is also asked for its state's schema by a process that has none of the files shipped, so it travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A time to live for streams that stay up: thirty days, in milliseconds.
KEEP_MS = 30 * 24 * 3600 * 1000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries that start within keep these settings; the session has its own again afterwards."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def state_partitions(spark: SparkSession, partitions: int | None = None):
    """The number of a query's state partitions, which its checkpoint fixes for good: by default as many as there are cores, at most the session's."""
    name = "spark.sql.shuffle.partitions"
    return settings(spark, {name: str(partitions or min(int(spark.conf.get(name)), spark.sparkContext.defaultParallelism))})


@contextmanager
def state_in_rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which state of several variables needs."""
    with settings(spark, dict([PROVIDER])), state_partitions(spark, partitions):
        yield


# Memories of threads.

MESSAGE = "seq bigint, role string, content string"


class ThreadMemory(StatefulProcessor):
    """Per thread the number of messages, the last seq, and the newest messages; gives the threads of the batch."""

    def __init__(self, keep: int, ttl_ms: int | None):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle) -> None:
        self.totals = handle.getValueState("totals", "messages bigint, last_seq bigint", self.ttl_ms)
        self.tail = handle.getListState("tail", MESSAGE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        n, last = self.totals.get() if self.totals.exists() else (0, None)
        tail = [tuple(m) for m in self.tail.get()] if n else []
        for frame in rows:
            n += len(frame)
            tail += zip(frame["seq"].tolist(), frame["role"].tolist(), frame["content"].tolist(), strict=True)
            tail = heapq.nlargest(self.keep, tail, key=lambda m: (m[0], m[1] or "", m[2] or ""))
            last = max(x for x in (last, int(frame["seq"].max())) if x is not None)
        self.totals.update((n, last))
        self.tail.put(tail)
        messages = [dict(zip(("seq", "role", "content"), m, strict=True)) for m in tail]
        yield pd.DataFrame({"thread": [key[0]], "messages": [n], "last_seq": [last], "tail": [messages]})


def thread_memories(messages: DataFrame, keep: int = 6, ttl_ms: int | None = None) -> DataFrame:
    """A stream of messages (thread, seq, role, content; seq is never null) as a stream of the threads' states."""
    ship(messages.sparkSession)
    rows = messages.select(F.col("thread").cast("long"), F.col("seq").cast("long"), "role", "content")
    return rows.groupBy("thread").transformWithStateInPandas(ThreadMemory(keep, ttl_ms), f"thread bigint, messages bigint, last_seq bigint, tail array<struct<{MESSAGE.replace(' ', ':').replace(',:', ',')}>>", "Update", "ProcessingTime" if ttl_ms else "None")


def thread_state(stream: DataFrame, path: str, checkpoint: str, keep: int = 6) -> DataFrame:
    """Runs a stream of messages that are there through the memories and returns each thread's; run again, it goes on.

    A batch writes the states of its own threads, in a folder of its number; older ones of the same threads are passed over.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_in_rocksdb(spark):
        run_available(thread_memories(stream, keep), checkpoint, each, "update")
    return latest(spark.read.parquet(path))


def latest(changes: DataFrame, key: str = "thread") -> DataFrame:
    """The newest of each key's states, of a table of states by batch."""
    rest = [c for c in changes.columns if c not in (key, "batch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(key, "_s.*")


# Quotas of turns.


class TurnQuota(StatefulProcessor):
    """Decides the calls of a turn, in order of seq, by the turn's counters and the queries it has seen."""

    def __init__(self, hard: int, errors: int, rounds: int, ttl_ms: int | None):
        self.hard, self.errors, self.rounds, self.ttl_ms = hard, errors, rounds, ttl_ms

    def init(self, handle) -> None:
        # one value, so that a turn costs one read and one write of the store however many calls it has
        self.turn = handle.getValueState("turn", "used bigint, round_trips bigint, errors bigint, seen array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        used, trips, faults, before = self.turn.get() or (0, 0, 0, [])
        seen, out, calls = set(before), [], []
        for frame in rows:
            calls += zip(*(frame[c].tolist() for c in ("seq", "key", "kind", "answered", "trip", "fault")), strict=True)
        calls.sort(key=lambda x: x[0])  # a turn's calls of one batch
        for seq, query, kind, answered, trip, fault in calls:
            again = query in seen
            if used >= self.hard:
                decision = "hard_cap"
            elif again:
                decision = "duplicate"
            elif faults >= self.errors:
                decision = "preflight_cap"
            elif kind != "ok":
                decision = kind
            else:
                decision = "round_cap" if trips >= self.rounds else "execute"
            seen.add(query)
            out.append((seq, decision))
            used, trips, faults = used + answered, trips + trip, faults + fault
        # beyond the hard cap no decision asks for what was seen
        self.turn.update((used, trips, faults, [] if used >= self.hard else sorted(seen)))
        yield pd.DataFrame({"thread": key[0], "turn_no": key[1], "seq": [s for s, _ in out], "decision": [d for _, d in out]})


def online_quota(calls: DataFrame, hard: int = 12, errors: int = 2, rounds: int = 5, ttl_ms: int | None = None) -> DataFrame:
    """A stream of calls (thread, turn_no, seq, query, result) as a stream of their decisions.

    A turn's calls come in order of seq from batch to batch, as a log gives them; within a batch they are put in order.
    """
    ship(calls.sparkSession)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = calls.select(
        F.col("thread").cast("long"),
        F.col("turn_no").cast("long"),
        F.col("seq").cast("long"),
        F.coalesce(dedupe_key(F.col("query")), F.lit("")).alias("key"),
        preflight(F.col("query")).alias("kind"),
        flag(F.col("result").isNotNull()).alias("answered"),
        flag(D.is_round_trip(F.col("result"))).alias("trip"),
        flag(D.is_preflight_error(F.col("result"))).alias("fault"),
    )
    return rows.groupBy("thread", "turn_no").transformWithStateInPandas(TurnQuota(hard, errors, rounds, ttl_ms), "thread bigint, turn_no bigint, seq bigint, decision string", "Append", "ProcessingTime" if ttl_ms else "None")


# Calls and their results.


def paired_streams(starts: DataFrame, ends: DataFrame, keys: list[str], within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Each start (keys, started, ..) with the ends (keys, ended, ..) that follow it within a time; a start without any has nulls.

    Rows may come ``late``; beyond it, the state of both sides is dropped, and starts without an end are given out, in the
    batch after the one whose times passed them. Rows with a null key move no watermark.
    """
    a = starts.withWatermark("started", late).select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[c for c in starts.columns if c not in keys])
    b = ends.withWatermark("ended", late).select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[c for c in ends.columns if c not in keys])
    same = [F.col(f"_a_{k}") == F.col(f"_b_{k}") for k in keys]
    near = (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {within}"))
    both = a.join(b, [*same, near], "left_outer")
    return both.drop(*[f"_b_{k}" for k in keys]).withColumnsRenamed({f"_a_{k}": k for k in keys})
