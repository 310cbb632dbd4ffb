"""Streams that keep state: resumed in the middle, they give what the batch rules give; de-duplication reads its buckets only."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from hireframe.operators import conversation
from hireframe.streaming import incremental, seen, stateful


@pytest.fixture
def paths(tmp_path):
    return [str(tmp_path / x) for x in ("source", "out", "mark")]


def rows_of(df):
    return sorted(map(repr, (r.asDict(True) for r in df.collect())))


def test_thread_memory_resumes(spark, paths):
    source, out, mark = paths
    rng = random.Random(1)
    data = [(rng.randint(0, 9), seq, rng.choice(["user", "tool"]), rng.choice(["x", "", None, "é" * 9])) for seq in range(120)]
    rng.shuffle(data)
    parts = [data[:50], data[50:90], [m for m in data[90:] if m[0] < 3]]
    frames = [spark.createDataFrame(p, "thread long, seq long, role string, content string") for p in parts]
    for k, frame in enumerate(frames):
        incremental.append_files(frame, source, ["thread"], 2)
        if k:
            state = stateful.thread_state(incremental.parquet_stream(spark, source, 2), out, mark, 4)
    batch = incremental.merge_thread_state(None, frames[0].union(frames[1]).union(frames[2]), keep=4)
    assert rows_of(state) == rows_of(batch)
    # the last batch wrote the threads that it had rows of, and no other
    last = max(glob.glob(f"{out}/batch=*"), key=lambda p: int(p.rsplit("=", 1)[1]))
    assert {r["thread"] for r in spark.read.parquet(last).collect()} <= {0, 1, 2}


def test_thread_memory_is_dropped_after_its_time(spark, paths):
    """A stream that stays up: the second message finds no memory of the first any more."""
    source, _, mark = paths
    message = lambda k: incremental.append_files(spark.createDataFrame([(1, k, "user", "x")], "thread long, seq long, role string, content string"), source, ["thread"], 1)
    message(0)
    got = []
    with stateful.state_in_rocksdb(spark):
        memories = stateful.thread_memories(incremental.parquet_stream(spark, source), 4, ttl_ms=1)
        query = memories.writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(lambda b, _: got.extend(b.collect())).start()
        try:
            for k in range(2):
                until = time.monotonic() + 40
                while len(got) <= k and time.monotonic() < until:
                    time.sleep(0.2)
                if k == 0:
                    message(1)
        finally:
            query.stop()
    assert [(r["messages"], r["last_seq"]) for r in got[:2]] == [(1, 0), (1, 1)]


def test_online_quota_equals_batch(spark, paths):
    source, out, mark = paths
    rng = random.Random(2)
    queries = ["MATCH (n) RETURN n", " MATCH  (n) RETURN n ", "", None, "SHOW DATABASES", "MATCH (n) DELETE n", *[f"MATCH (n{i}) RETURN n{i}" for i in range(12)]]
    results = ['[{"n": 1}]', "查询失败: x", "【参数错误】x", None, "", "other"]
    data = [(rng.randint(0, 3), seq // 60, seq, rng.choice(queries), rng.choice(results[:3] if seq % 60 < 30 else results)) for seq in range(240)]
    calls = spark.createDataFrame(data, "thread long, turn_no long, seq long, query string, result string")
    for k in range(4):
        incremental.append_files(calls.where((F.col("seq") >= k * 50) & (F.col("seq") < (k + 1) * 50 if k < 3 else F.lit(True))), source, ["thread", "turn_no"], 2)
        if k % 2:
            with stateful.state_in_rocksdb(spark):
                got = incremental.append_batches(stateful.online_quota(incremental.parquet_stream(spark, source, 2)), out, mark)
    want = conversation.quota_decisions(calls).select("thread", "turn_no", "seq", "decision")
    assert rows_of(got) == rows_of(want)
    assert {r["decision"] for r in got.collect()} >= {"hard_cap", "duplicate", "preflight_cap", "execute"}


def test_paired_streams_equal_batch(spark, paths):
    source, out, mark = paths
    rng = random.Random(3)
    events = sorted((rng.randint(0, 50_000), rng.choice("abc"), rng.choice(["start", "end"])) for _ in range(300))
    events = [(n, *e) for n, e in enumerate(events)] + [(None, s, "mark", kind) for s in (200_000, 400_000) for kind in ("start", "end")]
    frame = spark.createDataFrame(events, "n long, s long, key string, kind string").withColumn("at", F.timestamp_seconds("s"))
    for low, high in ((0, 20_000), (20_000, 100_000), (100_000, 300_000), (300_000, 500_000)):
        incremental.append_files(frame.where((F.col("s") >= low) & (F.col("s") < high)), source, ["kind"], 2)
        if low >= 100_000:  # the marks come in batches of their own: the watermark of one counts in the next
            stream = incremental.parquet_stream(spark, source, 2)
            starts = stream.where("kind = 'start'").select("key", F.col("n").alias("a"), F.col("at").alias("started"))
            ends = stream.where("kind = 'end'").select("key", F.col("n").alias("b"), F.col("at").alias("ended"))
            got = incremental.append_batches(stateful.paired_streams(starts, ends, ["key"], "10 minutes", "10 minutes"), out, mark)
    got = sorted((r["a"], -1 if r["b"] is None else r["b"]) for r in got.collect() if r["a"] is not None)
    want = []
    for n, s, key, kind in events:
        if kind == "start" and n is not None:
            found = [m for m, t, other, k in events if k == "end" and other == key and s <= t <= s + 600]
            want += [(n, m) for m in found] or [(n, -1)]
    assert got == sorted(want) and any(b == -1 for _, b in got) and any(b >= 0 for _, b in got)


def test_unseen_reads_the_buckets_it_touches(spark, paths):
    source, out, mark = paths
    columns = "k string, v long"
    first = spark.createDataFrame([(f"k{i % 40}", i) for i in range(100)] + [(None, 1000)], columns)
    incremental.append_files(first, source, ["k"], 2)
    table = seen.append_unseen(incremental.parquet_stream(spark, source, 2), out, mark, ["k"], buckets=16)
    assert sorted(r["k"] or "" for r in table.collect()) == sorted([f"k{i}" for i in range(40)] + [""])
    more = spark.createDataFrame([("k1", 1), ("k2", 2), ("new", 3), (None, 4)], columns)
    touched = {r["_bucket"] for r in seen.by_bucket(more, ["k"], 16).collect()}
    spoilt = [p for p in glob.glob(f"{out}/seen/_bucket=*/*/*.parquet") if int(p.split("_bucket=")[1].split("/")[0]) not in touched]
    assert spoilt
    for p in spoilt:  # files of other buckets are no Parquet any more: a batch that read them would fail
        with open(p, "wb") as f:
            f.write(b"no parquet")
        crc = os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    incremental.append_files(more, source, ["k"], 2)
    table = seen.append_unseen(incremental.parquet_stream(spark, source, 2), out, mark, ["k"], buckets=16)
    assert sorted(r["k"] or "" for r in table.collect()) == sorted([f"k{i}" for i in range(40)] + ["", "new"])


def test_unseen_replaces_a_batch_that_runs_again(spark, paths):
    _, out, _ = paths
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long")

    def run():
        fresh = seen.unseen(rows, out, ["k"], 0, 4)
        marks = fresh.select("k", "_bucket", F.lit(0).alias("_batch"))
        marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(f"{out}/seen")
        return sorted(r["k"] for r in fresh.collect())

    assert run() == run() == ["a", "b"]
    assert seen.unseen(rows, out, ["k"], 1, 4).count() == 0
    assert seen.unseen(rows.limit(0), out, ["k"], 2, 4).count() == 0
