"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text form a group that stays in one shard. Groups are taken from large to small; each goes
into the shard with the least remaining capacity that still holds it, found in a balanced tree. Groups of
one size are interchangeable, so the plan runs on the histogram of group sizes (one entry per distinct
size: at most the square root of twice the input's bytes) and fills a shard with as many groups of that
size as fit at once, which is what taking them singly would do. The groups of a size are then numbered in
a distributed way (per hash bucket, plus the bucket's offset), and their number gives the shard.

Defined results: a null text counts as empty and shares the empty texts' group; repeated rows are one
group's rows and get slots of their own; a null doc_id is kept; an empty table gives an empty result; a
group larger than an equal share gets a shard for itself and the rest is shared out among the others.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

SHARDS = 16
#: Hash buckets within a size and within a shard: what one window sorts.
BUCKETS = 1024


class RoomTree:
    """Balanced tree (a treap) of (remaining capacity, bin)."""

    def __init__(self):
        self.root = None
        self.draw = random.Random(7).random

    @staticmethod
    def _split(node, key):
        """Nodes below key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = RoomTree._split(node[3], key)
            node[3] = low
            return node, high
        low, high = RoomTree._split(node[2], key)
        node[2] = high
        return low, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = RoomTree._merge(a[3], b)
            return a
        b[2] = RoomTree._merge(a, b[2])
        return b

    def add(self, room: int, name: int) -> None:
        low, high = self._split(self.root, (room, name))
        self.root = self._merge(self._merge(low, [(room, name), self.draw(), None, None]), high)

    def remove(self, room: int, name: int) -> None:
        low, rest = self._split(self.root, (room, name))
        _, high = self._split(rest, (room, name + 1))
        self.root = self._merge(low, high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The entry with the least room of at least size."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= size:
                node, found = node[2], node[0]
            else:
                node = node[3]
        return found

    def roomiest(self) -> tuple[int, int] | None:
        node = self.root
        while node is not None and node[3] is not None:
            node = node[3]
        return node[0] if node else None


def best_fit_decreasing(sizes: np.ndarray, counts: np.ndarray, capacity: int | None = None, bins: int | None = None) -> tuple[list[tuple[int, int, int, int]], int]:
    """Plans groups given as (size, count). With capacity: as many bins as it takes. With bins: near equal shares.

    Returns entries (size, first number, end number, bin), numbering the groups of a size from 0, and the
    number of bins. A group above the capacity gets a bin of its own.
    """
    order = np.argsort(-sizes, kind="stable")
    todo = [[int(sizes[i]), int(counts[i]), 0] for i in order if counts[i] > 0]
    tree, plan, used = RoomTree(), [], 0
    if bins is not None:
        total, left = sum(s * c for s, c, _ in todo), bins
        for entry in todo:  # a group above the equal share of what is left takes a bin
            while entry[1] and left > 1 and entry[0] * left > total:
                plan.append((entry[0], entry[2], entry[2] + 1, used))
                entry[1], entry[2] = entry[1] - 1, entry[2] + 1
                total, left, used = total - entry[0], left - 1, used + 1
            if entry[1]:
                break
        share = -(-total // left)
        for name in range(used, bins):
            tree.add(share, name)
        used = bins
    for size, count, done in todo:
        while count:
            found = tree.tightest(size)
            if found:
                room, name = found
                tree.remove(room, name)
                n = min(count, room // size)
            elif bins is not None:
                room, name = tree.roomiest()
                tree.remove(room, name)
                n = 1
            else:
                room, name, used = max(capacity, size), used, used + 1
                n = min(count, room // size)
            plan.append((size, done, done + n, name))
            tree.add(room - n * size, name)
            count, done = count - n, done + n
    return plan, used


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """Per row: key, size, text_crc32, shard and slot; ``shards`` near equal shards, or shards of a fixed capacity."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(body.cast("binary"))).alias("_group"),
    )
    groups = rows.groupBy("_group").agg((F.count("*") * F.first("size")).alias("gsize"))
    groups = written(groups.withColumn("bucket", F.pmod(F.xxhash64("_group"), F.lit(BUCKETS)).cast("int")), "shard-groups")

    sizes = groups.groupBy("gsize").agg(F.count("*").alias("n")).toPandas()
    plan, _ = best_fit_decreasing(sizes["gsize"].to_numpy(), sizes["n"].to_numpy(), capacity, None if capacity else shards)
    planned = pd.DataFrame(plan, columns=["gsize", "first", "end", "shard"]).astype({"gsize": "int64", "first": "int64", "end": "int64", "shard": "int32"})
    plan_df = spark.createDataFrame(planned, "gsize long, first long, end long, shard int")
    runs = plan_df.groupBy("gsize").agg(F.collect_list(F.struct("first", "end", "shard")).alias("runs"))

    by_size = Window.partitionBy("gsize").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.groupBy("gsize", "bucket").agg(F.count("*").alias("n"))
    parts = parts.withColumn("offset", F.coalesce(F.sum("n").over(by_size), F.lit(0))).join(runs, "gsize")
    # of a size's runs, those that reach into this bucket's numbers
    parts = parts.select("gsize", "bucket", "offset", F.expr("filter(runs, r -> r.end > offset AND r.first < offset + n)").alias("runs"))
    inside = Window.partitionBy("gsize", "bucket").orderBy("_group")
    placed = (
        groups.withColumn("number", F.row_number().over(inside) - 1)
        .join(parts, ["gsize", "bucket"])
        .withColumn("number", F.col("number") + F.col("offset"))
        .select("_group", F.expr("filter(runs, r -> r.first <= number AND number < r.end)[0].shard").alias("shard"))
    )
    dealt = rows.join(placed, "_group").withColumn("_uid", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("_key", F.when(F.col("_key").isNull(), F.col("_uid"))), F.lit(BUCKETS)).cast("int"))
    dealt = written(dealt.drop("_group"), "shard-rows")

    within = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("n")
    if capacity is None:
        starts = F.broadcast(starts)  # at most shards * BUCKETS rows
    each = Window.partitionBy("shard", "_part").orderBy("_key", "_uid")
    return (
        dealt.withColumn("_n", F.row_number().over(each) - 1)
        .join(starts, ["shard", "_part"])
        .select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("start") + F.col("_n")).cast("long").alias("slot"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
