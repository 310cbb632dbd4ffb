"""Exact top-k by inner product over a bit-sliced index.

Vectors are turned into integers floor(1024 * x). A block of candidates keeps, for every component, the
high bits of its value as bitmaps over the block's rows (the slices); the score of a query is the sum of
its weights times the components, and is formed for all rows of the block, and all queries of a block of
queries, by adding slices with bitmap arithmetic. The k-th best of these coarse scores is found from the
most significant slice of the sum downward. The low bits left out bound the error of a coarse score, so
the rows within that bound of the k-th are the boundary rows: they are scored exactly. A task takes a group
of blocks against a block of queries, keeps the best k of each query from block to block, and only these go
on to one ranking per query. Nothing is approximate.

Vectors with a component of 2**28 or more (after scaling) stand outside the index: their scores are computed
directly, in 64 bits where a bound on them allows it, else in integers of any length, and ranked as such.

Defined results: vectors that are null, or hold a null or non-finite component, or are empty, take no part; neither
does a null vec_id. A query meets the candidates of its own length only, never rows with its own vec_id.
Repeated query rows (equal ids and integers) count once. A score beyond 64 bits is ranked exactly and shown as the
nearest long. An empty table gives an empty result. Fewer candidates than k: all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

SCALE, K = 1024, 10
#: Rows of a candidate block and of a query block (at most); low bits left out of the slices.
BLOCK, QUERY_BLOCK, DROP_BITS = 4096, 1024, 3
#: Candidates and queries that a task takes (at most).
TASK_ROWS, TASK_QUERIES = 65_536, 4096
#: Least size of a component (scaled) that the slices don't take.
LARGE = 1 << 28
LONG = (1 << 63) - 1
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def packed(bits: np.ndarray) -> np.ndarray:
    """Booleans (..., rows) as bitmaps of 64-bit words."""
    short = -bits.shape[-1] % 64
    if short:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], short), bool)], axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


class BitSlicedIndex:
    """Slices of a block of integer vectors (rows, components)."""

    def __init__(self, values: np.ndarray, drop_bits: int = DROP_BITS):
        self.values, self.drop, self.n = values, drop_bits, len(values)
        high = (values >> drop_bits) - (values >> drop_bits).min(initial=0)
        self.bits = max(1, int(high.max(initial=0)).bit_length())
        shifts = np.arange(self.bits)
        self.slices = packed((high.T[:, None, :] >> shifts[None, :, None]) & 1 > 0)

    def coarse(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices of the sums of weights times components, up to a constant for each query; shape (queries, words) each."""
        weights = np.abs(queries)
        flip = np.where(queries < 0, ALL, np.uint64(0))
        top = max(1, int(weights.max(initial=0)).bit_length())
        most = int(weights.sum(axis=1).max(initial=0)) << self.bits
        total = [np.zeros((len(queries), self.slices.shape[-1]), np.uint64) for _ in range(most.bit_length() + 1)]
        for d in range(queries.shape[1]):
            # a negative weight adds the complement instead, which differs by a constant
            parts = [s[None, :] ^ flip[:, d : d + 1] for s in self.slices[d]]
            for w in range(top):
                on = np.where((weights[:, d] >> w) & 1 > 0, ALL, np.uint64(0))[:, None]
                if not on.any():
                    continue
                carry = None
                for p in range(w, len(total)):
                    b = p - w
                    if b < self.bits:
                        add = parts[b] & on
                        half = total[p] ^ add
                        out = total[p] & add
                        if carry is not None:
                            out |= half & carry
                            half ^= carry
                        total[p], carry = half, out
                    else:
                        if not carry.any():
                            break
                        total[p], carry = total[p] ^ carry, total[p] & carry
        return total

    def top(self, queries: np.ndarray, valid: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, the rows among which its best k are, and their exact scores; valid: (queries, rows)."""
        total = self.coarse(queries)
        live = packed(valid)
        edge, above = live.copy(), np.zeros(len(queries), np.int64)
        kth = [0] * len(queries)
        for p in range(len(total) - 1, -1, -1):
            ones = edge & total[p]
            n = np.bitwise_count(ones).sum(axis=1).astype(np.int64)
            take = above + n >= k
            edge = np.where(take[:, None], ones, edge & ~total[p])
            above += np.where(take, 0, n)
            for i in np.flatnonzero(take):
                kth[i] |= 1 << p
        lost = np.abs(queries).sum(axis=1) * ((1 << self.drop) - 1)
        least = [max(0, t - int(-(-x // (1 << self.drop)))) for t, x in zip(kth, lost, strict=True)]
        over, equal = np.zeros_like(live), live
        for p in range(len(total) - 1, -1, -1):
            bit = np.array([ALL if t >> p & 1 else 0 for t in least], np.uint64)[:, None]
            over |= equal & total[p] & ~bit
            equal = equal & ~(total[p] ^ bit)
        near = unpacked(over | equal, self.n)
        found = []
        for q, rows in zip(queries, near, strict=True):
            at = np.flatnonzero(rows)
            found.append((at, self.values[at] @ q))
        return found


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite doubles: 64-bit integers if all are below 2**62, else integers of any length."""
    if not len(vectors) or np.abs(vectors).max(initial=0) < 2.0**52:
        return np.floor(vectors * SCALE).astype(np.int64)
    # from 2**52 on a double is a whole number
    return np.array([[int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(x * SCALE)) for x in row] for row in vectors.tolist()], object)


def direct_scores(queries: np.ndarray, values: np.ndarray) -> np.ndarray:
    """All inner products (queries, rows) of doubles' integers."""
    bound = SCALE * SCALE * (np.abs(queries).sum(axis=1).max(initial=0) + queries.shape[1]) * (np.abs(values).max(initial=0) + 1.0)
    if bound < 2.0**62:
        return integers(queries) @ integers(values).T
    return integers(queries).astype(object) @ integers(values).astype(object).T


def sortable(n: int) -> bytes:
    """Bytes that compare like the integers they come from."""
    size = (abs(n).bit_length() + 7) // 8
    body = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return b"\x01" + body if n >= 0 else b"\x00" + bytes(255 - x for x in body)


def best_of(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the best k (score, id) among the candidates of other ids; all vectors are of one length."""
    kept: list[list[tuple[int, int]]] = [[] for _ in q_ids]

    def add(at: int, scores, names) -> None:
        kept[at] = sorted([*kept[at], *zip(scores, names, strict=True)], key=lambda x: (-x[0], x[1]))[:k]

    with np.errstate(over="ignore"):
        plain, plain_q = (np.abs(x * SCALE).max(axis=1, initial=0) < LARGE for x in (vectors, queries))
    small = np.flatnonzero(plain)
    for start in range(0, len(small), BLOCK):
        block = small[start : start + BLOCK]
        index, names = BitSlicedIndex(integers(vectors[block])), ids[block]
        for first in range(0, len(q_ids), QUERY_BLOCK):
            asking = first + np.flatnonzero(plain_q[first : first + QUERY_BLOCK])
            if not len(asking):
                continue
            weights = integers(queries[asking])
            for q, (at, score) in zip(asking, index.top(weights, q_ids[asking, None] != names[None, :], k), strict=True):
                top = np.lexsort((names[at], -score))[:k]
                add(q, score[top].tolist(), names[at][top].tolist())
    for rows, asking in ((np.flatnonzero(~plain), np.arange(len(q_ids))), (small, np.flatnonzero(~plain_q))):
        for start in range(0, len(rows), BLOCK):
            block = rows[start : start + BLOCK]
            for first in range(0, len(asking), 64):
                some = asking[first : first + 64]
                for q, score in zip(some, direct_scores(queries[some], vectors[block]), strict=True):
                    other = ids[block] != q_ids[q]
                    add(q, score[other].tolist(), ids[block][other].tolist())
    return kept


def top_k(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, key and score of the k best rows for each row of vectors that meets ``queries``."""
    whole = F.forall(f"`{vector}`", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    kind = vectors.select(F.col(f"`{vector}`").alias("v")).schema["v"].dataType
    moved = F.col(f"`{vector}`").cast("array<float>" if kind.simpleString() == "array<float>" else "array<double>")
    rows = (
        vectors.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & (F.size(f"`{vector}`") > 0) & whole)
        .select(F.col(f"`{key}`").cast("long").alias("_id"), moved.alias("_v"), queries.alias("_q"))
        .withColumn("_dim", F.size("_v"))
    )
    rows = written(rows, "topk-vectors")
    # what the integers of a vector are told by
    told = F.transform("_v", lambda x: F.struct(F.floor(x.cast("double") * SCALE).alias("n"), F.when(F.abs(x) >= 2.0**40, x).alias("x")))
    asked = rows.where("_q").select("_id", "_v", "_dim", told.alias("_told")).dropDuplicates(["_id", "_told"]).withColumn("_same", F.xxhash64("_told")).drop("_told")
    asked = written(asked, "topk-queries")
    n, n_asked = rows.count(), asked.count()
    groups = max(1, -(-n // max(256, min(TASK_ROWS, n // 64))))
    query_groups = max(1, -(-n_asked // TASK_QUERIES))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # repeated ids of one vector are spread, too; rows are read from their files, so each keeps its number
    left = rows.drop("_q").withColumn("_c", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")).withColumn("_b", each(query_groups))
    right = asked.withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(query_groups)).cast("int")).withColumn("_c", each(groups))
    by = ["_dim", "_c", "_b"]

    def best(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asking):
            doubles = lambda f: np.stack(f["_v"].to_numpy()).astype(np.float64)
            q_ids = asking["_id"].to_numpy(np.int64)
            found = best_of(block["_id"].to_numpy(np.int64), doubles(block), q_ids, doubles(asking), k)
            for q, same, rows in zip(q_ids.tolist(), asking["_same"].tolist(), found, strict=True):
                for score, name in rows:
                    far = 0 if abs(score) <= LONG else 1 if score > 0 else -1
                    out.append((q, same, name, max(-LONG, min(LONG, score)), far, sortable(score) if far else None))
        return pd.DataFrame(out, columns=["query_id", "_same", "_id", "score", "_far", "_wide"]).astype({c: "int64" for c in ("query_id", "_same", "_id", "score")} | {"_far": "int32", "_wide": "object"})

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, "query_id long, _same long, _id long, score long, _far int, _wide binary")
    order = Window.partitionBy("query_id", "_same").orderBy(F.desc("_far"), F.desc("_wide"), F.desc("score"), "_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(key), "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
