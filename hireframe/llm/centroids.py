"""Centroid clustering by delta Lloyd rounds over integer vectors.

Every vector's assignment (its owner and squared distance) is a stored table; each centroid's sum and count are exact
integers that live on. A round tells which centroids moved. A vector whose owner stood still meets the moved centroids
only: its own distance is known, and no other centroid came nearer. A vector whose owner moved meets all. What changed
owner is summed up with its sign, out of the old cluster and into the new, a few rows a task, and these transfers alone
correct the sums. Rounds end early when no centroid moves, as nothing can change any more.

Vectors are read as floor(scale * x). Arithmetic is exact: in doubles where all terms stay below 2**53, in 64 bits where
they stay below 2**62, else in integers of any length.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part; a null
key is a key like any other, and comes last when the first centroids are chosen. Repeated rows are vectors of their own.
Equal hashes start in the order of their vectors. Fewer vectors than clusters: as many clusters. An empty table gives an
empty result. A distance or sum beyond 64 bits is shown as the largest long; it is compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_held, ship, table, written

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
LONG = (1 << 63) - 1
#: Transfers travel in digits of this many bits, so that a sum of any size does.
LIMB = 60


def floors(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles; scale is a power of two. 64-bit integers if all are small enough."""
    if np.abs(vectors).max(initial=0) < 2.0**50 / scale:
        return np.floor(vectors * scale).astype(np.int64)
    # from 2**52 on a double is a whole number
    return np.array([[int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale)) for x in row] for row in vectors.tolist()], object)


def distances(values: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances (vectors, centroids), exact."""
    most = max([int(np.abs(values).max(initial=0)), *(abs(x) for c in centroids for x in c)])
    dims = values.shape[1]
    if 4 * dims * most * most < 1 << 53:
        v, c = values.astype(np.float64), np.array(centroids, np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2.0 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    small = 4 * dims * most * most < 1 << 62
    v = values.astype(np.int64 if small else object)
    return np.stack([((v - np.array(c, v.dtype)) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(values: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: list[list[int]], moved: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances (cut at the largest long) after the centroids ``moved``; owner -1: none so far."""
    new_owner, new_distance = owner.copy(), distance.copy()
    # a cut distance cannot be compared with, so its vector starts anew
    anew = (owner < 0) | np.isin(owner, moved) | (distance == LONG)
    for rows, among in ((np.flatnonzero(anew), list(range(len(centroids)))), (np.flatnonzero(~anew), moved)):
        if not len(rows) or not among:
            continue
        d = distances(values[rows], [centroids[c] for c in among])
        best = d.argmin(axis=1)  # the first of equals, and among is ascending
        least, who = d[np.arange(len(rows)), best], np.array(among)[best]
        if among is moved:
            old, held = new_distance[rows], owner[rows]
            better = (least < old) | ((least == old) & (who < held))
            rows, least, who = rows[better], least[better], who[better]
        new_owner[rows] = who
        new_distance[rows] = np.minimum(least, LONG).astype(np.int64)
    return new_owner, new_distance


def components(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def reassigned(state: DataFrame, centroids: list[list[int]], moved: list[int], dims: int, scale: int) -> DataFrame:
    """The assignments after a round; _from: the owner before it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            ids, vectors, owner, distance, _ = batch.columns
            before = owner.to_numpy(zero_copy_only=False)
            after, far = nearest(floors(components(vectors, dims), scale), before, distance.to_numpy(zero_copy_only=False), centroids, moved)
            yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(after, pa.int32()), pa.array(far, pa.int64()), owner], batch.schema.names)

    return state.mapInArrow(assign, state.schema)


def transfers(state: DataFrame, dims: int, scale: int, clusters: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster the signed count and sums of the vectors that changed owner in the last round."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        total, n = np.zeros((clusters, dims), object), [0] * clusters
        for batch in batches:
            vectors, owner, before = batch.columns
            values = floors(components(vectors, dims), scale)
            for sign, side in ((1, owner), (-1, before)):
                side = side.to_numpy(zero_copy_only=False)
                for c in np.unique(side[side >= 0]).tolist():
                    mine = values[side == c]
                    n[c] += sign * len(mine)
                    total[c] += sign * mine.sum(axis=0).astype(object)
        out = []
        for c in range(clusters):
            row, limb = [int(x) for x in total[c]], 0
            while limb == 0 or any(row):
                digits = [(abs(x) & ((1 << LIMB) - 1)) * (1 if x >= 0 else -1) for x in row]
                if n[c] or any(digits):
                    out.append((c, limb, n[c] if limb == 0 else 0, digits))
                row, limb = [(abs(x) >> LIMB) * (1 if x >= 0 else -1) for x in row], limb + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["c", "limb", "n", "s"])

    parts = state.where("_owner <> _from").select("_v", "_owner", "_from").mapInArrow(sums, "c int, limb int, n long, s array<long>")
    digit = parts.select("c", "limb", "n", F.posexplode("s").alias("k", "s")).groupBy("c", "limb", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for row in digit.collect():  # a row or two for each component of a cluster
        n, s = found.setdefault(row["c"], (0, [0] * dims))
        s[row["k"]] += int(row["s"]) << LIMB * row["limb"]
        found[row["c"]] = (n + row["n"] if row["k"] == 0 else n, s)
    return found


def first_centroids(rows: DataFrame, clusters: int, scale: int) -> list[list[int]]:
    """The integers of the vectors whose keys have the smallest hashes."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("_id").cast("string")), 256)
    chosen = rows.orderBy(hashed.asc_nulls_last(), "_v").limit(clusters).select("_v").collect()
    return [[int(x) for x in floors(np.array([r["_v"]], np.float64), scale)[0]] for r in chosen]


def delta_lloyd(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster, distance) of each vector, the centroids); starts from the vectors with the smallest hashed keys."""
    ship(vectors.sparkSession)
    finite = F.forall(f"`{vector}`", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    kind = vectors.select(F.col(f"`{vector}`").alias("v")).schema["v"].dataType.simpleString()
    state = vectors.where(F.col(f"`{vector}`").isNotNull() & (F.size(f"`{vector}`") == dims) & finite).select(
        F.col(f"`{key}`").cast("long").alias("_id"),
        F.col(f"`{vector}`").cast("array<float>" if kind == "array<float>" else "array<double>").alias("_v"),
        F.lit(-1).alias("_owner"),
        F.lit(0).cast("long").alias("_distance"),
        F.lit(-1).alias("_from"),
    )
    centroids = first_centroids(state, clusters, scale)
    counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    moved = list(range(len(centroids)))
    for number in range(rounds + 1):
        if not moved:
            break
        state = written(reassigned(state, centroids, moved, dims, scale), f"centroids-round{number}")
        if number == rounds:
            break
        for c, (n, s) in transfers(state, dims, scale, len(centroids)).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], s, strict=True)]
        new = [[x // n for x in s] if n else old for n, s, old in zip(counts, sums, centroids, strict=True)]
        moved = [c for c, (a, b) in enumerate(zip(new, centroids, strict=True)) if a != b]
        centroids = new
    return state.select(F.col("_id").alias(key), F.col("_owner").alias("cluster"), F.col("_distance").alias("distance")), centroids


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = delta_lloyd(table(spark, sf_dir, "embeddings"))
    totals = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    cut = lambda n: min(n, LONG)
    each = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        each([cut(totals.get(c, 0)) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(cut(sum(totals.values()))).cast("long").alias("inertia"),
        each(hashes, "string").alias("centroid_sha256"),
    )


def _oracle(dims: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """Plain rounds over all pairs of vectors and centroids."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) - 1 AS c, e FROM v) WHERE c < {clusters})""",
    ]
    for k in range(rounds + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, x.c, CAST(list_sum(list_transform(list_zip(v.e, x.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
FROM v, c{k} x) GROUP BY r)"""
        )
        if k < rounds:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (SELECT x.c, coalesce(y.e, x.e) AS e FROM c{k} x LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e
FROM (SELECT a.c, t.i, sum(v.e[t.i]) AS s, count(*) AS n FROM a{k} a JOIN v ON v.r = a.r, range(1, {dims + 1}) t(i) GROUP BY a.c, t.i) GROUP BY c) y ON y.c = x.c)"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} x ON x.c = a.c"""
    )


ORACLE = _oracle()
