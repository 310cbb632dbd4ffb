"""Near-duplicate groups by MinHash, banding, verification and connected components.

1. Each text becomes its set of hashed word shingles; from it come universal hash minima, band hashes and
   a small signature of two bits for each minimum. Texts with equal sets form a class at once; only the
   class's smallest id goes on.
2. Members of a bucket (equal band hash) are paired with the bucket's smallest id. A pair's signatures
   and set sizes must allow the wanted similarity; then its full sets are compared exactly.
3. Connected components of the confirmed links, by alternating large-star and small-star.
4. Buckets that still hold several components hold pairs that a star leaves out. Semi-joins find the members
   that have a plausible partner (by signatures and sizes) of another component in their bucket; such
   members of shared buckets form clusters. Within a cluster, blocks of the documents outside its largest
   component are compared with blocks of all, on full sets, and only true links come out. So no plausible
   pair of different components in any bucket stays unchecked, and no list of candidate pairs is made.

Two texts at the least similarity 0.8 share a band except with probability 3e-6 (24 bands of 4 minima).

Nothing here puts a bucket, a class, a component or a hub of links into one task: counts and minima are
summed before the shuffle, and every join on a key that can be hot (bucket, head of a bucket, root, class,
cluster) deals the rows of its hot keys over salts, told by a broadcast list of bounded length. The search
within a bucket or a cluster goes by blocks of bounded size. Ids and links are never collected. The shingle
sets are made for the ids in candidate pairs only; these ids are broadcast to the scan while there are at
most ``BROADCAST_IDS``, else joined by a shuffle. The stars are done when the links are a forest of stars,
which is tested on the links themselves.

Defined results: null and empty texts, and texts without words, have no shingles and stand alone; with
fewer words than a shingle has, the whole sequence is the one shingle; rows of one doc_id are one document; a null
doc_id takes the component of its equal texts, or null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_held, hot_keys, release, ship, slices, small_batches, spread_join, table, written

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Least number of equal two-bit parts of two signatures: 5.2 standard deviations below what similarity 0.8 gives.
LEAST_EQUAL = 63
BROADCAST_IDS = 500_000
#: Where whole shingle sets are copied for the salts of hot ids, so many copies at most (twice).
SET_SHARES = 512
#: Documents of a block in a comparison within a bucket or a cluster, and its shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000

_DRAWN = np.random.default_rng(20240229)
MULTIPLIERS = _DRAWN.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _DRAWN.integers(0, 1 << 63, HASHES, dtype=np.uint64)
WORD_FACTORS = _DRAWN.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_FACTORS = _DRAWN.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads differences over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z count as lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total + hashes[k : len(words) - size + 1 + k] * WORD_FACTORS[k])
    return np.unique(total)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (sets, BANDS) and signatures of two bits for each minimum, in 64-bit words; sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    minima = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        minima[:, k] = np.minimum.reduceat(flat * MULTIPLIERS[k] + OFFSETS[k], starts)
    minima = mixed(minima)
    bands = mixed((minima.reshape(len(sets), BANDS, ROWS) * BAND_FACTORS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    sketch = ((minima & np.uint64(3)).reshape(len(sets), -1, 32) << shifts).sum(axis=2, dtype=np.uint64)
    return bands.view(np.int64), sketch.view(np.int64)


N_WORDS = HASHES // 32
SIGNED = ", ".join(f"s{k} long" for k in range(N_WORDS))


def signed_documents(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc_id, n, set_a, set_b, bands, s0..): the set's size, two sums that name it, band hashes and signature."""

    def sign(batches):
        drop_held()
        for batch in batches:
            column = batch.column(1)
            for start, end in slices(column):
                sets = [shingle_set(t.as_py() or "", width) for t in column[start:end]]
                full = [k for k, s in enumerate(sets) if len(s)]
                bands = np.zeros((len(sets), BANDS), np.int64)
                sketch = np.zeros((len(sets), N_WORDS), np.int64)
                if full:
                    bands[full], sketch[full] = signatures([sets[k] for k in full])
                a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                b = np.array([mixed(s ^ WORD_FACTORS[0]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                bands_list = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(a), pa.array(b), bands_list, *(pa.array(sketch[:, k]) for k in range(N_WORDS))], ["doc_id", "n", "set_a", "set_b", "bands", *(f"s{k}" for k in range(N_WORDS))])
            release()

    taken = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return taken.mapInArrow(sign, f"doc_id long, n long, set_a long, set_b long, bands array<long>, {SIGNED}")


def plausible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and signatures of the rows a and b (column prefixes) allow a link."""
    lows = 0x5555555555555555
    differing = [F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}")) for k in range(N_WORDS)]
    unequal = [F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(lows))) for x in differing]
    unequal = sum(unequal[1:], unequal[0])
    sizes = F.least(F.col(f"{a}n"), F.col(f"{b}n")) * 100 >= F.greatest(F.col(f"{a}n"), F.col(f"{b}n")) * percent
    return sizes & (unequal <= HASHES - LEAST_EQUAL)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def shingle_sets(ids: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, shingles) of the documents in ids."""

    def sets(batches):
        for batch in batches:
            for start, end in slices(batch.column(1)):
                part = batch.slice(start, end - start)
                made = [shingle_set(t.as_py() or "", width).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], ["id", "shingles"])
            release()

    n_ids = ids.limit(BROADCAST_IDS + 1).count()
    few = n_ids <= BROADCAST_IDS
    taken = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    taken = taken.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    made = written(taken.mapInArrow(sets, "id long, shingles array<long>"), "dup-sets")
    return made if few and made.count() == n_ids else written(made.dropDuplicates(["id"]), "dup-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of ids, those whose full shingle sets are similar enough; only ``a`` may be hot."""
    pairs = written(pairs, "dup-pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "dup-ids")
    shingles = shingle_sets(ids, docs, key, text, width)
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), ["a"], "n", pairs.count(), SET_SHARES)
    both = pairs.join(shingles.select(F.col("id").alias("b"), F.col("shingles").alias("b_shingles")), "b")
    both = spread_join(both, shingles.select(F.col("id").alias("a"), F.col("shingles").alias("a_shingles")), ["a"], hot, F.xxhash64("b"))
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    union = F.size("a_shingles") + F.size("b_shingles") - common
    return written(both.where(common * 100 >= union * percent).select("a", "b"), "dup-links")


def block_links(some: pd.DataFrame, every: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between documents of some and of every, of one cluster and different components.

    Both hold cluster, id, component, largest, shingles. Of two documents outside the largest component the
    one with the smaller id asks.
    """
    out = []
    if len(some) and len(every):
        every = every.sort_values(["cluster", "id"], kind="stable", ignore_index=True)
        sizes = every["shingles"].map(len).to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        tokens, place = np.unique(np.concatenate(every["shingles"].to_list()), return_inverse=True)
        ids, clusters, parts = every["id"].to_numpy(), every["cluster"].to_numpy(), every["component"].to_numpy()
        inside = parts == every["largest"].to_numpy()
        seen = np.zeros(len(tokens), np.int32)
        for row in some.itertuples(index=False):
            lo, hi = np.searchsorted(clusters, row.cluster), np.searchsorted(clusters, row.cluster, "right")
            if lo == hi:
                continue
            own = np.asarray(row.shingles)
            at = np.searchsorted(tokens, own)
            at = at[(at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == own)]
            seen[at] = 1
            common = np.add.reduceat(seen[place[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo])
            seen[at] = 0
            linked = (100 * common >= percent * (len(own) + sizes[lo:hi] - common)) & (parts[lo:hi] != row.component) & (inside[lo:hi] | (ids[lo:hi] > row.id))
            out += [(row.id, b) for b in ids[lo:hi][linked].tolist()]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def sized_clusters(members: DataFrame) -> DataFrame:
    """members (cluster, id, component, n) with the blocks of each cluster and its largest component."""
    members = written(members, "dup-members")
    parts = members.groupBy("cluster", "component").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.sum("m") / BLOCK_DOCS, F.sum("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = written(parts.groupBy("cluster").agg(F.sum("m").alias("m"), F.max_by("component", "m").alias("largest"), blocks.alias("blocks")), "dup-clusters")
    hot = hot_keys(sizes, ["cluster"], "m", members.count())
    return spread_join(members, sizes.drop("m"), ["cluster"], hot, F.xxhash64("id"))


def links_in_clusters(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of different components within clusters; rows: those of sized_clusters with their shingles."""
    n, shingles = rows.select("n").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # small clusters share groups
    bins = max(1, n // BLOCK_DOCS, shingles // BLOCK_SHINGLES)
    rows = rows.withColumn("bin", F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")))
    own, each = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    held = ["bin", "i", "j", "cluster", "id", "component", "largest", "shingles"]
    some = rows.where("component <> largest").withColumn("i", own).withColumn("j", each).select(*held, F.lit(True).alias("asks"))
    every = rows.withColumn("j", own).withColumn("i", each).select(*held, F.lit(False).alias("asks"))
    grouped = some.unionByName(every).groupBy("bin", "i", "j")
    return grouped.applyInPandas(lambda f: block_links(f[f["asks"]], f[~f["asks"]], percent), "a long, b long")


def is_forest(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").isEmpty()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id that it reaches."""

    def to_least(edges: DataFrame, asking: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
        """The edges that ask, with m, the least that u goes to; and that m of each u."""
        found = written(edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("n")), label)
        hot = hot_keys(found, ["u"], "n", edges.count())
        return spread_join(asking, found.select("u", "m"), ["u"], hot, F.xxhash64("v")), found

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, label)
    while not is_forest(edges):
        # large-star: the larger neighbours of u go to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = to_least(both, both.where("v > u"), F.least(F.first("u"), F.min("v")))
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), label)
        # small-star: u and its smaller neighbours go to the smallest of them
        small, least = to_least(large, large, F.min("v"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), label)
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("id")))


def group_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id (long), n_shingles, component_id and kept."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    signed = written(signed_documents(docs, key, text, width), "dup-signed")
    names = ["n", "set_a", "set_b"]
    sketch = [f"s{k}" for k in range(N_WORDS)]
    classes = signed.where("n > 0").groupBy(*names).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.count("*").alias("copies"), *[F.first(s).alias(s) for s in sketch])
    classes = written(classes, "dup-classes")
    reps = classes.where("id IS NOT NULL").select("id", "n", *sketch)

    # a band hash already tells its band, so equal hashes are one bucket
    banded = classes.where("id IS NOT NULL").select(F.explode("bands").alias("bucket"), "id")
    buckets = written(banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("least")).where("size > 1"), "dup-heads")
    hot = hot_keys(buckets, ["bucket"], "size", classes.count() * BANDS)
    shared = written(spread_join(banded, buckets, ["bucket"], hot, F.xxhash64("id")), "dup-buckets")
    star = written(shared.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "dup-star")
    hot = hot_keys(star.groupBy("a").agg(F.count("*").alias("n")), ["a"], "n", star.count())
    star = star.join(prefixed(reps, "b_").withColumnRenamed("b_id", "b"), "b")
    star = spread_join(star, prefixed(reps, "a_").withColumnRenamed("a_id", "a"), ["a"], hot, F.xxhash64("b"))
    links = confirmed(star.where(plausible("a_", "b_", percent)).select("a", "b"), docs, key, text, width, percent)
    found = written(components(links), "dup-components")

    labelled = shared.where("size > 2").join(found, "id", "left").select("bucket", "id", "least", F.coalesce("component", "id").alias("component"))
    labelled = written(labelled, "dup-labelled")
    inside = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = inside.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max("n").alias("n_in"), F.max_by("component", "n").alias("largest")).where("parts > 1")
    split = written(split, "dup-split")
    hot = hot_keys(split, ["bucket"], "size", labelled.count())
    rest = spread_join(labelled.where("id <> least"), split.drop("parts"), ["bucket"], hot, F.xxhash64("id"))
    rest = written(rest.join(reps, "id"), "dup-rest")
    outside, largest = rest.where("component <> largest"), rest.where("component = largest")

    def partnered(rows: DataFrame, n_rows: Column, others: DataFrame) -> DataFrame:
        """The rows with a plausible partner among the others; blocks of a bucket's rows ask by themselves."""
        blocks = F.greatest(F.lit(1), F.ceil(n_rows / BLOCK_DOCS)).cast("int")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        others = others.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        test = (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_block") == F.col("b_block")) & (F.col("a_component") != F.col("b_component")) & plausible("a_", "b_", percent)
        return prefixed(rows, "a_").join(prefixed(others, "b_"), test, "left_semi").select(*[F.col(f"a_{c}").alias(c) for c in ("bucket", "id", "component", "n")])

    touched = partnered(outside, F.col("size") - F.col("n_in"), rest).unionByName(partnered(largest, F.col("n_in"), outside))
    touched = written(touched, "dup-touched")
    heads = written(touched.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("size")), "dup-heads")
    hot = hot_keys(heads, ["bucket"], "size", touched.count())
    edges = spread_join(touched.select("bucket", F.col("id").alias("b")), heads.drop("size"), ["bucket"], hot, F.xxhash64("b")).select("a", "b").distinct()
    clusters = components(edges, "dup-clusters").withColumnRenamed("component", "cluster")
    members = written(sized_clusters(clusters.join(touched.select("id", "component", "n").distinct(), "id")), "dup-members")
    shingles = shingle_sets(members.select("id"), docs, key, text, width)
    more = written(links_in_clusters(members.join(shingles, "id"), percent), "dup-more")
    if not more.isEmpty():
        stars = found.select(F.col("component").alias("a"), F.col("id").alias("b"))
        found = components(stars.unionByName(more))

    named = classes.select(*names, "id").join(found, "id", "left").select(*names, F.coalesce("component", "id").alias("component"))
    hot = hot_keys(classes, names, "copies", signed.count())
    # signed is read from its files, so a row keeps its number when a task is repeated
    return (
        spread_join(signed.select("doc_id", *names), named, names, hot, F.monotonically_increasing_id(), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near_duplicates(table(spark, sf_dir, "documents"))
