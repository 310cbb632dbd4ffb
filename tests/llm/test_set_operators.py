"""URL filter, near-duplicates, sharding, packing, top-k and the pipeline on small cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hireframe.llm import catalogue, near_dup, packing, sharding, topk, url_filter


def brute_url(url, rules):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_against_brute_force(spark):
    rng = random.Random(7)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "net", "c.net", "ba.com", "Ü.net"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", "/é/", ""]
    for _ in range(4):
        rules = list({(h.lower(), p): (h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(9))}.values())
        urls = [None, "", "no scheme", "http://", "http://A.Com?x", "http://com#y", "x://a.com/a://b"] + [f"http://{rng.choice(['', 'w.', 'x.y.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', 'zz', '/b#t'])}" for _ in range(120)]
        rows = [(i % 50, u, "v") for i, u in enumerate(urls)] + [(1, urls[9], "v"), (None, urls[9], "v"), (None, urls[9], "v")]
        pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
        got = Counter(tuple(r) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect())
        assert got == Counter((i, *brute_url(u, rules)) for i, u, _ in rows)


def test_urls_hot_host_and_empty(spark):
    pages = spark.createDataFrame([(i, f"http://s{i % 3}.hot.com/en/{i}") for i in range(3000)], "page_id long, url string")
    out = url_filter.judge_urls(pages, url_filter.rule_table(spark, [("hot.com", "/en/", "block")]))
    assert out.count() == 3000 and out.where("verdict = 'block'").count() == 3000
    none = url_filter.rule_table(spark, [("x", "/", "allow")]).limit(0)
    assert [r["verdict"] for r in url_filter.judge_urls(pages.limit(2), none, default="block").collect()] == ["block"] * 2
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


def test_equal_urls_come_out_of_many_tasks(spark):
    """A hundred thousand rows of one url, without an id: judged once, and no task gives out most of them."""
    pages = spark.range(100_000, numPartitions=4).select(F.lit(None).cast("long").alias("page_id"), F.lit("http://www.example.com/en/x").alias("url"))
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # small as the rows are
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        out = url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.QUERY_RULES))
        assert [tuple(r) for r in out.groupBy("page_id", "rule", "verdict").count().collect()] == [(None, "www.example.com/en/", "allow", 100_000)]
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(parts) < 60_000
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def brute_groups(rows, width=4, percent=80):
    sets, low = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(rng):
    rows, i = [], 0
    for _ in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 6, 20])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 9999)}"
            rows.append((i, " ".join(words) if rng.random() < 0.8 else "\n".join(words).upper()))
            i += 1
    shared = [f"p{k}" for k in range(60)]
    for _ in range(20):
        rows.append((i, " ".join(shared + [f"u{rng.randint(0, 9999)}" for _ in range(30)])))
        i += 1
    rng.shuffle(rows)
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one two three"), (i + 6, "one  two\tthree")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = variants(random.Random(seed))
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.group_near_duplicates(df).collect()}
    assert got == brute_groups(rows)


def test_leftover_pairs_of_a_bucket(spark):
    """A chain whose ends are not alike: the star of its bucket alone would miss links."""
    base = [f"w{k}" for k in range(203)]
    rows = []
    for i in range(12):
        words = list(base)
        for k in range(i * 4, i * 4 + 4):
            words[(k * 5) % 200] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.group_near_duplicates(df).collect()}
    assert got == brute_groups(rows)


def test_block_links():
    import pandas as pd

    frame = pd.DataFrame({"cluster": [1] * 4 + [2], "id": [1, 2, 3, 4, 5], "component": [1, 1, 3, 4, 5], "largest": [1] * 4 + [5], "shingles": [np.arange(10), np.arange(10), np.arange(1, 11), np.arange(100, 110), np.arange(10)]})
    assert near_dup.block_links(frame[frame["component"] != frame["largest"]], frame, 80).to_numpy().tolist() == [[3, 1], [3, 2]]


def test_near_duplicates_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "z z z z z"), (7, "q")], "doc_id long, text string")
    got = Counter(tuple(r) for r in near_dup.group_near_duplicates(df).collect())
    assert got == Counter({(5, 2, 5, True): 2, (None, 2, 5, None): 1, (None, 1, None, None): 1, (7, 1, 7, True): 1})
    assert near_dup.group_near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 430)]
    group = {x: x for e in links for x in e}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    got = {r["id"]: r["component"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_best_fit_against_plain_version():
    rng = random.Random(3)
    for _ in range(150):
        items = Counter(rng.randint(1, 50) for _ in range(rng.randint(0, 60)))
        plan, used = sharding.best_fit_decreasing(np.array(list(items), np.int64), np.array(list(items.values()), np.int64), 60)
        rooms = []
        for x in sorted(items.elements(), reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms[rooms.index(min(fits))] -= x
            else:
                rooms.append(60 - x)
        load = Counter()
        for size, a, b, name in plan:
            load[name] += size * (b - a)
        assert sorted(60 - v for v in load.values()) == sorted(rooms) and used == len(rooms)


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "x" * rng.randint(1, 90), f"t{rng.randint(0, 30)}"])) for i in range(700)] + [(1000 + i, "hot text") for i in range(900 * hot)] + [(3, "twice"), (3, "twice"), (None, "none")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    out = sharding.shard_documents(df).toPandas()
    assert len(out) == len(rows)
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    load = out.groupby("shard")["size"].sum()
    rest = load.drop(load.idxmax()) if hot else load
    assert rest.max() - rest.min() <= 0.01 * rest.mean() + 100 and len(load) == 16
    sizes = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert Counter(zip(out["size"], out["text_crc32"], strict=True)) == sizes
    assert out.groupby(["size", "text_crc32"])["shard"].nunique().max() == 1
    assert sharding.shard_documents(df.limit(0)).count() == 0
    assert sharding.shard_documents(df, capacity=500).toPandas().groupby("shard")["size"].sum().max() <= max(500, load.max())


def test_packing(spark):
    from tokenizers import Tokenizer

    from hireframe.llm.bpe import vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(6)
    texts = [None, "", "word", "word"] + [" ".join(rng.choice(["alpha", "beta", "gamma!"]) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(3)
    out = packing.pack_documents(df, window=64).toPandas().sort_values(["doc_id", "start"])
    for i, part in out.groupby("doc_id"):
        ids = [x for piece in part["ids"] for x in piece]
        assert ids == [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert list(part["start"]) == [0, *np.cumsum(part["length"])[:-1]] and set(part["doc_tokens"]) == {len(ids)}
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert list(part["offset"]) == [0, *np.cumsum(part["length"])[:-1]]
        used = part["length"].sum()
        assert used <= 64 and (used & (used - 1)) == 0  # full, or a power of two: no padding
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out.itertuples())
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_sum_of_squares_rule():
    packer = packing.SquarePacker(10, lambda pieces: None)
    rng = random.Random(8)
    for k in range(300):
        size = rng.randint(1, 9)
        counts = packer.counts[:10].copy()

        def squares(at):
            after = counts.copy()
            if at:
                after[at] -= 1
            if at + size < 10:
                after[at + size] += 1
            return int((after[1:] ** 2).sum())

        allowed = [0] + [h for h in range(1, 10 - size + 1) if counts[h]]
        assert squares(packer.level(size)) == min(map(squares, allowed))
        packer.place((k, 0, np.zeros(size, "<u4"), size))


def test_windows_stay_open_until_the_end():
    """Documents that don't go together are cut only when all have been placed."""
    closed = []
    packer = packing.SquarePacker(64, closed.append)
    for k in range(2000):
        packer.place((k, 0, np.zeros(40, "<u4"), 40))
    assert packer.n_open == 2000 and not closed
    packer.empty()
    sizes = [sum(len(x[2]) for x in pieces) for pieces in closed]
    assert sum(sizes) == 80_000 and set(sizes) == {64} and packer.n_open == 0
    packer.place((0, 0, np.zeros(40, "<u4"), 40))
    packer.place((1, 0, np.zeros(24, "<u4"), 24))
    assert [x[0] for x in closed[-1]] == [0, 1] and packer.n_open == 0


def test_top_k(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [float("nan")] * 6), (1200, [float("inf")] * 6), (None, [1.0] * 6), (1300, [1.0, 2.0]), (1301, [3.0, 4.0]), (100, rows[100][1])]
    # components that the slices don't take, some with scores beyond 64 bits
    rows += [(2000 + i, [float(x) for x in rng.normal(size=6) * 10.0**e]) for i, e in enumerate([5, 6, 6, 7, 9, 17, 40, 300, 308])] + [(2100, [-3e5] * 6), (2100, [-3e5] * 6), (2100, [4e5] + [0.0] * 5), (2200, [1e25] * 6), (2300, [300000.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    floor = lambda x: int(x) * 1024 if abs(x) >= 2**52 else int(np.floor(1024 * x))
    whole = [(i, [floor(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    wanted = set()
    for q, v in whole:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
            wanted |= {(q, r + 1, i, max(-topk.LONG, min(topk.LONG, -s))) for r, (s, i) in enumerate(scores[:10])}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()} == wanted
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bit_slices_are_exact():
    rng = np.random.default_rng(4)
    values, queries = rng.integers(-900, 900, (150, 5)), rng.integers(-900, 900, (7, 5))
    index = topk.BitSlicedIndex(values, drop_bits=0)
    total = index.coarse(queries)
    sums = sum(topk.unpacked(plane, 150).astype(np.int64) << p for p, plane in enumerate(total))
    exact = queries @ values.T
    assert ((sums - sums[:, :1]) == (exact - exact[:, :1])).all()


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("extra", F.lit(None).cast("string"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, d)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), out.schema)
    from .test_text_operators import brute_quality

    good = {r["doc_id"] for r in docs.collect() if brute_quality(r["text"])[-1]}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= good and len(ids) > 0.7 * len(good)
    survivors = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert all(i == g for i, (_, g) in brute_groups(survivors, width=5).items())
    pieces = corpus_pipeline.packing(spark, kept, d).toPandas()
    assert set(pieces["doc_id"]) == ids and (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0


def test_pipeline_with_clashing_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = ["_gone", "_quality", "_toxicity", "_text", "_salt", "_salts", "a.b", "b`c", "id", "n", "bucket", "component_id", "kept", "toxicity"]
    more = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).select("*", *[F.col("doc_id").cast("string").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, more, d)
        assert out.columns == more.columns, name
        rows = [r.asDict() for r in out.collect()]
        assert rows and all({r[n] for n in names} == {None if r["doc_id"] is None else str(r["doc_id"])} for r in rows), name
        plain = sorted(r["doc_id"] for r in stage(spark, docs, d).collect()) if name != "near_duplicates" else None
        assert plain in (None, sorted(r["doc_id"] for r in rows if r["doc_id"] is not None))
    assert corpus_pipeline.packing(spark, more, d).columns[0] == "doc_id"


def test_catalogue():
    names = catalogue.queries()
    assert sorted(n.split("_")[0] for n in names) == sorted(["pipeline", *(f"op{k}" for k in range(1, 11))])
    assert set(catalogue.oracle_sql()) <= set(names)


def test_near_duplicates_equal_an_exact_join(spark):
    """All documents of sf0.01 against an exact join over an inverted list."""
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], set(near_dup.shingle_set(r["text"] or "", 4).tolist())) for r in df.collect()]
    lists: dict = {}
    for k, (_, s) in enumerate(rows):
        for x in s:
            lists.setdefault(x, []).append(k)
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, (i, s) in enumerate(rows):
        for other, common in Counter(j for x in s for j in lists[x] if j < k).items():
            j, t = rows[other]
            if 100 * common >= 80 * (len(s) + len(t) - common):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.group_near_duplicates(df).collect()}
    assert got == {i: (len(s), find(i)) for i, s in rows}


def test_hot_keys_are_dealt_over_salts(spark):
    from hireframe.llm.shared import hot_keys, spread_join

    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, ["k"], "n", 5000, shares=64)
    assert hot.count() == 64 and {r["k"] for r in hot.where("_salts > 1").collect()} == {7}
    out = spread_join(rows, counts, ["k"], hot, F.xxhash64("v"))
    assert out.count() == 5000 and out.where("k = 7 AND n <> 3333").isEmpty()
    assert hot_keys(counts.limit(0), ["k"], "n", 0).count() == 0
