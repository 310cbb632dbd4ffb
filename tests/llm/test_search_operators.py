"""Centroid clustering, ranked search and decontamination against plain versions, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hireframe.llm import centroids, decontaminate, lexical_search, terms

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_words_of_texts():
    for text in ["", "Ab-c É1 x　y\x7fz q{ w\x85v", "\x00A\tB_c`d", "ÄÖ 😀a'b"]:
        assert [w.decode() for w in terms.words_of(text.encode())] == words(text)


# centroids


def brute_lloyd(rows, dims, k, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        owned = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, o) in zip(kept, owned, strict=True) if o == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return Counter((i, o, min(d, centroids.LONG)) for (i, _), (d, o) in zip(kept, assign(), strict=True)), centres


def clustered(spark, rows, dims, k, rounds, kind="array<double>", scale=64):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], f"vec_id long, embedding {kind}, cluster int, _v string")
    found, centres = centroids.delta_lloyd(df, dims=dims, clusters=k, rounds=rounds, scale=scale)
    return Counter(tuple(r) for r in found.collect()), centres


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_against_plain_rounds(spark, seed):
    rng = random.Random(seed)
    rows = [(i % 70, [rng.choice([rng.gauss(0, 1), rng.randint(-2, 2) / 2]) for _ in range(3)]) for i in range(150)]
    rows += [(None, [0.5, 0.25, -1.0])] * 3 + rows[:9]
    rows += [(901, None), (902, []), (903, [1.0, 2.0]), (904, [1.0, None, 2.0]), (905, [1.0, float("nan"), 2.0]), (906, [1.0, float("inf"), 2.0])]
    for k, rounds in ((5, 3), (1, 2), (7, 0)):
        assert clustered(spark, rows, 3, k, rounds) == brute_lloyd(rows, 3, k, rounds, 64)


def test_clusters_of_large_components(spark):
    rng = random.Random(5)
    for size in (2.0**20, 2.0**27, 2.0**60, 2.0**90, 1e300):
        rows = [(i, [rng.uniform(-size, size) for _ in range(3)]) for i in range(30)] + [(100 + i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(10)]
        assert clustered(spark, rows, 3, 4, 3) == brute_lloyd(rows, 3, 4, 3, 64)


def test_clusters_few_and_none(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0])]
    assert clustered(spark, rows, 2, 16, 3) == brute_lloyd(rows, 2, 16, 3, 64)
    assert clustered(spark, [(1, [0.0])], 2, 16, 3)[0] == Counter()
    assert clustered(spark, [], 2, 16, 3)[0] == Counter()


def test_unmoved_owners_meet_moved_centroids_only(monkeypatch):
    asked = []
    plain = centroids.distances
    monkeypatch.setattr(centroids, "distances", lambda v, c: asked.append((len(v), len(c))) or plain(v, c))
    values = np.array([[0], [10], [11], [50]])
    owner, distance = centroids.nearest(values, np.array([-1] * 4), np.zeros(4, np.int64), [[0], [10], [50]], [0, 1, 2])
    assert owner.tolist() == [0, 1, 1, 2] and asked == [(4, 3)]
    asked.clear()
    owner, distance = centroids.nearest(values, owner, distance, [[0], [30], [50]], [1])
    assert owner.tolist() == [0, 0, 0, 2] and distance.tolist() == [0, 100, 121, 0]
    assert asked == [(2, 3), (2, 1)]  # two vectors whose owner moved meet all three, two others the moved one


# ranked search


def brute_ranked(documents, items, k):
    kept = [(i, words(t)) for i, t in documents if words(t)]
    n, total = len(kept), sum(len(w) for _, w in kept)
    holding = Counter(t for _, w in kept for t in set(w))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = set()
    for i, q in asked.items():
        scores = []
        for d, w in kept:
            m, tf = 50 + 50 * len(w) * n // total, Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in q if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out |= {(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])}
    return out


def sample_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "the", "The", "a-b"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return rng, [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 80])))) for i in range(n)]


@pytest.mark.parametrize("seed, k, entries", [(1, 3, 1), (2, 5, 60), (3, 50, 10**6)])
def test_ranking_against_brute_force(spark, seed, k, entries):
    rng, documents = sample_texts(seed, 120)
    documents += documents[:10] + [(None, "w0 w1 w40"), (None, "w0 w1 w40"), (500, None), (501, ""), (502, " \n-"), (503, "É")]
    items = [(i, " ".join(rng.sample([f"w{k}" for k in range(64)], 6)) + " the É") for i in range(8)]
    items += [(0, "w63 extra"), (None, "w1"), (20, None), (21, ""), (22, "unseen")]
    df = spark.createDataFrame([(i, t, "s") for i, t in documents], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in lexical_search.ranked_search(df, q, k=k, entries=entries).collect()]
    want = brute_ranked(documents, items, k)
    assert len(got) == len(want) and set(got) == want
    if seed == 1:
        blocks = [tuple(r) for r in lexical_search.ranked_search(df, q, k=k, block_chars=60).collect()]
        assert len(blocks) == len(want) and set(blocks) == want
        assert lexical_search.ranked_search(df.limit(0), q).count() == 0
        assert lexical_search.ranked_search(df, q.limit(0)).count() == 0


def test_reading_ends_at_the_threshold(monkeypatch):
    """Of long lists only the first entries are read, and each document is looked up once."""
    n = 50_000
    starts, entries = np.arange(0, 2 * n + 1, 2), np.tile([0, 1], n)
    rng = np.random.default_rng(3)
    impact = rng.integers(1, 100, 2 * n)
    impact[: 2 * 20] += 10_000
    block = lexical_search.Block(starts, entries, impact, 2)
    looked, plain = [], block.look_up
    monkeypatch.setattr(block, "look_up", lambda d: looked.extend(d.tolist()) or plain(d))
    found, scores = block.search(np.array([0, 1]), 10, 0)
    assert len(looked) == len(set(looked)) < 300
    best = sorted(((impact[2 * d] + impact[2 * d + 1], -d) for d in range(n)), reverse=True)[:10]
    assert {(s, -d) for d, s in zip(found.tolist(), scores.tolist(), strict=True)} >= {(s, d) for s, d in best}
    looked.clear()
    block.search(np.array([0, 1]), 10, 10**9)
    assert looked == []


# decontamination


def brute_marked(text, items, window):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        q = words(t)
        m = min(window, len(q))
        for a in range(len(q) - m + 1 if m else 0):
            for b in range(len(w) - m + 1):
                if w[b : b + m] == q[a : a + m]:
                    hit.update(range(b, b + m))
                    found.add(i)
    named = sorted(i for i in found if i is not None)
    return len(w), len(hit), named, hit


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_marks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "abcdeÉ"
    items = [(i, " ".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 9, 14])))) for i in range(6, 12)]
    items += [(3, None), (4, " - "), (None, "a c e a"), (items[0][0], "b b d d"), (100, "x y z x y z x y z x y z"), (20, "x y z x y z")]
    documents = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(letters + "Xyz", k=rng.choice([0, 1, 4, 30, 60])))) for i in range(60)]
    documents += [(None, "a C e A"), (70, None), (70, ""), (71, "x y z " * 20), (72, "q " * 500)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in documents], "doc_id long, text string, leaks int, `a.b` int")
    q = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (10**6, 20):
        out = decontaminate.mark_items(df, q, window=5, block_chars=block_chars)
        assert out.columns == ["doc_id", "text", "a.b", "leaks"]
        for r in out.collect():
            n, hits, named, at = brute_marked(r["text"], items, 5)
            leaks = r["leaks"]
            assert (leaks["n_words"], leaks["n_hit"], leaks["items"]) == (n, hits, named)
            assert {k for a, b in zip(leaks["starts"], leaks["ends"], strict=True) for k in range(a, b)} == at


def test_marks_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r["leaks"]) for r in decontaminate.mark_items(df, none).collect()] == [(2, [], [], 0, [])]
    assert decontaminate.mark_items(df.limit(0), none).count() == 0


def test_shifts_skip_positions():
    """Words that no window has are passed in steps of nine, and windows are found where they stand."""
    item = " ".join(f"q{k}" for k in range(30)).encode()
    found = decontaminate.Searches([(1, item)], 10)
    [search] = found.searches
    read = []

    class Watched(list):
        def __getitem__(self, k):
            read.append(k)
            return list.__getitem__(self, k)

    assert list(search.occurrences(Watched([0] * 9000))) == [] and len(read) <= 2 * 1000 + 2
    text = "z " * 40 + " ".join(f"q{k}" for k in range(5, 20)) + " z"
    assert found.judge(text) == (56, [40], [55], [1])
