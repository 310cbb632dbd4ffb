"""Benchmark decontamination by Wu-Manber search of the items' windows in the documents' words.

Words are the symbols. The windows of one length m are a pattern set: a block is two words (one, where m is 1). The
shift table holds, for each block of a window, how far it stands from the window's end at least; any other block lets
the search skip m - 1 words. Where the shift is 0, the block selects a bucket of windows that end with it; within the
bucket those that begin like the text are compared with it word by word. Items of fewer words than a window are one
window of their own length, and each length is a search of its own, so a short item does not shorten the others' skips.
Items come in blocks of bounded size; each block is a pass over the documents.

Defined results: a null or empty text has no words and no hit; repeated rows are judged each by itself. Items of equal
id are one item. Windows of an item without an id count as hits, but the item is in no list. Items without words have
no window. An empty benchmark hits nothing, an empty table of documents stays empty. All columns are kept, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import absent, add_by_block, columns, hold, table, written
from .terms import item_blocks, words_of

WINDOW = 10
#: Characters of items that are searched for at once: what driver and workers hold of them.
BLOCK_CHARS = 20_000_000


class WindowSearch:
    """Wu-Manber tables for windows of one length; ``base`` is more than any word's number."""

    def __init__(self, windows: dict[tuple[int, ...], list[int]], size: int, base: int):
        self.size, self.base = size, base
        self.block = min(2, size)
        self.skip = size - self.block + 1
        self.shift: dict[int, int] = {}
        #: suffix block -> prefix block -> windows with their items
        self.buckets: dict[int, dict[int, list[tuple[list[int], list[int]]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, size + 1):
                key, left = self.key(window, end), size - end
                if left < self.shift.get(key, self.skip):
                    self.shift[key] = left
            self.buckets.setdefault(self.key(window, size), {}).setdefault(self.key(window, self.block), []).append((list(window), items))

    def key(self, words, end: int) -> int:
        return words[end - 2] * self.base + words[end - 1] if self.block == 2 else words[end - 1]

    def occurrences(self, words: list[int]) -> Iterable[tuple[int, list[int]]]:
        """(start, items) of each window's occurrences, by start."""
        size, base, skip, shift, n = self.size, self.base, self.skip, self.shift.get, len(words)
        at = size - 1
        pairs = self.block == 2
        while at < n:
            key = words[at - 1] * base + words[at] if pairs else words[at]
            step = shift(key, skip)
            if step:
                at += step
                continue
            start = at - size + 1
            for window, items in self.buckets[key].get(self.key(words, start + self.block), ()):
                if words[start : at + 1] == window:
                    yield start, items
            at += 1


class Searches:
    """All windows of some items, by length."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            size = min(window, len(words))
            for start in range(len(words) - size + 1 if size else 0):
                by_size.setdefault(size, {}).setdefault(tuple(words[start : start + size]), set()).add(item)
        base = len(self.numbers) + 1
        self.searches = [WindowSearch({w: sorted(i for i in ids if i is not None) for w, ids in found.items()}, size, base) for size, found in sorted(by_size.items())]

    def judge(self, text: str) -> tuple[int, list[int], list[int], list[int]]:
        """Number of words, starts and ends of the united spans of hit words, items that occur."""
        words = [self.numbers.get(w, 0) for w in words_of(text.encode())]
        spans, found = [], {}
        for search in self.searches:
            for start, items in search.occurrences(words):
                spans.append((start, start + search.size))
                found[id(items)] = items
        starts, ends = [], []
        for start, end in sorted(spans):
            if ends and start <= ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        return len(words), starts, ends, sorted(set().union(*found.values())) if found else []


#: What a worker keeps from batch to batch: the tables of one block.
_TABLES: dict[str, Searches] = {}


def mark_items(documents: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", into: str = "leaks", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """documents with a struct ``into``: n_words, starts and ends of hit words' spans, n_hit, and the items that occur.

    With several blocks of items, spans are those of each block and may meet; n_hit counts each word once.
    """
    spark = documents.sparkSession
    names = [c for c in documents.columns if c.lower() != into.lower()]
    df = documents.select(*[c for c, name in zip(columns(documents), documents.columns, strict=True) if name in names])
    parts: list[str] = []
    for some in item_blocks(items, item_key, item_text, F.length("_text"), block_chars):
        if parts:
            df = written(df, "leaks-block")  # or the workers of all blocks would run at once
        block = spark.sparkContext.broadcast([(r["_item"], (r["_text"] or "").encode()) for r in some.toLocalIterator()])
        [part] = absent(df, "_leaks")

        def judge(texts: list[str], block=block, name=uuid.uuid4().hex) -> list:
            if name not in _TABLES:
                _TABLES.clear()
                _TABLES[name] = Searches(block.value, window)
                hold("decontaminate", _TABLES.clear)
            found = [_TABLES[name].judge(t) for t in texts]
            return [[f[k] for f in found] for k in range(4)]

        parts.append(part)
        df = add_by_block(df, text, part, "n_words long, starts array<int>, ends array<int>, items array<long>", judge, holds="decontaminate")
    spans = lambda p, f: F.col(f"{p}.{f}")
    if len(parts) == 1:
        n_hit = F.aggregate(F.zip_with(spans(parts[0], "starts"), spans(parts[0], "ends"), lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
        items_found = spans(parts[0], "items")
    else:
        at = [F.flatten(F.zip_with(spans(p, "starts"), spans(p, "ends"), lambda a, b: F.sequence(a, b - 1))) for p in parts]
        n_hit = F.size(F.array_distinct(F.concat(*at))).cast("long")
        items_found = F.array_sort(F.array_distinct(F.concat(*[spans(p, "items") for p in parts])))
    joined = lambda f: F.concat(*[spans(p, f) for p in parts])
    made = F.struct(spans(parts[0], "n_words").alias("n_words"), joined("starts").alias("starts"), joined("ends").alias("ends"), n_hit.alias("n_hit"), items_found.alias("items"))
    return df.select(*[c for c, name in zip(columns(df), df.columns, strict=True) if name in names], made.alias(into))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    named = F.array_sort(F.transform("leaks.items", lambda i: i.cast("string")))
    return marked.select(
        "doc_id",
        "leaks.n_words",
        "leaks.n_hit",
        F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.col("leaks.n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS m FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
x AS MATERIALIZED (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
o AS MATERIALIZED (SELECT p.r, p.i, p.m, x.item_id FROM (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT d.r, d.w, k.m, unnest(range(1, len(d.w) - k.m + 2)) AS i FROM d, (SELECT DISTINCT m FROM x) k)) p JOIN x USING (m, s)),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT r, i, m FROM o)) GROUP BY r),
n AS (SELECT r, count(item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM (SELECT DISTINCT r, item_id FROM o) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.l, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
