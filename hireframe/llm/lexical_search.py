"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

A first pass turns every document into a row of a forward index: its number of terms, and those of its terms that an
item asks for, with their counts. From its stored rows come the number of documents, their length and each term's
document frequency, so a term's impact in a document is known. A second pass takes the index block by block: within a
block each term has a list of its documents by falling impact. For an item all its lists are read in turn, a stretch
each; a document met for the first time is looked up in the forward index, which gives its whole score. The sum of the
next unread impacts is the threshold that no unread document can pass: reading ends when it falls strictly below the
k-th score. A task carries its best documents from block to block, so that later blocks start from a known k-th score,
and gives k rows an item at most; one ranking for each item joins the tasks. Items come in blocks of bounded size.

Defined results: a null or empty text has no terms and is no document of the statistics; documents without an id take
part, after all ids on equal scores, as do repeated rows, each by itself. Items of equal id are one item; items without
an id, and without terms, give no rows. Scores of 0 are not listed. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_held, release, ship, slices, table, written
from .terms import item_blocks, words_of

K = 50
#: Characters of items that are searched for at once: what driver and workers hold of them.
BLOCK_CHARS = 20_000_000
#: Entries of the forward index that a worker sorts at once; a longer document makes a block of its own.
BLOCK_ENTRIES = 1_000_000
#: Entries that a list is read by in its first turn, and at most; turns double.
FIRST_TURN, LAST_TURN = 64, 4096


def forward_index(documents: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(_id, n, terms, counts) of every document with terms; terms are those of the vocabulary, by its numbers."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        number = shared.value.get
        for batch in batches:
            ids, texts = batch.columns
            for start, end in slices(texts):
                kept, lengths, terms, counts = [], [], [], []
                for at, one in enumerate(texts.slice(start, end - start).cast(pa.binary()).to_pylist()):
                    words = words_of(one) if one else []
                    if words:
                        found = Counter(map(number, words))
                        found.pop(None, None)
                        kept.append(start + at)
                        lengths.append(len(words))
                        terms.append(list(found))
                        counts.append(list(found.values()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["_id", "n", "terms", "counts"])
            release()

    plain = documents.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    return plain.mapInArrow(rows, "_id long, n long, terms array<int>, counts array<int>")


def impacts(weights: np.ndarray, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """w * ((10**9 * tf) div (1000 * tf + 20 * m)) of each entry; lengths: its document's number of terms."""
    if 50 * int(lengths.max(initial=0)) * documents >= 1 << 63:
        lengths = lengths.astype(object)
    m = (50 + (50 * lengths * documents) // total).astype(np.int64)
    return weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


class Block:
    """Some documents' part of the forward index, and the impact-sorted lists of their terms."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impact: np.ndarray, vocabulary: int):
        self.starts, self.terms, self.impact = starts, terms, impact
        owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        order = np.lexsort((-impact, terms))
        order = order[impact[order] > 0]
        self.listed, self.falling = owner[order], impact[order]
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(terms[order], minlength=vocabulary))])
        self.asked = np.zeros(vocabulary, bool)

    def look_up(self, documents: np.ndarray) -> np.ndarray:
        """Whole scores of documents with entries, for the terms asked."""
        first, n = self.starts[documents], np.diff(self.starts)[documents]
        ends = np.cumsum(n)
        at = np.repeat(first - ends + n, n) + np.arange(ends[-1])
        return np.add.reduceat(np.where(self.asked[self.terms[at]], self.impact[at], 0), ends - n)

    def search(self, item: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the block and their scores, the best k of the item among them; what lies below ``least`` need not be found."""
        self.asked[item] = True
        reads, ends = self.lists[item].copy(), self.lists[item + 1]
        seen = np.zeros(len(self.starts) - 1, bool)
        found, scores, turn = [], [], FIRST_TURN
        best = np.zeros(0, np.int64)
        while True:
            open_ = reads < ends
            if not open_.any():
                break
            # no unread document can have more than the next impacts together
            threshold = int(self.falling[reads[open_]].sum())
            kth = max(least, int(best[-1]) if len(best) == k else 0)
            if threshold < kth:
                break
            met = [self.listed[a : min(a + turn, e)] for a, e in zip(reads[open_].tolist(), ends[open_].tolist(), strict=True)]
            reads = np.minimum(reads + turn, ends)
            fresh = np.unique(np.concatenate(met))
            fresh = fresh[~seen[fresh]]
            if len(fresh):
                seen[fresh] = True
                got = self.look_up(fresh)
                found.append(fresh)
                scores.append(got)
                best = -np.sort(-np.concatenate([best, got]))[:k]
            turn = min(2 * turn, LAST_TURN)
        self.asked[item] = False
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, scores = np.concatenate(found), np.concatenate(scores)
        kth = max(least, int(best[-1]) if len(best) == k else 0, 1)
        return found[scores >= kth], scores[scores >= kth]


def ranked_block(index: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, total: int, k: int, entries: int) -> DataFrame:
    """(_item, _id, score): for each item the best k documents of each task."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        items, weights = shared.value
        kept: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (-score, no id, id), ascending

        def take(ids: list[np.ndarray], none: list[np.ndarray], lengths, sizes, terms, counts) -> None:
            ids, none, lengths, sizes, terms, counts = (np.concatenate(x) for x in (ids, none, lengths, sizes, terms, counts))
            impact = impacts(weights, terms, counts.astype(np.int64), np.repeat(lengths, sizes), documents, total)
            block = Block(np.concatenate([[0], np.cumsum(sizes)]), terms, impact, len(weights))
            for q, (_, item) in enumerate(items):
                least = -kept[q][-1][0] if len(kept[q]) == k else 0
                at, score = block.search(item, k, least)
                if len(at):
                    top = np.lexsort((ids[at], none[at], -score))[:k]
                    rows = zip((-score[top]).tolist(), none[at][top].tolist(), ids[at][top].tolist(), strict=True)
                    kept[q] = sorted([*kept[q], *rows])[:k]

        held, n = [[] for _ in range(6)], 0
        for batch in batches:
            ids, lengths, terms, counts = batch.columns
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            parts = [pc.fill_null(ids, 0), pc.is_null(ids), lengths, sizes, terms.flatten(), counts.flatten()]
            parts = [p if isinstance(p, np.ndarray) else p.to_numpy(zero_copy_only=False) for p in parts]
            some = parts[3] > 0
            for held_part, p in zip(held, [*(p[some] for p in parts[:4]), *parts[4:]], strict=True):
                held_part.append(p)
            n += len(parts[4])
            if n >= entries:
                take(*held)
                held, n = [[] for _ in range(6)], 0
                release()
        if n:
            take(*held)
        rows = [(items[q][0], None if none else i, -s) for q, best in enumerate(kept) for s, none, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["_item", "_id", "score"])

    return index.mapInArrow(search, "_item long, _id long, score long")


def ranked_search(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", k: int = K, block_chars: int = BLOCK_CHARS, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(item_key, rank, doc_key, score) of the k best documents of each item."""
    spark = documents.sparkSession
    ship(spark)
    found, n, total = None, None, None
    for some in item_blocks(items.where(F.col(f"`{item_key}`").isNotNull()), item_key, text, F.length("_text"), block_chars):
        vocabulary: dict[bytes, int] = {}
        asked: dict[int, set[int]] = {}
        for row in some.toLocalIterator():  # one block of items
            terms = {vocabulary.setdefault(t, len(vocabulary)) for t in words_of((row["_text"] or "").encode())}
            if terms:
                asked.setdefault(row["_item"], set()).update(terms)
        index = written(forward_index(documents, doc_key, text, vocabulary), "search-index")
        if n is None:
            n, total = index.agg(F.count("*"), F.sum("n")).first()
        holding = np.zeros(len(vocabulary), np.int64)
        for row in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # at most the block's terms
            holding[row["t"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
        lists = [(i, np.array(sorted(t), np.int64)) for i, t in asked.items()]
        part = ranked_block(index, lists, weights, n, total or 1, k, entries)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("_item").alias(item_key), "rank", F.col("_id").alias(doc_key), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, t FROM (SELECT doc_id, {_TERMS.format("text")} AS t FROM documents) WHERE len(t) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * g.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, g.n),
s AS (SELECT q.item_id, d.r, d.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * len(d.t) * g.n) // g.l)))) AS BIGINT) AS score
  FROM p JOIN q USING (term) JOIN w USING (term) JOIN d USING (r), g GROUP BY q.item_id, d.r, d.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {K}
"""
