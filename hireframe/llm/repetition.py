"""Quality rules: base counts of a text and its repeated spans, found by a suffix array.

The words of many documents are laid end to end. Suffixes are sorted by prefix doubling with the
document as the most significant part of the first key, so suffixes of different documents never share
a prefix. The longest common prefixes of neighbours in the sorted order bound the LCP intervals; a
position starts a maximal repeated substring as long as the larger of its two neighbouring values.
Spans of at least ``min_repeat`` words are united: a text is rejected if they cover more than
``max_covered`` of its words, or if the longest repeat alone is more than ``max_longest`` of them.

Defined results: a null or empty text has no words and fails the base rule; texts of any length are
taken whole (the working set is one block of about ``BLOCK_CHARS`` characters, or one longer document); repeated
rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .shared import add_by_block, table

WORD = re.compile(r"[^ \t-\r]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
# Spans lie within repeated windows of three words, of which the base rule already allows no more than half of a text; a
# share that is to decide anything is far below that. For passages of 8 words it is the 0.12 in use for web text.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.12, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: The struct that judge_texts adds.
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"


def repeats(first: np.ndarray) -> np.ndarray:
    """For each position, the length of its longest prefix that also starts at another position.

    first: equal values at two positions mean equal symbols of the same document.
    """
    n = len(first)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = np.argsort(first, kind="stable")
    sorted_first = first[order]
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(sorted_first[1:], sorted_first[:-1], out=starts[1:])
    place = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = place
    levels = [rank.copy()]
    # order[at] holds the suffixes that still share their rank with another
    at = np.flatnonzero(~(starts & np.append(starts[1:], True)))
    step = 1
    while len(at):
        who = order[at]
        nxt = who + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        head = rank[who].astype(np.int64)
        by = np.argsort(head * (n + 1) + second + 1, kind="stable")
        who, head, second = who[by], head[by], second[by]
        order[at] = who
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        # at lists whole groups, each at consecutive places
        rank[who] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append(rank.copy())
        at = at[~(new & np.append(new[1:], True))]
        step *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    common = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        same = (x < n) & (y < n)
        same[same] = levels[k][x[same]] == levels[k][y[same]]
        common[same] += 1 << k
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Marks the positions under a repeated span of at least ``least`` symbols (only its first ``width``)."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (longest[at] if width is None else width), -1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def judge_block(texts: list[str], words: list[list[str]], min_repeat: int, max_covered: float, max_longest: float) -> list[np.ndarray]:
    """The columns of SCHEMA, in their order."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    longest = repeats(doc * np.int64(len(ids) + 1) + flat)
    total = lambda x: np.bincount(doc, weights=x, minlength=len(words)).astype(np.int64)
    in_windows, in_spans = total(covered(longest, 3, 3)), total(covered(longest, min_repeat))
    most = np.zeros(len(words), np.int64)
    np.maximum.at(most, doc, longest)
    failed = (sizes < MIN_WORDS) | (100 * in_windows > MAX_REPEAT_PERCENT * sizes)
    repetitive = (in_spans > max_covered * sizes) | ((most >= min_repeat) & (most > max_longest * sizes))
    return [
        sizes,
        np.fromiter((sum(map(len, ws)) for ws in words), np.int64, len(words)),
        np.fromiter((len(SYMBOL.findall(t)) for t in texts), np.int64, len(texts)),
        np.fromiter(map(duplicate_lines, texts), np.int64, len(texts)),
        in_windows,
        failed,
        in_spans,
        most,
        ~failed & ~repetitive,
    ]


def judge_texts(docs: DataFrame, text: str = "text", into: str = "quality", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """docs with a struct column ``into`` (SCHEMA); all other columns stay as they are."""

    def judge(texts: list[str]) -> list:
        return judge_block(texts, [WORD.findall(t) for t in texts], min_repeat, max_covered, max_longest)

    return add_by_block(docs, text, into, SCHEMA, judge)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_texts(docs).select("doc_id", "quality.*")
