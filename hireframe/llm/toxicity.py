"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: lower case, compatibility forms and accents away, homoglyphs of other scripts and digits or signs
that stand for letters to those letters. The lexicon holds word beginnings and whole words with the log
ratio of their document frequencies under the two labels. Of the entries that match at one word the longest
counts. Exceptions take a match away: words that extend an entry but are not toxic themselves, and phrases of
two or three words around a match that clean documents use. A text's sums, in which the n-th use of
an entry weighs 1/n, are normalised by its length, and a logistic curve fitted on the same
labelled sample turns them into a score.

Training reads a bounded sample, which is a documented parameter: the ``SAMPLE`` labelled documents whose
id hashes lowest (all, if fewer). Pattern counts are made in a distributed way; the driver gets the entries and
exceptions, all of them, which the sample alone bounds (each stands in at least ``MIN_DOCUMENTS`` of its
documents), and one row of three numbers per sampled document. Scoring covers every whole text.

Defined results: a null or empty text scores the curve's value for no match; a null doc_id is never used
for training; repeated rows score alike; without labels of both kinds every score is 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import add_by_block, small_batches, table

SAMPLE = 6000
#: Lengths of word beginnings; least documents with label 1; least log ratio of an entry, and below which an extension is an exception.
PREFIXES, MIN_DOCUMENTS, MIN_RATIO, EXCEPTION_RATIO = range(3, 11), 4, 2.5, 0.5
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = str.maketrans("абвгдеёзикмнопрстухѕіјԁһѡαβγεικνορτυχωı0134578@$!|", "abbrdee3ukmhonpctyxsijdhwabyeiknoptuxwioieastbasii")
WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The text's words, folded, between single spaces, with a space at both ends."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " " + " ".join(WORDS.findall(text.translate(HOMOGLYPHS))) + " "


def patterns(folded: str) -> set[str]:
    """The word beginnings and whole words of a folded text, each after a space."""
    words = set(folded.split())
    return {f" {w[:k]}" for w in words for k in PREFIXES if len(w) >= k} | {f" {w} " for w in words if len(w) >= PREFIXES[0]}


class Lexicon:
    """Entries with weights; weight 0 marks an exception, one of several words a phrase."""

    def __init__(self, entries: dict[str, float]):
        self.entries = entries
        self.automaton = ahocorasick.Automaton()
        for text, weight in entries.items():
            self.automaton.add_word(text, (len(text), weight, " " in text[1:-1]))
        if entries:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> dict[int, tuple[int, float]]:
        """(size, weight) of the longest entry at each place where one starts, but where an exception phrase covers it."""
        found: dict[int, tuple[int, float]] = {}
        if not self.entries:
            return found
        covered: set[int] = set()
        for end, (size, weight, phrase) in self.automaton.iter(folded):
            start = end - size + 1
            if phrase:
                covered.update(at for at in range(start, end) if folded[at] == " ")
            elif size > found.get(start, (0, 0.0))[0]:
                found[start] = (size, weight)
        return {at: x for at, x in found.items() if x[1] and at not in covered}

    def features(self, text: str) -> tuple[float, float]:
        """log(1 + sum of weights), and the sum for each hundred words, below 100 words as if there were 100."""
        folded = fold(text)
        # a word that is repeated on end weighs little more than once
        times = Counter((folded[at : at + size], w) for at, (size, w) in self.matches(folded).items())
        total = sum(w * (1 + math.log(n)) for (_, w), n in times.items())
        n = folded.count(" ") - 1
        return math.log1p(total), 100 * total / max(n, 100)

    def phrases(self, folded: str) -> set[str]:
        """The two or three words around each match, between spaces."""
        out = set()
        for at in self.matches(folded):
            end = folded.index(" ", at + 1)
            before = folded.rfind(" ", 0, at) if at else -1
            after = folded.find(" ", end + 1)
            out |= {folded[i : j + 1] for i, j in ((before, end), (at, after), (before, after)) if i >= 0 and j >= 0}
        return out


class PhraseFinder:
    """Lexicon.phrases as a function that can be sent to the workers."""

    def __init__(self, entries: dict[str, float]):
        self.entries, self._lexicon = entries, None

    def __getstate__(self):
        return self.entries

    def __setstate__(self, state):
        self.__init__(state)

    def __call__(self, folded: str) -> set[str]:
        self._lexicon = self._lexicon or Lexicon(self.entries)
        return self._lexicon.phrases(folded)


class ToxicityModel:
    def __init__(self, entries: dict[str, float], curve: list[float]):
        self.entries, self.curve = entries, curve
        self._lexicon: Lexicon | None = None

    def __getstate__(self):
        return self.entries, self.curve

    def __setstate__(self, state):
        self.entries, self.curve = state
        self._lexicon = None

    def score(self, text: str) -> float:
        if not self.curve:
            return 0.0
        self._lexicon = self._lexicon or Lexicon(self.entries)
        x = np.array([1.0, *self._lexicon.features(text)])
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -30, 30))))


def fit_curve(features: np.ndarray, labels: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> list[float]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def choose_entries(counts: pd.DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Lexicon from rows (pattern, toxic, clean): numbers of documents."""
    ratio = np.log((counts["toxic"] + 0.5) / (n_toxic + 1)) - np.log((counts["clean"] + 0.5) / (n_clean + 1))
    rated = dict(zip(counts["pattern"], ratio, strict=True))
    seen = dict(zip(counts["pattern"], counts["toxic"], strict=True))
    entries = {p: float(r) for p, r in rated.items() if r >= MIN_RATIO and seen[p] >= MIN_DOCUMENTS}
    for p, r in rated.items():
        if r < EXCEPTION_RATIO and any(p[:k] in entries for k in range(2, len(p))):
            entries[p] = 0.0
    return entries


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Fits lexicon and curve on the ``sample`` rows of labelled (key, text, label) whose keys hash lowest."""
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(key).alias("_at"))
    rows = rows.orderBy("_at").limit(sample).select("text", "label").repartition(max(1, spark.sparkContext.defaultParallelism)).cache()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        rows.unpersist()
        return ToxicityModel({}, [])

    def counted(patterns_of) -> DataFrame:
        """(pattern, toxic, clean, ratio): documents of the sample with a pattern, and the log ratio of their shares."""

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for frame in frames:
                for body, kind in zip(frame["text"], frame["label"], strict=True):
                    seen[int(kind)].update(patterns_of(fold(body or "")))
            names = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"pattern": names, "toxic": [seen[1][x] for x in names], "clean": [seen[0][x] for x in names]})

        counts = rows.mapInPandas(count, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        return counts.withColumn("ratio", F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1)))

    counts = counted(patterns).cache()
    entries = counts.where((F.col("ratio") >= MIN_RATIO) & (F.col("toxic") >= MIN_DOCUMENTS)).orderBy("pattern").toPandas()
    # exceptions: frequent extensions of an entry that speak for label 0
    heads = spark.createDataFrame([(p,) for p in entries["pattern"] if not p.endswith(" ")] or [("",)], "head string")
    heads_of = F.transform(F.sequence(F.lit(PREFIXES[0] + 1), F.greatest(F.length("pattern") - 1, F.lit(PREFIXES[0] + 1))), lambda k: F.substring("pattern", F.lit(1), k))
    mild = (F.col("ratio") < EXCEPTION_RATIO) & (F.col("clean") >= MIN_DOCUMENTS)
    extending = counts.where(mild).withColumn("head", F.explode(heads_of)).join(F.broadcast(heads), "head", "left_semi")
    extending = extending.where(F.length("head") < F.length("pattern")).select("pattern", "toxic", "clean", "ratio").distinct().toPandas()
    lexicon = choose_entries(pd.concat([entries, extending], ignore_index=True), n_toxic, n_clean)
    counts.unpersist()
    # exception phrases: words around what still matches, as clean documents put them
    if lexicon:
        said = counted(PhraseFinder(lexicon)).where(mild).select("pattern").orderBy("pattern").toPandas()
        lexicon |= dict.fromkeys(said["pattern"], 0.0)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Lexicon(lexicon)
        for frame in frames:
            made = [matcher.features(body or "") for body in frame["text"]]
            yield pd.DataFrame({"a": [x[0] for x in made], "b": [x[1] for x in made], "label": frame["label"].to_numpy()})

    measured = rows.mapInPandas(measure, "a double, b double, label int").toPandas()
    rows.unpersist()
    return ToxicityModel(lexicon, fit_curve(measured[["a", "b"]].to_numpy(), measured["label"].to_numpy()))


def score_texts(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct (score, predicted); all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the training sample

    def judge(texts: list[str]) -> list:
        scores = [shared.value.score(t) for t in texts]
        return [scores, [int(s >= threshold) for s in scores]]

    return add_by_block(docs, text, into, "score double, predicted int", judge)


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows that training must not see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained_on(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    """The model of a table folder: its labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).where(F.col("toxic").isin(0, 1))
    # the lowest hashes are chosen before the texts are fetched; the rest of the documents are not moved
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return train(docs.join(F.broadcast(chosen), "doc_id"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, trained_on(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "toxicity.score", "toxicity.predicted")
