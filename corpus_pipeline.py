"""Corpus pipeline: documents -> quality rules -> toxicity -> near-duplicates -> packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which is what the stage before kept.
All but the last return the columns of docs, whatever their names (a dot in them, or the names used here).
``run`` writes what each stage returns and reads it again. Nulls, empty and long texts, ties and repeated rows
are treated as the operators' modules state; rows without an id are never duplicates; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireframe.llm.near_dup import BROADCAST_IDS, group_near_duplicates
from hireframe.llm.packing import pack_documents
from hireframe.llm.repetition import judge_texts
from hireframe.llm.shared import absent, columns, table, written
from hireframe.llm.toxicity import score_texts, trained_on

#: Near-duplicates of the pipeline share 80 percent of their shingles of five words.
SHINGLE = 5
#: Words that a packing worker keeps; fewer than the operator keeps when it runs alone, as other stages have grown the heap.
CACHE_WORDS = 250_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base counts or the repetition rule reject."""
    [into] = absent(docs, "_quality")
    return judge_texts(docs, into=into).where(F.col(f"{into}.kept")).select(*columns(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted to be toxic, by a model of the folder's labelled rows that are not held out."""
    [into] = absent(docs, "_toxicity")
    return score_texts(docs, trained_on(spark, sf_dir), into=into).where(F.col(f"{into}.predicted") == 0).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; rows without an id cannot be named and stay."""
    [name] = absent(docs, "_gone")
    groups = group_near_duplicates(docs, width=SHINGLE)
    gone = written(groups.where("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "pipeline-gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col(name), "left_anti").select(*columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences."""
    return pack_documents(docs, keep_ids=False, cache_words=CACHE_WORDS)


STAGES = [("quality_rules", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: No stage but the counts of the first can be stated in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
