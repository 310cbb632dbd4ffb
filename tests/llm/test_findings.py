"""Faults of the training-data operators that a review of the third round found, each with a small case that failed before."""

import random
import time

import pyarrow as pa
import pytest

from hireframe.llm import bpe, near_dup, packing, repetition, toxicity


def test_repeated_passages_decide_where_the_base_rule_does_not(spark):
    """a text that passes the base rule goes for a passage said twice; it stays when the passage is not repeated."""
    rng = random.Random(3)
    words = lambda n: [str(rng.random()) for _ in range(n)]
    passage = words(12)
    texts = [" ".join([*words(40), *passage, *words(40), *passage, *words(40)]), " ".join([*words(40), *passage, *words(92)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["quality"]["base_failed"], r["quality"]["kept"]) for r in repetition.judge_texts(df).collect()}
    assert got == {0: (False, False), 1: (False, True)}


def test_words_that_were_not_seen_are_merged_by_the_library():
    """op6: the packing's encoder gives the operator's ids, in less time for words that no table holds."""
    source = open(bpe.vocabulary_path(), encoding="utf-8").read()
    slow, fast = bpe.WordBpe(source), bpe.LibraryBpe(source)
    for text in ["", "a<|endoftext|> b", "ΑΣ Σ it'S WE'LL", "ahaha" * 5000, "日本語😀 é ﬁ ² İ ñ́", "\x1c a\x85b", "!!!... 0123 x___y", "y" * 64 + " z" * 65]:
        assert fast.encode_ids(text) == slow.encode_ids(text)
        assert fast.encode(text) == slow.encode(text)
    rng = random.Random(6)
    words = " ".join("".join(rng.choices("etaoinshrdlu", k=12)) for _ in range(20_000))
    spent, ids = [], []
    for encoder in (slow, fast):
        before = time.process_time()
        ids.append(encoder.encode_ids(words))
        spent.append(time.process_time() - before)
    assert ids[0] == ids[1] and spent[1] < 0.7 * spent[0]


@pytest.mark.parametrize("operator", [repetition.judge_texts, lambda df: toxicity.score_texts(df, toxicity.ToxicityModel({}, [])), near_dup.group_near_duplicates, packing.pack_documents])
def test_executors_hold_a_few_mb_of_texts_for_a_python_step(spark, operator):
    """whole texts went to Python in batches of up to 64 MB, several times that outside an executor's heap; longer ones still go whole."""
    session = spark.newSession()
    sizes = [9_000_000] + [1_000_000] * 12
    df = session.range(len(sizes), numPartitions=1).selectExpr("id AS doc_id", f"repeat('ab ', element_at(array({', '.join(str(n // 3) for n in sizes)}), int(id) + 1)) AS text")

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "size"])

    operator(df)
    seen = df.mapInArrow(measure, "rows long, size long").collect()
    assert sum(r["rows"] for r in seen) == len(sizes) and sum(r["size"] for r in seen) > sum(sizes) - 3 * len(sizes)
    assert all(r["size"] < 6_000_000 for r in seen if r["rows"] > 1)


def test_a_sessions_own_bound_of_batches_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    repetition.judge_texts(session.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
