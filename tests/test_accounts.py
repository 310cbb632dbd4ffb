"""Accounts, tokens, stored versions, conversation state and workbooks on small cases."""

import pytest
from pyspark.sql import functions as F

from hireframe.operators import accounts as A
from hireframe.operators import quality as Q
from hireframe.sources import readers as R
from hireframe.streaming import incremental as S


def test_passwords():
    made = A.password_hash("a secret", b"salt", 10)
    assert A.password_fits("a secret", made) and not A.password_fits("a secreT", made) and made != A.password_hash("a secret", b"tlas", 10)
    long = "é" * 36  # 72 bytes
    assert A.password_fits(long + "more", A.password_hash(long, rounds=10)) and not A.password_fits(long[:-1], A.password_hash(long, rounds=10))
    assert not A.password_fits("", made) and not A.password_fits(None, made) and not A.password_fits("x", None) and not A.password_fits("x", "no$hash")
    with pytest.raises(ValueError):
        A.password_hash("")


def test_tokens():
    token = A.token_of({"sub": "ann"}, "key", 100)
    assert A.claims_of(token, "key", 99) == {"sub": "ann", "exp": 100}
    assert A.claims_of(token, "key", 100) is None and A.claims_of(token, "other", 99) is None
    assert all(A.claims_of(t, "key", 1) is None for t in (None, "", "a.b.c", token[:-2], "." + token, token.replace(".", "", 1)))


def test_keyed_update(spark, tmp_path):
    path = f"{tmp_path}/t"
    A.save_version(spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, None, 7)], "id int, name string, n int"), path)
    changes = spark.createDataFrame([(1, 5), (2, 9), (3, None), (4, 1)], "id int, n int")
    assert [r["id"] for r in A.update_rows(spark, path, changes, "id", dry_run=True).collect()] == [2]
    assert A._versions(spark, path) == [1]
    A.update_rows(spark, path, changes, "id")
    assert A._versions(spark, path) == [1, 2]
    assert sorted(tuple(r) for r in A.read_version(spark, path).collect()) == [(1, "a", 5), (2, "b", 9), (3, None, 7)]
    (tmp_path / "t" / "v=3").mkdir()  # an unfinished version does not count
    assert A._versions(spark, path) == [1, 2]


def test_fallback_and_thread_state(spark):
    chunks = spark.createDataFrame([(1, 1, "a"), (1, 2, "")], "thread long, seq long, content string")
    results = spark.createDataFrame([(1, "x"), (2, "whole")], "thread long, content string")
    assert sorted(tuple(r) for r in S.with_fallback(chunks, results).collect()) == [(1, 1, "a"), (1, 2, ""), (2, 0, "whole")]
    rows = lambda *seqs: spark.createDataFrame([(1, s, "user", str(s)) for s in seqs], "thread long, seq long, role string, content string")
    state = S.merge_thread_state(S.merge_thread_state(None, rows(1, 2, 3, 9), 3), rows(4, 5), 3).first()
    assert (state["messages"], state["last_seq"], [m["seq"] for m in state["tail"]]) == (6, 9, [9, 5, 4])


def test_workbook_and_its_fallback(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b"), (2, None)], "id int, `名称` string")
    assert R.write_xlsx(df, f"{tmp_path}/x.xlsx") == "xlsx"
    assert [(r["id"], r["名称"]) for r in R.read_xlsx(spark, f"{tmp_path}/x.xlsx").collect()] == [("1", "a<b"), ("2", None)]
    assert R.write_xlsx(df, f"{tmp_path}/y.xlsx", most=1) == "csv"
    assert R.read_csv(spark, f"{tmp_path}/y.xlsx.csv", "id int, name string").count() == 2


def test_clicked_cards_stop_at_an_empty_page(spark):
    rows = [("k", p, i, f"j{p}{i}" if i else "same") for p in (1, 2, 4) for i in range(3)]
    out = S.clicked_cards(spark.createDataFrame(rows, "keyword string, page int, pos int, jid string"), per_page=1)
    assert sorted(r["jid"] for r in out.collect()) == ["j11", "j21", "same"]


def test_others_of_the_unparsed(spark):
    rows = [("面议%d" % (i % 7),) for i in range(20)]
    listings = spark.createDataFrame(rows, "salary_range string").withColumn("salary_avg", F.lit(None).cast("int"))
    out = {r["format"]: (r["cnt"], r["formats"]) for r in Q.unparsed_report(listings, 2).collect()}
    assert out["others"] == (14, 5) and len(out) == 3
