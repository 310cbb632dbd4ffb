"""Searches that read few files give the rows of searches that read all; provinces are matched without a nested loop."""

import random

from pyspark.sql import functions as F

from hireframe.functions.geo import city_name
from hireframe.operators import listings as L
from hireframe.operators import search_index as I


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_indexed_search(spark, tmp_path):
    rng = random.Random(4)
    words = ["Dev", "ops", "Ärzte", "北京市", "100%", "a_b", "x", None, ""]
    data = [(i, rng.choice(words), f"Company {i // 10:03d}", "上海-" + str(i % 7), rng.choice(words), rng.choice(words), 2020 + i % 3) for i in range(300)]
    columns = ["job_title", "company_name", "location", "requirements", "search_keyword"]
    df = spark.createDataFrame(data, "id long, job_title string, company_name string, location string, requirements string, search_keyword string, data_year int")
    path = str(tmp_path / "index")
    I.save_searchable(df, path, columns, ["company_name"], rows=20)
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) >= 15
    for asked in (
        {"company_name": "COMPANY 01"}, {"company_name": "y 0_1"}, {"company_name": "%pany%29%"}, {"company_name": "no such"}, {"company_name": "7"},
        {"search_keyword": "ärz"}, {"search_keyword": "北京市"}, {"search_keyword": "京市"}, {"search_keyword": "y 017"},
        {"company_name": "Company 02", "job_title": "dev", "data_year": 2021}, {"location": "上海-3", "company_name": "y 00"}, {},
    ):
        assert rows_of(I.search_indexed(spark, path, **asked)) == rows_of(L.search(df, **asked)), asked
    assert len(I.files_of(spark, path, {"company_name": "Company 017"})) <= 3
    assert I.files_of(spark, path, {"company_name": "no such"}) == []
    assert len(I.search_indexed(spark, path, company_name="Company 017").inputFiles()) <= 3


def brute_province(location, cities):
    where, city = location[0], location[1]
    exact = [f for s, f, _ in cities if s == city]
    if exact:
        return exact[0]
    alias = [(o, f) for s, f, o in cities if s.endswith("市") and s[:-1] == city]
    if alias:
        return max(alias)[1]
    found = [(o, f) for s, f, o in cities if s in where or city in s or s in city]
    return min(found)[1] if found else "未知"


def test_provinces_against_all_pairs(spark):
    rng = random.Random(6)
    for k, letters in enumerate(["ab", "ab市c", "abcdefgh市-"]):
        names = list({"".join(rng.choices(letters.replace("-", ""), k=rng.choice([1, 2, 3, 4, 6]))) for _ in range(25)} | ({""} if k == 1 else set()))
        rng.shuffle(names)
        cities = [(n, f"province {i}", i) for i, n in enumerate(names)]
        places = sorted({"".join(rng.choices(letters + "xyz- ", k=rng.choice([1, 2, 3, 5, 9]))) for _ in range(120)} | {"-a", " ", "市"})
        frame = spark.createDataFrame([(p,) for p in places], "location string")
        table = spark.createDataFrame(cities, "short_name string, full_name string, ord int")
        named = {r["location"]: (r["w"], r["c"]) for r in frame.select("location", F.trim("location").alias("w"), city_name(F.col("location")).alias("c")).collect()}
        got = {r["location"]: r["province"] for r in L.match_provinces(frame, table).collect()}
        assert got == {p: brute_province(named[p], cities) for p in places}
    plan = L.match_provinces(frame, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
