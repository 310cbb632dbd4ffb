"""Faults that a review of the third round found, each with a small case that failed before."""

import inspect

from pyspark.sql import functions as F

from hireframe.functions import dialogue
from hireframe.operators import cypher, extraction
from hireframe.plans import account_queries
from hireframe.sources import readers
from hireframe.streaming import stateful


def _extracted(spark, companies):
    rows = [(k, "t", c, "l-x", None, "long enough text", 2020, None) for k, c in enumerate(companies)]
    df = spark.createDataFrame(rows, "id long, job_title string, company_name string, location string, salary_range string, requirements string, data_year int, created_at timestamp")
    return extraction.extract(extraction.documents(df))


def test_companies_whose_hashes_collide_stay_apart(spark):
    """two names with the same six digits of md5 are two rows of the graph; a load still has one row an id."""
    found: dict = {}
    import hashlib

    pair = next((found[h], n) for n in (f"Customer#{k:09d}" for k in range(40_000)) if (h := hashlib.md5(n.encode()).hexdigest()[:6]) in found or found.setdefault(h, n) is None)
    extracted = _extracted(spark, [*pair, pair[0]])
    names = lambda nodes: sorted(r[0] for r in nodes.where(F.array_contains("labels", "Company")).select(F.col("properties")["name"]).collect())
    assert names(extraction.graph_rows(extracted, apart=True)[0]) == sorted(pair)
    assert names(extraction.graph_rows(extracted)[0]) == [pair[0]]


def test_an_extractor_with_an_expression_gives_the_same_graphs(spark):
    """the rule-based extraction without Python, row by row as the Python rule gives it."""
    rows = [(1, "t", "c", "a-b", "1K", 2020), (2, "", "d", None, None, None), (3, "t", "e", "", "", 0), (4, "t", "f", "-x", "2K", 1999)]
    meta = spark.createDataFrame(rows, "id long, job_title string, company_name string, location string, salary_range string, data_year int")
    docs = meta.select("id", F.struct("*").alias("metadata"))

    def in_python(frame):
        return extraction.rule_based(frame)

    both = [sorted(map(repr, extraction.extract(docs, x).select("id", "graph", "success", "error_msg").collect())) for x in (in_python, extraction.rule_based)]
    assert both[0] == both[1]
    plan = extraction.extract_each(docs)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan


def test_workbooks_beyond_a_sheet_lose_no_row(spark, monkeypatch):
    """more rows than two sheets hold go to more workbooks, packed by tasks; they are read some rows at a time."""
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    monkeypatch.setattr(readers, "SHEET_ROWS", n // 4)
    monkeypatch.setattr(readers.write_xlsx, "__defaults__", (n // 4,))
    assert account_queries.s6(spark, d).count() == n
    assert [tuple(r) for r in account_queries.s7(spark, d).collect()] == [(1, "a.xlsx"), (2, "B.xlsx")]
    assert inspect.isgenerator(readers.sheet_rows(readers.sheet_bytes(["a"], [["b"]])))


def test_normal_form_stays_in_arrow(spark):
    """texts are normalised without Python strings, with the same result."""
    import unicodedata

    texts = ["ＡＢＣ", "e\u0301", "ﬁ㍿", "", None, "a" * 70_000 + "①"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", dialogue.compatible("t").alias("t"))
    assert {r["k"]: r["t"] for r in df.collect()} == {k: unicodedata.normalize("NFKC", t or "") for k, t in enumerate(texts)}
    assert "ArrowEvalPython" in df._jdf.queryExecution().toString() and dialogue.compatible.evalType != F.pandas_udf(lambda x: x, "string").evalType


def test_a_turn_costs_one_read_and_one_write(spark):
    """the store is asked twice a turn, however many calls the turn has."""
    import pandas as pd

    asked = []

    class Store:
        def __init__(self):
            self.value = None

        def get(self):
            asked.append("get")
            return self.value

        def update(self, value):
            asked.append("update")
            self.value = value

    turn = stateful.TurnQuota(12, 2, 5, None)
    turn.turn = Store()
    frame = pd.DataFrame({"seq": [3, 1, 2], "key": ["a", "a", "b"], "kind": "ok", "answered": 1, "trip": 0, "fault": 0})
    made = list(turn.handleInputRows((1, 2), iter([frame]), None))[0]
    assert made[["seq", "decision"]].values.tolist() == [[1, "execute"], [2, "execute"], [3, "duplicate"]]
    assert asked == ["get", "update"] and turn.turn.value == (3, 0, 0, ["a", "b"])


def test_json_is_closed_as_before():
    """brackets are found token by token; texts that are cut within an escape too."""
    for cut, whole in [('{"a": "x[{', '{"a": "x[{"}'), ('{"a": [1, {"b": "\\\\"', '{"a": [1, {"b": "\\\\"}]}'), ('["a\\"b", ', '["a\\"b"]'), ('{"a": "b}"', '{"a": "b}"}'), ("no {", None), ("", None)]:
        assert dialogue.repaired_json(cut) == whole, cut


def test_paths_are_counted_by_their_ends(spark, monkeypatch):
    """Numbers of paths instead of paths, cycles or not; a condition on the start is asked before there are paths."""
    import random

    small = lambda edges: cypher.Graph(spark.createDataFrame([(n, ["N"], {"k": n}) for n in "abcdef"], "id string, labels array<string>, properties map<string,string>"), spark.createDataFrame([(*e, {}) for e in edges], "src string, dst string, type string, properties map<string,string>").cache())
    rng = random.Random(5)
    graphs = [small({(rng.choice("abcd"), rng.choice("abcd"), "R"): 0 for _ in range(7)} | {("e", "a", "R"): 0, ("d", "f", "R"): 0}), small([("a", "b", "R"), ("a", "c", "R"), ("b", "d", "R"), ("c", "d", "R"), ("d", "e", "R")])]
    made = []
    inner = cypher._Lowering.numbers
    monkeypatch.setattr(cypher._Lowering, "numbers", lambda self, *args: made.append(1) or inner(self, *args))
    for graph in graphs:
        for steps, test, arrow in (("*", "", "->"), ("*0..", " WHERE x.k <> 'b' AND y.k <> 'c'", "->"), ("*2..9", " WHERE x.k = 'a'", "->"), ("*1..4", "", "-")):
            of = lambda more, said: sorted(tuple(r) for r in graph.query(f"MATCH (x)-[{more}{steps}]{arrow}(y){test} RETURN {said}").collect())  # noqa: B023,E731
            before = len(made)
            got = of("", "y.k AS y, count(*) AS n")
            assert len(made) == before + 1 and got == of("r", "y.k AS y, count(*) AS n"), (steps, test)
    starts = []
    walk = cypher._Lowering.walk
    monkeypatch.setattr(cypher._Lowering, "walk", lambda self, df, *args: starts.append(df.count()) or walk(self, df, *args))
    graphs[1].query("MATCH p = (x)-[*]->(y) WHERE x.k = 'a' RETURN length(p) AS n")
    assert starts == [1]


def test_reach_looks_pairs_up_seldom(spark, monkeypatch):
    """the pairs so far are read in rounds 1, 2, 4, 8 and so on, and each is given once."""
    nodes = spark.createDataFrame([(str(k), [], {}) for k in range(12)], "id string, labels array<string>, properties map<string,string>")
    edges = [(str(k), str(k + 1)) for k in range(11)] + [("3", "1"), ("2", "5")]
    graph = cypher.Graph(nodes, spark.createDataFrame([(a, b, "R", {}) for a, b in edges], "src string, dst string, type string, properties map<string,string>").cache())
    plans = []
    monkeypatch.setattr(cypher, "written", lambda df, label, inner=cypher.written: plans.append("LeftAnti" in df._jdf.queryExecution().optimizedPlan().toString()) or inner(df, label))
    got = [tuple(r) for r in graph.query("MATCH (x)-[*]->(y) RETURN DISTINCT id(x) AS x, id(y) AS y").collect()]
    after = {str(k): {b for a, b in edges if a == str(k)} for k in range(12)}
    for _ in range(12):
        after = {a: b.union(*(after[x] for x in b)) for a, b in after.items()}
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, bs in after.items() for b in bs}
    assert len(plans) > 8 and sum(plans) <= 5
