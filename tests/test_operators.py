"""Properties of operators: independence of partitioning, idempotence, streams, sources, patterns."""

import random

import pytest
from pyspark.sql import functions as F

from hireframe.operators import conversation, etl, extraction, graph
from hireframe.operators.cypher import CypherError, Graph
from hireframe.sources import readers
from hireframe.streaming import incremental


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def sheet(spark):
    data = [(i, f"{i % 7}.0" if i % 2 else f" {i % 7}", None if i % 3 else " ", "x" * (i % 5) if i % 4 else "", "x" * (i % 4)) for i in range(60)] + [(60, None, "a", "b", "c"), (61, "", "a", "b", "c")]
    return spark.createDataFrame(data, "ord long, jid string, company string, d string, r string")


@pytest.mark.parametrize("parts", [1, 7, 16])
def test_merge_ignores_partitioning(sheet, parts):
    once = etl.merge_by_id(sheet, "jid", "ord", "d", "r")
    assert rows(etl.merge_by_id(sheet.repartition(parts), "jid", "ord", "d", "r")) == rows(once)
    again = once.withColumn("ord", F.lit(1))
    assert rows(etl.merge_by_id(again, "jid", "ord", "d", "r")) == rows(once)


def test_surrogate_ids(spark):
    df = spark.range(100).withColumn("k", -F.col("id")).drop("id").repartition(5)
    got = etl.with_surrogate_ids(df, ["k"], 10).orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(11, 111))


def test_location_fold(spark):
    def read(names):
        """The rule, read name by name."""
        key = names[0].replace("市", "").replace("省", "")
        name = names[0]
        for n in names[1:]:
            if len(n) < len(name) or (name == key and n != key):
                name = n
        return name

    rng = random.Random(3)
    for _ in range(12):
        names = [rng.choice(["武汉", "武汉市", "武汉省", "武汉省市"]) for _ in range(rng.randint(1, 6))]
        nodes = spark.createDataFrame([(i, f"l{i}", "Location", {"name": n}) for i, n in enumerate(names)], "ord long, id string, type string, properties map<string,string>")
        assert graph.merge_locations(graph.clean_locations(nodes)).first()["name"] == read(names), names


def test_load_twice(spark):
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, ord long")
    empty = nodes.limit(0)
    first = graph.new_nodes(nodes, empty)
    assert rows(first) == ["Row(id='a', ord=1)", "Row(id='b', ord=3)"]
    assert graph.new_nodes(nodes, first).count() == 0
    edges = spark.createDataFrame([("a", "b", "T", {"x": "1"}), ("a", "b", "T", {"x": "1"}), ("a", "c", "T", {}), (None, "b", "T", {})], "src string, dst string, type string, properties map<string,string>")
    loaded = graph.new_edges(edges, first, edges.limit(0))
    assert loaded.count() == 1 and graph.new_edges(edges, first, loaded).count() == 0
    assert graph.load_stats(edges, first).first().asDict() == {"edges": 4, "missing_field": 1, "missing_end": 1, "loadable": 2, "first_missing_end": "a T c"}


def test_supplement(spark):
    nodes = spark.createDataFrame([(1, "p1", "JobPosting"), (1, "p2", "JobPosting"), (1, "c", "Company"), (1, "l1", "Location"), (1, "l2", "Location")], "batch int, id string, type string")
    none = spark.createDataFrame([], "batch int, src string, dst string, type string")
    assert sorted(r["type"] for r in graph.supplement_edges(nodes, none).collect()) == ["OFFERED_BY", "OFFERED_BY"]


def test_budget(spark):
    m = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 4, 3, 2])], "thread int, seq int, t int")
    assert [r["t"] for r in conversation.within_budget(m, "t", 6).orderBy("seq").collect()] == [3, 2]
    assert conversation.within_budget(m, "t", 0).count() == 4


def brute_repair(messages):
    out, pending = [], set()

    def undo():
        while out and out[-1]["role"] == "tool":
            out.pop()
        for m in reversed(out):
            if m["role"] == "assistant" and m["calls"]:
                m["calls"] = []
                break

    for m in messages:
        m = dict(m)
        if m["role"] == "assistant":
            out.append(m)
            pending = set(m["calls"] or [])
        elif m["role"] == "tool":
            if m["tool_call_id"] in pending:
                out.append(m)
                pending.discard(m["tool_call_id"])
        else:
            if pending:
                undo()
            out.append(m)
            pending = set()
    if pending:
        undo()
    return [(m["seq"], m["role"], m["calls"] or []) for m in out]


def test_repair_rounds(spark):
    rng = random.Random(5)
    threads, wanted = [], {}
    for t in range(40):
        ms = []
        for s in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "assistant", "tool", "tool", "tool", "system"])
            ms.append({"thread": t, "seq": s, "role": role, "content": "x", "calls": rng.choice([[], ["a"], ["a", "b"]]) if role == "assistant" else None, "tool_call_id": rng.choice(["a", "b", "c"]) if role == "tool" else None})
        threads += ms
        wanted[t] = brute_repair(ms)
    df = spark.createDataFrame(threads, "thread long, seq long, role string, content string, calls array<string>, tool_call_id string")
    got = {}
    for r in conversation.repaired_rounds(df).orderBy("thread", "seq").collect():
        got.setdefault(r["thread"], []).append((r["seq"], r["role"], list(r["calls"] or [])))
    assert got == {t: w for t, w in wanted.items() if w}


def test_event_sequence(spark):
    events = spark.createDataFrame(
        [("t", 1, "on_tool_start", "kg", " MATCH ", None, None, None), ("t", 2, "on_tool_end", "kg", None, "x" * 500, None, None), ("t", 3, "on_chat_model_stream", None, None, None, None, "答"), ("t", 4, "on_chat_model_stream", None, None, None, None, ""), ("t", 5, "other", None, None, None, None, None)],
        "thread string, seq int, event string, name string, query string, output string, error string, content string",
    )
    out = incremental.agent_events(events).orderBy("seq").collect()
    assert [r["type"] for r in out] == ["tool_start", "tool_end", "chunk"]
    assert out[0]["cypher_preview"] == "MATCH" and len(out[1]["output_preview"]) == 401 and out[2]["content"] == "答"
    assert [r["content"] for r in incremental.text_events(events).collect()] == ["答"]


def test_stream_resumes(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(10).write.parquet(source)
    assert incremental.append_batches(incremental.parquet_stream(spark, source), out, mark).count() == 10
    spark.range(10, 15).write.mode("append").parquet(source)
    assert sorted(r[0] for r in incremental.append_batches(incremental.parquet_stream(spark, source), out, mark).collect()) == list(range(15))


def test_state():
    old = incremental.migrated_state({"processed_ids": [1, 5, 3], "failed_ids": [2]})
    assert old == {"last_extracted_id": 5, "last_imported_id": 5, "failed_ids": [2]}
    assert incremental.advanced_state(old, {"max_id": 9, "failed": [7], "succeeded": [2]}) == {"last_extracted_id": 9, "last_imported_id": 9, "failed_ids": [7]}


def test_xlsx_round_trip(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(readers.sheet_bytes(["职位ID", "x"], [["1", "a<b"], ["2", None]]))
    (tmp_path / "A.xlsx").write_bytes(readers.sheet_bytes(["x", "y"], [["p", "q"]]))
    (tmp_path / "~$b.xlsx").write_bytes(b"lock")
    df = readers.read_xlsx(spark, str(tmp_path))
    assert df.columns == ["_file", "_row", "x", "y", "职位ID"]
    assert [tuple(r) for r in df.orderBy("_file", "_row").collect()] == [("A.xlsx", 0, "p", "q", None), ("b.xlsx", 0, "a<b", None, "1"), ("b.xlsx", 1, None, None, "2")]


def test_csv_and_pages(spark, tmp_path):
    spark.createDataFrame([("a", 'x "y"\nz')], "k string, t string").write.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert readers.load_listings(spark, "csv", path=str(tmp_path / "c")).first()["t"] == 'x "y"\nz'
    pages = spark.createDataFrame([('{"zpData":{"page":2,"jobList":[{"jobName":"n","jobDesc":" ","jobDescription":"d"}]}}',), ("broken",)], "body string")
    jobs = readers.list_jobs(pages).collect()
    assert len(jobs) == 1 and jobs[0]["职位ID"] == "n__" and jobs[0]["职位描述"] == "d"
    assert readers.paragraphs_of("<p>short<p class='label'>a long label text<p>a paragraph that is long") == ["a paragraph that is long"]


def test_extraction_failure_is_kept(spark):
    rows_ = spark.createDataFrame([(1, "t", "c", "l-x", None, "long enough text", 2020, None)], "id long, job_title string, company_name string, location string, salary_range string, requirements string, data_year int, created_at string")
    docs = extraction.documents(rows_)
    assert docs.first()["page_content"].startswith("公司名称：c\n工作地点：l-x\n职位名称：t\n年份：2020\n\n")

    def broken(frame):
        raise ValueError("no")

    out = extraction.extract(docs, broken).first()
    assert not out["success"] and out["error_msg"] == "no"
    good = extraction.extract(docs)
    hits, misses = extraction.split_cached(docs, extraction.cache_rows(good))
    assert hits.count() == 1 and misses.count() == 0


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = spark.createDataFrame([("a", ["P"], {"n": "1"}), ("b", ["P", "Q"], {"n": "2"}), ("c", [], {})], "id string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("a", "b", "R", {}), ("b", "c", "R", {}), ("a", "a", "S", {}), ("c", "a", "R", {"w": "5"})], "src string, dst string, type string, properties map<string,string>")
    return Graph(nodes, edges)


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("MATCH (x)-[r]-(y) RETURN count(r) AS n", [(7,)]),
        ("MATCH (x)-->(y)-->(z) RETURN id(x) AS x, id(z) AS z", [("a", "c"), ("b", "a"), ("c", "a"), ("c", "b"), ("a", "b")]),
        ("MATCH (x {n: '1'})-[*1..3]->(y) RETURN id(y) AS y, count(*) AS n", [("a", 2), ("b", 2), ("c", 2)]),
        ("MATCH (x) OPTIONAL MATCH (x)-[:S]->(y) RETURN id(x) AS x, y.n AS n", [("a", "1"), ("b", None), ("c", None)]),
        ("MATCH (x) WHERE x.n IS NULL OR x.n > 1 RETURN id(x) AS x", [("b",), ("c",)]),
        ("UNWIND [1, 2, 2] AS k WITH k, count(*) AS n WHERE n > $least RETURN k, n", [(2, 2)]),
        ("MATCH (x)-[r:R {w: '5'}]->() RETURN type(r) AS t, r.w + 1 AS w", [("R", 6.0)]),
        ("MATCH (x:P), (y:Q) WHERE x.n = y.n RETURN DISTINCT id(y) AS y", [("b",)]),
        ("MATCH (x) RETURN x.n AS n ORDER BY n DESC LIMIT 2", [(None,), ("2",)]),
        ("RETURN 1 + 2 * 3 AS v", [(7,)]),
    ],
)
def test_patterns(small_graph, source, wanted):
    assert sorted(map(repr, (tuple(r) for r in small_graph.query(source, {"least": 1}).collect()))) == sorted(map(repr, wanted))


def test_untied_patterns(small_graph):
    source = "MATCH (x:P), (y:Q) RETURN DISTINCT id(y) AS y"
    with pytest.raises(CypherError):
        small_graph.query(source)
    assert [tuple(r) for r in Graph(small_graph.nodes, small_graph.edges, cross=True).query(source).collect()] == [("b",)]


@pytest.mark.parametrize("source", ["MATCH (n) SET n.x = 1 RETURN n", "CALL db.labels()", "RETURN 1; RETURN 2", "MATCH (n)", "MATCH (n) RETURN $missing", "MATCH (n RETURN n"])
def test_refused(small_graph, source):
    with pytest.raises(CypherError):
        small_graph.query(source)


def test_graph_build_resumes(spark, tmp_path):
    from hireframe.streaming import graph_stream

    columns = "id long, job_title string, company_name string, salary_range string, location string, requirements string, data_year int, created_at string"
    rows_ = lambda ids: spark.createDataFrame([(i, "t", f"company {i % 2}", "3-4K", "北京-x", "long enough text", 2020, None) for i in ids], columns)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows_(range(4)).coalesce(1).write.parquet(source)

    def some(frame):
        if any(m["id"] == 3 for m in frame["metadata"]):
            raise ValueError("no")
        return extraction.rule_based(frame)

    graph_stream.build_graph(incremental.parquet_stream(spark, source), out, mark, some)
    assert graph_stream.stored(spark, out, "failed").count() == 4  # the batch that held the bad row
    graph_stream.retry_failed(rows_(range(4)), out, -1)
    rows_(range(4, 6)).coalesce(1).write.mode("append").parquet(source)
    nodes, edges = graph_stream.build_graph(incremental.parquet_stream(spark, source), out, mark)
    labels = sorted((r["labels"][0], r["count"]) for r in nodes.groupBy("labels").count().collect())
    assert labels == [("Company", 2), ("JobPosting", 6), ("Location", 1), ("Year", 1)]
    assert edges.count() == 18 and nodes.select("id").distinct().count() == nodes.count()
