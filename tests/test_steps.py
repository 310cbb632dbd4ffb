"""Paths of several steps, against paths that are walked one by one; the values of paths."""

import random
from collections import Counter

import pytest

from hireframe.operators import cypher
from hireframe.operators.cypher import CypherError, Graph, Parser


@pytest.mark.parametrize(("steps", "wanted"), [("*", (1, None)), ("*2..", (2, None)), ("*..", (1, None)), ("*1..2", (1, 2)), ("*3", (3, 3)), ("*..60", (1, 60)), ("*0..", (0, None))])
def test_steps_are_read(steps, wanted):
    [(_, [(_, chain)], _, _), _] = Parser(f"MATCH (a)-[:R{steps}]->(b) RETURN a.id").clauses()
    assert chain[1]["steps"] == wanted


def walked(edges, low, high, both=False, start=None):
    """(start, end) of every path that uses no edge twice."""
    out = Counter()

    def go(begin, at, used):
        if len(used) >= low:
            out[begin, at] += 1
        if high is not None and len(used) == high:
            return
        for k, (a, b, *_) in enumerate(edges):
            if k not in used:
                if a == at:
                    go(begin, b, used | {k})
                if both and b == at and a != b:
                    go(begin, a, used | {k})

    for n in "abcde":
        if start is None or n == start:
            go(n, n, frozenset())
    return out


@pytest.fixture(scope="module", params=[1, 2])
def cyclic(request, spark):
    rng = random.Random(request.param)
    edges = list({(rng.choice("abcde"), rng.choice("abcde"), rng.choice("RS")): 0 for _ in range(8)})
    nodes = spark.createDataFrame([(n, ["N"], {"k": n}) for n in "abcde"], "id string, labels array<string>, properties map<string,string>")
    return edges, Graph(nodes, spark.createDataFrame([(*e, {}) for e in edges], "src string, dst string, type string, properties map<string,string>").cache())


@pytest.mark.parametrize(("steps", "low", "high"), [("*2..", 2, None), ("*1..9", 1, 9), ("*0..", 0, None), ("*0..2", 0, 2)])
def test_paths_against_walks(cyclic, steps, low, high):
    edges, graph = cyclic
    got = Counter(tuple(r) for r in graph.query(f"MATCH (x)-[{steps}]->(y) RETURN id(x) AS x, id(y) AS y").collect())
    assert got == walked(edges, low, high)


def test_reach_is_the_set_of_ends(cyclic, monkeypatch):
    edges, graph = cyclic
    monkeypatch.setattr(cypher._Lowering, "walk", _no_paths(cypher._Lowering.walk))
    for steps, low, high in (("*0..", 0, None), ("*1..4", 1, 4)):
        got = [tuple(r) for r in graph.query(f"MATCH (x)-[{steps}]->(y) RETURN DISTINCT id(x) AS x, id(y) AS y").collect()]
        assert len(got) == len(set(got)) and set(got) == set(walked(edges, low, high))
    counts = {r["x"]: r["n"] for r in graph.query("MATCH (x)-[*]->(y) RETURN id(x) AS x, count(DISTINCT y) AS n").collect()}
    assert counts == Counter(x for x, _ in walked(edges, 1, None))


def _no_paths(walk):
    def wrapped(self, *args):
        found, used = walk(self, *args)
        assert used is None  # pairs of ends, not paths
        return found, used

    return wrapped


def test_undirected_and_bound_ends(cyclic):
    edges, graph = cyclic
    got = Counter(tuple(r) for r in graph.query("MATCH (x {k: 'a'})-[*1..4]-(y) RETURN id(x) AS x, id(y) AS y").collect())
    assert got == walked(edges, 1, 4, both=True, start="a")
    ends = {r["y"] for r in graph.query("MATCH (x {k: 'a'})-[*]-(y) RETURN DISTINCT id(y) AS y").collect()}
    assert ends == {y for _, y in walked(edges, 1, None, both=True, start="a")}
    # the pattern is walked from the node that is bound, back to its start
    back = [tuple(r) for r in graph.query("MATCH (y {k: 'b'}) MATCH p = (x)-[*]->(y) RETURN id(x) AS x, id(y) AS y, [n IN nodes(p) | id(n)] AS along").collect()]
    assert Counter((x, y) for x, y, _ in back) == Counter({k: n for k, n in walked(edges, 1, None).items() if k[1] == "b"})
    steps = {(a, b) for a, b, _ in edges}
    for x, y, along in back:
        assert along[0] == x and along[-1] == y and set(zip(along, along[1:], strict=False)) <= steps


def test_edges_stand_once_in_a_match(spark):
    """A walk and a single edge of one MATCH, and two walks, share no edge; edges that differ in a property alone are two."""
    nodes = spark.createDataFrame([(n, [], {}) for n in "ab"], "id string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("a", "b", "R", {"w": "1"}), ("a", "b", "R", {"w": "2"}), ("b", "a", "R", {})], "src string, dst string, type string, properties map<string,string>")
    graph = Graph(nodes, edges)
    one = lambda text: graph.query(text).first()[0]
    assert one("MATCH (x)-[r]->(y)-[s]->(z)-[t]->(w) RETURN count(*) AS n") == 2
    # back from where the edge leads, by paths without it: from b one of three edges, then the other way round
    assert one("MATCH (x)-[r]->(y), (y)-[*]->(x) RETURN count(*) AS n") == 2 + 2
    assert one("MATCH (x)-[r {w: '1'}]->(y), (x)-[s*1..4]->(y) RETURN count(*) AS n") == 1
    assert one("MATCH (x)-[r*1..2]->(y), (x)-[s*1..2]->(y) WHERE x <> y RETURN count(r) AS n") == 2


def test_path_values(spark):
    nodes = spark.createDataFrame([(n, ["N"], {"k": n * 2, "v": "1,2"}) for n in "abc"], "id string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("a", "b", "R", {"w": "1"}), ("b", "c", "S", {})], "src string, dst string, type string, properties map<string,string>")
    graph = Graph(nodes, edges)
    rows = lambda text: sorted((tuple(r) for r in graph.query(text).collect()), key=repr)
    assert rows("MATCH p = (x)-[*]->(y) RETURN length(p) AS n, [m IN nodes(p) | m.k] AS along, [r IN relationships(p) | type(r)] AS kinds") == [(1, ["aa", "bb"], ["R"]), (1, ["bb", "cc"], ["S"]), (2, ["aa", "bb", "cc"], ["R", "S"])]
    assert rows("MATCH p = (x)-[r:R]->(y)-[*0..]->(z) RETURN length(p) AS n, size(nodes(p)) AS m, id(z) AS z, id(head(nodes(p))) AS x") == [(1, 2, "b", "a"), (2, 3, "c", "a")]
    assert rows("MATCH (x) WHERE x.k = 'aa' RETURN range(1, 7, 3) AS r, split(x.v, ',') AS s, replace(x.k, 'a', 'z') AS z, substring(x.k, 1) AS t, size(x.k) AS n, size(split(x.v, ',')) AS m") == [([1, 4, 7], ["1", "2"], "zz", "a", 2, 2)]
    assert rows("MATCH (x) RETURN CASE x.k WHEN 'aa' THEN 'first' ELSE 'other' END AS c, count(*) AS n") == [("first", 1), ("other", 2)]
    assert rows("UNWIND range(1, 3) AS i RETURN [j IN range(1, i) WHERE j > 1 | j * 2] AS l, [5, 6][0] AS a") == [([4, 6], 5), ([4], 5), ([], 5)]
    assert rows("MATCH p = (x {k: 'aa'})-[*]->(y) WITH p, length(p) AS n WHERE n = 2 UNWIND nodes(p) AS m RETURN m.k AS k") == [("aa",), ("bb",), ("cc",)]
    assert rows("MATCH (x)-[r]->(y) WITH r, count(*) AS n OPTIONAL MATCH (z) WHERE z.k = r.w RETURN type(r) AS t, id(z) AS z") == [("R", None), ("S", None)]


def test_untied_patterns_tied_by_rows(spark):
    nodes = spark.createDataFrame([(n, [], {}) for n in "abc"], "id string, labels array<string>, properties map<string,string>")
    graph = Graph(nodes, spark.createDataFrame([("a", "b", "R", {})], "src string, dst string, type string, properties map<string,string>"))
    assert graph.query("MATCH (x) WITH count(x) AS n MATCH (y) RETURN n, id(y) AS y").count() == 3
    with pytest.raises(CypherError):
        graph.query("MATCH (x) WITH x MATCH (y) RETURN id(x) AS x, id(y) AS y")
    with pytest.raises(CypherError):
        graph.query("MATCH (x), (y) WHERE x.k = 'a' RETURN id(x) AS x")
