"""Queries on the property graph; postings are orders, companies customers, skills parts, places nations and regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import guards
from ..operators import graph as G
from ..operators.cypher import Graph
from ..scratch import fresh_path
from . import views as V
from .catalogue import query


def nodes(spark, d):
    def kind(df, label, key, **props):
        pairs = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
        return df.select(F.concat(F.lit(f"{label}_"), F.col(key).cast("string")).alias("id"), F.array(F.lit(label)).alias("labels"), F.create_map(*pairs).alias("properties"))

    t = lambda n: V.table(spark, d, n)
    orders = t("orders").withColumn("price", F.floor("o_totalprice").cast("long"))
    years = t("orders").select(F.year("o_orderdate").alias("y")).distinct()
    parts = [
        kind(orders, "JobPosting", "o_orderkey", name="o_orderpriority", salary="price"),
        kind(t("customer"), "Company", "c_custkey", name="c_name", industry="c_mktsegment"),
        kind(t("part"), "Skill", "p_partkey", name="p_name", skill_type="p_type"),
        kind(t("nation"), "Location", "n_name", name="n_name"),
        kind(t("region"), "Location", "r_name", name="r_name"),
        kind(years, "Year", "y", name="y"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def edges(spark, d):
    t = lambda n: V.table(spark, d, n)
    none = F.create_map().cast("map<string,string>")

    def kind(df, src, skey, name, dst, dkey, props=None):
        return df.select(F.concat(F.lit(f"{src}_"), F.col(skey).cast("string")).alias("src"), F.concat(F.lit(f"{dst}_"), F.col(dkey).cast("string")).alias("dst"), F.lit(name).alias("type"), (none if props is None else props).alias("properties"))

    nation, region = t("nation"), t("region")
    homes = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    orders = t("orders").withColumn("y", F.year("o_orderdate"))
    placed = orders.join(homes.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    parts = [
        kind(orders, "JobPosting", "o_orderkey", "OFFERED_BY", "Company", "o_custkey"),
        kind(lines, "JobPosting", "l_orderkey", "REQUIRES_SKILL", "Skill", "l_partkey", F.create_map(F.lit("proficiency_level"), F.col("l_returnflag"))),
        kind(homes, "Company", "c_custkey", "LOCATED_IN", "Location", "n_name"),
        kind(placed, "JobPosting", "o_orderkey", "LOCATED_IN", "Location", "n_name"),
        kind(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")), "Location", "n_name", "BELONGS_TO", "Location", "r_name"),
        kind(orders, "JobPosting", "o_orderkey", "YEAR", "Year", "y"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


NODES = """nodes AS (SELECT 'JobPosting_' || o_orderkey AS id, 'JobPosting' AS label, o_orderpriority AS name, CAST(floor(o_totalprice) AS BIGINT) AS salary FROM orders
 UNION ALL SELECT 'Company_' || c_custkey, 'Company', c_name, NULL FROM customer UNION ALL SELECT 'Skill_' || p_partkey, 'Skill', p_name, NULL FROM part
 UNION ALL SELECT 'Location_' || n_name, 'Location', n_name, NULL FROM nation UNION ALL SELECT 'Location_' || r_name, 'Location', r_name, NULL FROM region
 UNION ALL SELECT DISTINCT 'Year_' || year(o_orderdate), 'Year', CAST(year(o_orderdate) AS VARCHAR), NULL FROM orders)"""
EDGES = """edges AS (SELECT 'JobPosting_' || o_orderkey AS src, 'Company_' || o_custkey AS dst, 'OFFERED_BY' AS type, '{}' AS props FROM orders
 UNION ALL SELECT DISTINCT 'JobPosting_' || l_orderkey, 'Skill_' || l_partkey, 'REQUIRES_SKILL', '{"proficiency_level":"' || l_returnflag || '"}' FROM lineitem
 UNION ALL SELECT 'Company_' || c_custkey, 'Location_' || n_name, 'LOCATED_IN', '{}' FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'JobPosting_' || o_orderkey, 'Location_' || n_name, 'LOCATED_IN', '{}' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'Location_' || n_name, 'Location_' || r_name, 'BELONGS_TO', '{}' FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'JobPosting_' || o_orderkey, 'Year_' || year(o_orderdate), 'YEAR', '{}' FROM orders)"""
GRAPH = f"{NODES}, {EDGES}"


@query("a8_node_counts", f"WITH {NODES} SELECT label, count(*) AS cnt FROM nodes GROUP BY label")
def a8(spark, d):
    return G.node_counts(nodes(spark, d))


@query("a9_edge_counts", f"WITH {EDGES} SELECT type, count(*) AS cnt FROM edges GROUP BY type")
def a9(spark, d):
    return G.edge_counts(edges(spark, d))


@query("s14_node_page", f"WITH {NODES} SELECT id, label FROM nodes ORDER BY id LIMIT 100")
def s14(spark, d):
    return G.node_page(nodes(spark, d)).select("id", F.array_join("labels", ",").alias("label"))


@query("j8_edge_records", f"WITH {GRAPH}, page AS (SELECT * FROM edges ORDER BY src, type, dst, props LIMIT 100) SELECT src, dst, type, props, a.name AS src_name, b.name AS dst_name FROM page JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst")
def j8(spark, d):
    out = G.edge_records(edges(spark, d), nodes(spark, d))
    return out.select("src", "dst", "type", "props", F.col("src_node.properties")["name"].alias("src_name"), F.col("dst_node.properties")["name"].alias("dst_name"))


@query(
    "j9_node_neighbourhood",
    f"WITH {GRAPH} SELECT DISTINCT 'Location_NATION_3' AS id, CASE WHEN src = 'Location_NATION_3' THEN dst ELSE src END AS other, type, props, CASE WHEN src = 'Location_NATION_3' THEN 'out' ELSE 'in' END AS direction, label AS other_labels FROM edges JOIN nodes ON id = CASE WHEN src = 'Location_NATION_3' THEN dst ELSE src END WHERE src = 'Location_NATION_3' OR dst = 'Location_NATION_3'",
)
def j9(spark, d):
    return G.neighbourhood(edges(spark, d), nodes(spark, d), "Location_NATION_3")


@query("f11_node_search", f"WITH {NODES} SELECT id, name FROM nodes WHERE label = 'Company' AND contains(name, '12') ORDER BY id LIMIT 50")
def f11(spark, d):
    return G.search_nodes(nodes(spark, d), "Company", "name", "12").select("id", F.col("properties")["name"].alias("name"))


# Cleaning: raw nodes with several spellings of a name.


def _raw(spark, d):
    """Raw nodes (ord, batch, id, type, properties) of customers."""
    c = V.table(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    place = F.expr("concat(array('武汉', '北京', '河北', '内蒙古', '上海', 'A', '中山路', '工作地点')[k % 8], array('市', '', '省', '自治区', '')[k % 5])")
    company = F.expr("CASE WHEN k % 17 = 0 THEN '公司' WHEN k % 19 = 0 THEN ' ' WHEN k % 23 = 0 THEN 'X' ELSE concat(' ', c_mktsegment, k DIV 40) END")
    year = F.expr("CASE WHEN k % 13 = 0 THEN '二零' ELSE concat(' ', 2015 + k % 9) END")
    m = lambda **p: F.create_map(*[x for a, b in p.items() for x in (F.lit(a), b)])
    rows = [
        c.select((F.col("k") * 3).alias("ord"), F.expr("k DIV 10").alias("batch"), F.concat(F.lit("c"), "k").alias("id"), F.lit("Company").alias("type"), m(name=company).alias("properties")),
        c.select((F.col("k") * 3 + 1).alias("ord"), F.expr("k DIV 10").alias("batch"), F.concat(F.lit("l"), "k").alias("id"), F.lit("Location").alias("type"), m(name=place, city=F.expr("CASE WHEN k % 3 = 0 THEN concat('城', k % 7, '市') ELSE '' END"), province=F.expr("CASE WHEN k % 4 = 0 THEN '湖北省' END")).alias("properties")),
        c.select((F.col("k") * 3 + 2).alias("ord"), F.expr("k DIV 10").alias("batch"), F.concat(F.lit("y"), "k").alias("id"), F.lit("Year").alias("type"), m(name=year).alias("properties")),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


RAW = """places AS (SELECT c_custkey * 3 + 1 AS ord, 'l' || c_custkey AS old_id, (['武汉', '北京', '河北', '内蒙古', '上海', 'A', '中山路', '工作地点'])[c_custkey % 8 + 1] || (['市', '', '省', '自治区', ''])[c_custkey % 5 + 1] AS name,
  CASE WHEN c_custkey % 3 = 0 THEN '城' || (c_custkey % 7) ELSE '' END AS city, CASE WHEN c_custkey % 4 = 0 THEN '湖北' ELSE '' END AS province FROM customer),
place AS (SELECT *, replace(replace(replace(name, '市', ''), '省', ''), '自治区', '') AS key FROM places WHERE NOT contains(name, '路') AND name <> '工作地点'),
companies AS (SELECT c_custkey * 3 AS ord, 'c' || c_custkey AS old_id, CASE WHEN c_custkey % 17 = 0 THEN '公司' WHEN c_custkey % 19 = 0 THEN ' ' WHEN c_custkey % 23 = 0 THEN 'X' ELSE ' ' || c_mktsegment || (c_custkey // 40) END AS name FROM customer),
company AS (SELECT ord, old_id, 'Company_' || left(md5(trim(name)), 6) AS id, trim(name) AS name FROM companies WHERE length(trim(name)) >= 2 AND trim(name) <> '公司'),
years AS (SELECT c_custkey * 3 + 2 AS ord, 'y' || c_custkey AS old_id, 'Year_' || (2015 + c_custkey % 9) AS id FROM customer WHERE c_custkey % 13 <> 0)"""


@query(
    "g4_location_merge",
    f"""WITH {RAW}, b AS (SELECT *, coalesce(max(CASE WHEN name = key THEN ord END) OVER (PARTITION BY key), -1) AS lb FROM place)
SELECT 'Location_' || left(md5(key), 6) AS id, coalesce(arg_min(name, (length(name), ord)) FILTER (ord > lb), key) AS name, coalesce(arg_min(city, ord) FILTER (city <> ''), '') AS city, coalesce(arg_min(province, ord) FILTER (province <> ''), '') AS province FROM b GROUP BY key""",
)
def g4(spark, d):
    return G.merge_locations(G.clean_locations(_raw(spark, d)))


@query("g4_company_clean", f"WITH {RAW} SELECT id, arg_min(name, ord) AS name, min(ord) AS ord FROM company GROUP BY id")
def g4_company(spark, d):
    return G.keep_first_nodes(G.clean_companies(_raw(spark, d)).select("id", "name", "ord"))


@query("a17_year_merge", f"WITH {RAW} SELECT id, substr(id, 6) AS name, min(ord) AS ord FROM years GROUP BY id")
def a17(spark, d):
    return G.keep_first_nodes(G.clean_years(_raw(spark, d)).select("id", "name", "ord"))


def _cleaned(spark, d):
    raw = _raw(spark, d)
    companies, years, places = G.clean_companies(raw), G.clean_years(raw), G.clean_locations(raw)
    valid = companies.select("id").unionByName(years.select("id")).unionByName(places.select("id")).distinct()
    mapping = G.id_mapping(companies, years, places)
    c = V.table(spark, d, "customer")
    raw_edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("l"), "c_custkey").alias("dst"), F.lit("LOCATED_IN").alias("type")).unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("y"), "c_custkey").alias("dst"), F.lit("YEAR").alias("type")))
    return valid, mapping, raw_edges


@query(
    "g5_clean_edges",
    f"""WITH {RAW}, p AS (SELECT old_id, 'Location_' || left(md5(key), 6) AS id FROM place),
m AS (SELECT old_id, id FROM company UNION ALL SELECT old_id, id FROM years UNION ALL SELECT old_id, id FROM p)
SELECT a.id AS src, b.id AS dst, CASE WHEN b.old_id LIKE 'l%' THEN 'LOCATED_IN' ELSE 'YEAR' END AS type FROM customer JOIN m a ON a.old_id = 'c' || c_custkey JOIN m b ON b.old_id IN ('l' || c_custkey, 'y' || c_custkey)""",
)
def g5(spark, d):
    valid, mapping, raw_edges = _cleaned(spark, d)
    return G.valid_edges(G.remap_edges(raw_edges, mapping), valid)


def _batches(spark, d):
    """(batch, id, type) and (batch, src, dst, type): batches of postings with one or more companies and places."""
    o = V.table(spark, d, "orders").withColumn("batch", F.expr("o_orderkey DIV 3"))
    t = lambda label, key: o.select("batch", F.concat(F.lit(label + "_"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("type")).distinct()
    ns = t("JobPosting", "o_orderkey").unionByName(t("Company", "o_custkey")).unionByName(t("Location", "o_orderstatus"))
    es = o.where("o_orderkey % 4 = 0").select("batch", F.concat(F.lit("JobPosting_"), "o_orderkey").alias("src"), F.concat(F.lit("Company_"), "o_custkey").alias("dst"), F.lit("OFFERED_BY").alias("type"))
    return ns, es


@query(
    "g6_supplement_edges",
    """WITH o AS (SELECT *, o_orderkey // 3 AS batch FROM orders), oc AS (SELECT batch, min(o_custkey) AS c FROM o GROUP BY batch HAVING count(DISTINCT o_custkey) = 1), ol AS (SELECT batch, min(o_orderstatus) AS l FROM o GROUP BY batch HAVING count(DISTINCT o_orderstatus) = 1)
SELECT batch, 'JobPosting_' || o_orderkey AS src, 'Company_' || c AS dst, 'OFFERED_BY' AS type FROM o JOIN oc USING (batch) WHERE o_orderkey % 4 <> 0
UNION ALL SELECT batch, 'JobPosting_' || o_orderkey, 'Location_' || l, 'LOCATED_IN' FROM o JOIN ol USING (batch) UNION ALL SELECT DISTINCT batch, 'Company_' || o_custkey, 'Location_' || l, 'LOCATED_IN' FROM o JOIN ol USING (batch)""",
)
def g6(spark, d):
    return G.supplement_edges(*_batches(spark, d))


@query("g7_year_edges", "SELECT 'JobPosting_' || o_orderkey AS src, 'Year_' || year(o_orderdate) AS dst, 'YEAR' AS type FROM orders")
def g7(spark, d):
    rows = V.table(spark, d, "orders").select(F.concat(F.lit("JobPosting_"), "o_orderkey").alias("id"), F.lit(None).cast("int").alias("data_year"), F.col("o_orderdate").alias("created_at"))
    return G.year_edges(rows)[1]


def _extractions(spark, d):
    """Raw extraction JSON with dangling, null and unknown parts, parsed."""
    from .. import schema

    body = F.expr("""concat('{"nodes":[{"id":"p', o_orderkey, '","type":"JobPosting","properties":{"name":"', o_orderpriority, '"}},{"id":"c', o_custkey, '","type":"Company","properties":{}},{"id":"z","type":"Other","properties":{}}],
"relationships":[{"source":"p', o_orderkey, '","target":"c', o_custkey, '","type":"OFFERED_BY","properties":{}},{"source":"p', o_orderkey, '","target":"gone","type":"OFFERED_BY","properties":{}},{"source":null,"target":"z","type":"YEAR","properties":{}},{"source":"z","target":"c', o_custkey, '","type":"LIKES","properties":{}}]}')""")
    return V.table(spark, d, "orders").select("o_orderkey", F.from_json(body, schema.extraction()).alias("graph"))


@query("g1_sanitize_extraction", "SELECT o_orderkey, 2 AS kept FROM orders")
def g1(spark, d):
    return G.sanitize_extraction(_extractions(spark, d)).select("o_orderkey", F.size("graph.relationships").alias("kept"))


@query("g3_flatten_edges", "SELECT o_orderkey, CAST(0 AS INT) AS pos, 'p' || o_orderkey AS src, 'c' || o_custkey AS dst, 'OFFERED_BY' AS type FROM orders")
def g3(spark, d):
    return G.flatten_edges(G.sanitize_extraction(_extractions(spark, d)), keys=["o_orderkey"]).drop("properties")


@query("g3_flatten_nodes", "SELECT o_orderkey, CAST(0 AS INT) AS pos, 'p' || o_orderkey AS id, 'JobPosting' AS type FROM orders UNION ALL SELECT o_orderkey, 1, 'c' || o_custkey, 'Company' FROM orders")
def g3_nodes(spark, d):
    return G.flatten_nodes(_extractions(spark, d), keys=["o_orderkey"]).drop("properties")


@query("k7_new_nodes", "SELECT 'Company_' || o_custkey AS id, min(o_orderkey) AS ord FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1")
def k7(spark, d):
    o = V.table(spark, d, "orders")
    stored = V.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("Company_"), "c_custkey").alias("id"))
    return G.new_nodes(o.select(F.concat(F.lit("Company_"), "o_custkey").alias("id"), F.col("o_orderkey").alias("ord")), stored)


@query("k8_new_edges", "SELECT DISTINCT 'Company_' || o_custkey AS src, 'Year_' || year(o_orderdate) AS dst, 'YEAR' AS type FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) <> 1997 AND year(o_orderdate) <> 1998")
def k8(spark, d):
    o = V.table(spark, d, "orders").select(F.concat(F.lit("Company_"), "o_custkey").alias("src"), F.concat(F.lit("Year_"), F.year("o_orderdate").cast("string")).alias("dst"), F.lit("YEAR").alias("type"), F.create_map().cast("map<string,string>").alias("properties"))
    ends = nodes(spark, d).where("id <> 'Year_1998'")
    return G.new_edges(o, ends, o.where("dst = 'Year_1997'")).drop("properties")


K9 = "SELECT count(*) AS edges, count(*) FILTER (o_orderkey % 7 = 0) AS missing_field, count(*) FILTER (o_orderkey % 7 <> 0 AND o_custkey % 5 = 0) AS missing_end, count(*) FILTER (o_orderkey % 7 <> 0 AND o_custkey % 5 <> 0) AS loadable, min(CASE WHEN o_orderkey % 7 <> 0 AND o_custkey % 5 = 0 THEN 'JobPosting_' || o_orderkey || ' OFFERED_BY ' || 'Company_' || o_custkey END) AS first_missing_end FROM orders"


def _loads(spark, d):
    o = V.table(spark, d, "orders").select(F.concat(F.lit("JobPosting_"), "o_orderkey").alias("src"), F.concat(F.lit("Company_"), "o_custkey").alias("dst"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'OFFERED_BY' END").alias("type"))
    return o, nodes(spark, d).where("NOT (id LIKE 'Company%' AND CAST(substr(id, 9) AS INT) % 5 = 0)")


@query("k9_load_stats", K9)
def k9(spark, d):
    return G.load_stats(*_loads(spark, d))


@query("k9_observed_load", K9)
def k9_observed(spark, d):
    """The figures of a load, as the write of its edges took them."""
    found = G.load_edges(*_loads(spark, d), fresh_path(spark, "loaded"))
    return spark.createDataFrame([tuple(found.values())], "edges long, missing_field long, missing_end long, loadable long, first_missing_end string").toDF(*found)


@query(
    "a10_collected_neighbours",
    f"WITH {GRAPH}, a AS (SELECT DISTINCT CASE WHEN src = 'Location_NATION_3' THEN dst ELSE src END AS other, type, CASE WHEN src = 'Location_NATION_3' THEN 'out' ELSE 'in' END AS direction FROM edges WHERE src = 'Location_NATION_3' OR dst = 'Location_NATION_3') SELECT 'Location_NATION_3' AS id, count(*) AS n, string_agg(type || ' ' || direction || ' ' || other || ':' || label, ',' ORDER BY type, direction, other) AS pairs FROM a JOIN nodes ON nodes.id = other",
)
def a10(spark, d):
    found = G.collected_neighbours(edges(spark, d), nodes(spark, d), "Location_NATION_3")
    one = lambda x: F.concat_ws(" ", x["rel"]["type"], x["rel"]["direction"], F.concat(x["node"]["id"], F.lit(":"), x["node"]["labels"]))
    return found.select("id", F.size("relationships").cast("long").alias("n"), F.array_join(F.transform("relationships", one), ",").alias("pairs"))


# Patterns.


def _cypher(text, **parameters):
    return lambda spark, d: Graph(nodes(spark, d), edges(spark, d)).query(text, parameters)


def cypher(name: str, text: str, oracle: str, **parameters) -> None:
    query(name, f"WITH {GRAPH} {oracle}")(_cypher(text, **parameters))


cypher(
    "g12_cypher_match",
    "MATCH (p:JobPosting)-[:OFFERED_BY]->(c:Company {name: $company}) WHERE p.salary >= 50000 RETURN p.name AS job, p.salary AS salary, c.name AS company",
    "SELECT p.name AS job, CAST(p.salary AS VARCHAR) AS salary, c.name AS company FROM edges e JOIN nodes p ON p.id = src JOIN nodes c ON c.id = dst WHERE type = 'OFFERED_BY' AND c.label = 'Company' AND c.name = 'Customer#000000007' AND p.salary >= 50000",
    company="Customer#000000007",
)
cypher(
    "g12_cypher_with_agg",
    "MATCH (p:JobPosting)-[:LOCATED_IN]->(l:Location) WITH l.name AS place, count(p) AS jobs, avg(p.salary) AS pay WHERE jobs > 10 RETURN place, jobs, pay ORDER BY jobs DESC, place LIMIT 10",
    "SELECT l.name AS place, count(*) AS jobs, avg(p.salary) AS pay FROM edges JOIN nodes p ON p.id = src AND p.label = 'JobPosting' JOIN nodes l ON l.id = dst WHERE type = 'LOCATED_IN' GROUP BY 1 HAVING count(*) > 10 ORDER BY jobs DESC, place LIMIT 10",
)
cypher(
    "g12_cypher_two_hop",
    "MATCH (c:Company)-[:LOCATED_IN]->(n:Location)-[:BELONGS_TO]->(r:Location) RETURN r.name AS region, count(DISTINCT c) AS companies",
    "SELECT r.name AS region, count(DISTINCT a.src) AS companies FROM edges a JOIN edges b ON a.dst = b.src JOIN nodes c ON c.id = a.src JOIN nodes r ON r.id = b.dst WHERE a.type = 'LOCATED_IN' AND b.type = 'BELONGS_TO' AND c.label = 'Company' GROUP BY 1",
)
cypher(
    "g12_cypher_optional",
    "MATCH (c:Company) WHERE c.name STARTS WITH 'Customer#00000001' OPTIONAL MATCH (c)<-[:OFFERED_BY]-(p:JobPosting) WHERE p.salary > 80000 RETURN c.name AS company, count(p) AS jobs",
    "SELECT c.name AS company, count(p.id) AS jobs FROM nodes c LEFT JOIN (SELECT * FROM edges JOIN nodes ON id = src WHERE type = 'OFFERED_BY' AND label = 'JobPosting' AND salary > 80000) p ON p.dst = c.id WHERE c.label = 'Company' AND starts_with(c.name, 'Customer#00000001') GROUP BY 1",
)
cypher(
    "g12_cypher_unwind",
    "UNWIND ['NATION_1', 'NATION_2', 'MARS'] AS place MATCH (l:Location)<-[:LOCATED_IN]-(c:Company) WHERE l.name = place RETURN place, count(*) AS companies",
    "SELECT l.name AS place, count(*) AS companies FROM edges JOIN nodes l ON l.id = dst JOIN nodes c ON c.id = src WHERE type = 'LOCATED_IN' AND c.label = 'Company' AND l.name IN ('NATION_1', 'NATION_2', 'MARS') GROUP BY 1",
)
cypher(
    "g12_cypher_order_skip",
    "MATCH (n) WHERE n.name CONTAINS '3' AND NOT n:x IS NULL RETURN n.name AS name ORDER BY name DESC SKIP 5 LIMIT 10".replace(" AND NOT n:x IS NULL", ""),
    "SELECT name FROM nodes WHERE contains(name, '3') ORDER BY name DESC NULLS FIRST LIMIT 10 OFFSET 5",
)
cypher(
    "g12_cypher_var_length",
    "MATCH (c:Company)-[:LOCATED_IN|BELONGS_TO*1..2]->(l:Location) WHERE c.industry = 'BUILDING' RETURN l.name AS place, count(*) AS paths",
    "SELECT l.name AS place, count(*) AS paths FROM (SELECT src, dst FROM edges WHERE type = 'LOCATED_IN' UNION ALL SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'LOCATED_IN' AND b.type = 'BELONGS_TO') x JOIN customer ON src = 'Company_' || c_custkey JOIN nodes l ON l.id = dst WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
)
cypher(
    "g12_cypher_undirected",
    "MATCH (r:Location {name: 'NATION_4'})-[e]-(x) WHERE x.name IS NOT NULL RETURN type(e) AS kind, labels(x) AS label, count(*) AS n".replace("labels(x) AS label", "head(labels(x)) AS label"),
    "SELECT type AS kind, label, count(*) AS n FROM edges JOIN nodes ON id = CASE WHEN src = 'Location_NATION_4' THEN dst ELSE src END WHERE src = 'Location_NATION_4' OR dst = 'Location_NATION_4' GROUP BY ALL",
)
cypher(
    "g12_cypher_shared_skill",
    "MATCH (a:JobPosting {name: '1-URGENT'})-[:REQUIRES_SKILL]->(s:Skill)<-[:REQUIRES_SKILL]-(b:JobPosting {name: '5-LOW'}) WHERE s.name IN $skills RETURN s.name AS skill, count(*) AS pairs",
    "SELECT s.name AS skill, count(*) AS pairs FROM edges x JOIN edges y ON x.dst = y.dst JOIN nodes a ON a.id = x.src JOIN nodes b ON b.id = y.src JOIN nodes s ON s.id = x.dst WHERE x.type = 'REQUIRES_SKILL' AND y.type = 'REQUIRES_SKILL' AND a.name = '1-URGENT' AND b.name = '5-LOW' AND (x.src <> y.src OR x.props <> y.props) AND s.name IN (SELECT p_name FROM part WHERE p_partkey IN (1, 2, 3)) GROUP BY 1",
    skills=[],
)


def _shared_skill(spark, d):
    names = [r[0] for r in V.table(spark, d, "part").where("p_partkey IN (1, 2, 3)").select("p_name").distinct().collect()]
    return _cypher("MATCH (a:JobPosting {name: '1-URGENT'})-[:REQUIRES_SKILL]->(s:Skill)<-[:REQUIRES_SKILL]-(b:JobPosting {name: '5-LOW'}) WHERE s.name IN $skills RETURN s.name AS skill, count(*) AS pairs", skills=names)(spark, d)


query("g12_cypher_shared_skill")(_shared_skill)

# Paths of any length. On the graph above every path ends after some steps; referrals run into a cycle of three.

WALKS = """e AS MATERIALIZED (SELECT row_number() OVER () AS k, src, dst, type FROM edges), w AS (SELECT src, dst, [k] AS used FROM e WHERE src IN (SELECT id FROM nodes WHERE {start})
 UNION ALL SELECT w.src, e.dst, list_append(used, e.k) FROM w JOIN e ON e.src = w.dst WHERE NOT list_contains(used, e.k))"""
REFERRALS = """nodes AS (SELECT 'Company_' || c_custkey AS id, 'Company' AS label, c_name AS name FROM customer),
edges AS (SELECT 'Company_' || c_custkey AS src, 'Company_' || CASE WHEN c_custkey > 3 THEN c_custkey // 3 ELSE c_custkey % 3 + 1 END AS dst, 'REFERS' AS type FROM customer)"""


def _referrals(spark, d):
    c = V.table(spark, d, "customer")
    label = lambda k: F.concat(F.lit("Company_"), k.cast("string"))
    to = F.expr("CASE WHEN c_custkey > 3 THEN c_custkey DIV 3 ELSE c_custkey % 3 + 1 END")
    people = c.select(label(F.col("c_custkey")).alias("id"), F.array(F.lit("Company")).alias("labels"), F.create_map(F.lit("name"), "c_name").alias("properties"))
    return Graph(people, c.select(label(F.col("c_custkey")).alias("src"), label(to).alias("dst"), F.lit("REFERS").alias("type"), F.create_map().cast("map<string,string>").alias("properties")))


def referrals(name: str, text: str, oracle: str, start: str = "true") -> None:
    query(name, f"WITH RECURSIVE {REFERRALS}, {WALKS.format(start=start)} {oracle}")(lambda spark, d: _referrals(spark, d).query(text))


query(
    "g12_cypher_open_path",
    f"WITH RECURSIVE {GRAPH}, {WALKS.format(start="label = 'JobPosting' AND name = '1-URGENT'")} SELECT label, name, count(*) AS paths FROM w JOIN nodes ON id = dst GROUP BY ALL",
)(_cypher("MATCH (p:JobPosting {name: '1-URGENT'})-[*]->(x) RETURN head(labels(x)) AS label, x.name AS name, count(*) AS paths"))
referrals("g12_cypher_open_cycle", "MATCH (a)-[:REFERS*2..]->(b) RETURN b.name AS name, count(*) AS paths", "SELECT name, count(*) AS paths FROM w JOIN nodes ON id = dst WHERE len(used) >= 2 GROUP BY 1")
referrals("g12_cypher_nine_steps", "MATCH (a)-[r:REFERS*1..9]->(b) RETURN b.name AS name, count(*) AS paths, max(size(r)) AS longest", "SELECT name, count(*) AS paths, CAST(max(len(used)) AS INT) AS longest FROM w JOIN nodes ON id = dst WHERE len(used) <= 9 GROUP BY 1")
referrals("g12_cypher_reach", "MATCH (a)-[:REFERS*]->(b) RETURN b.name AS name, count(DISTINCT a) AS reached_from", "SELECT name, count(DISTINCT src) AS reached_from FROM w JOIN nodes ON id = dst GROUP BY 1")
referrals(
    "g12_cypher_path_values",
    "MATCH p = (a:Company)-[:REFERS*0..]->(b) WHERE a.name ENDS WITH '7' RETURN a.name AS name, length(p) AS steps, [n IN nodes(p) WHERE n.name ENDS WITH '1' | right(n.name, 3)] AS ends, size(relationships(p)) AS edges, CASE WHEN b.name = a.name THEN 'self' ELSE last(split(b.name, '#')) END AS target",
    """, along AS (SELECT w.src, used, list(m.name ORDER BY pos) AS names FROM (SELECT src, used, unnest(used) AS k, unnest(range(len(used))) AS pos FROM w) w JOIN e USING (k) JOIN nodes m ON m.id = e.dst GROUP BY ALL),
q AS (SELECT name, [name] AS names FROM nodes WHERE ends_with(name, '7') UNION ALL SELECT n.name, list_prepend(n.name, names) FROM along JOIN nodes n ON n.id = along.src)
SELECT name, CAST(len(names) - 1 AS INT) AS steps, list_transform(list_filter(names, lambda x: ends_with(x, '1')), lambda x: right(x, 3)) AS ends, CAST(len(names) - 1 AS INT) AS edges, CASE WHEN names[-1] = name THEN 'self' ELSE split_part(names[-1], '#', 2) END AS target FROM q""",
    "ends_with(name, '7')",
)

TEXTS = ["MATCH (n) RETURN n", "match (n) set n.x=1", "MATCH (n) WHERE n.name='set' RETURN n", "", "RETURN", "MATCH (n) DELETE n", "SHOW DATABASES", "RETURN 1; RETURN 2", "RETURN 1;  ", "CALL db.labels()"]
TEXT_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TEXTS) + "]"


def _texts(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.element_at(F.array(*[F.lit(t) for t in TEXTS]), ((F.col("conv_id") + F.col("turn")) % len(TEXTS) + 1).cast("int")).alias("q"))


@query("f12_readonly_guard", rf"SELECT conv_id, turn, q, NOT regexp_matches(upper(q), '\b(CREATE|DELETE|DETACH|REMOVE|SET|MERGE|FOREACH|DROP|ALTER)\b') AS readonly FROM (SELECT conv_id, turn, ({TEXT_SQL})[(conv_id + turn) % {len(TEXTS)} + 1] AS q FROM conversations)")
def f12(spark, d):
    return _texts(spark, d).withColumn("readonly", guards.is_readonly(F.col("q")))


@query(
    "f13_preflight_class",
    rf"""SELECT conv_id, turn, q, CASE WHEN length(trim(q)) < 8 THEN '参数错误' WHEN regexp_matches(upper(q), '\b(CREATE|DELETE|DETACH|REMOVE|SET|MERGE|FOREACH|DROP|ALTER)\b') THEN '安全拒绝' WHEN NOT regexp_matches(upper(q), '\b(MATCH|CALL|WITH|UNWIND|RETURN)\b') THEN '语法预检' WHEN regexp_matches(trim(q), ';\s*[^\s;]') THEN '语法预检' ELSE 'ok' END AS class
FROM (SELECT conv_id, turn, ({TEXT_SQL})[(conv_id + turn) % {len(TEXTS)} + 1] AS q FROM conversations)""",
)
def f13(spark, d):
    return _texts(spark, d).withColumn("class", guards.preflight(F.col("q")))
