"""Property graph: reads, cleaning of extracted nodes and edges, and idempotent loads.

nodes: id, labels, properties; edges: src, dst, type, properties. Extracted nodes carry an ordinal (ord),
as several rules depend on the order in which nodes were extracted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import geo, text
from ..schema import EDGE_TYPES, NODE_LABELS


def sorted_map(c: Column) -> Column:
    """A map as JSON with its keys in order: maps cannot be compared or grouped by."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))))))


def node_counts(nodes: DataFrame) -> DataFrame:
    label = F.when(F.size("labels") == 0, "未分类").otherwise(F.array_join("labels", ", "))
    return nodes.groupBy(label.alias("label")).agg(F.count("*").alias("cnt"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("cnt"))


def node_page(nodes: DataFrame, limit: int = 100, most: int = 1000) -> DataFrame:
    return nodes.orderBy("id").limit(min(limit, most))


def edge_records(edges: DataFrame, nodes: DataFrame, limit: int = 100, most: int = 1000) -> DataFrame:
    """Edges with both end nodes, in order; the page is cut before the joins."""
    page = edges.withColumn("props", sorted_map(F.col("properties"))).orderBy("src", "type", "dst", "props").limit(min(limit, most))
    named = lambda p: nodes.select(F.col("id").alias(p), F.struct("id", "labels", "properties").alias(f"{p}_node"))
    return page.join(named("src"), "src").join(named("dst"), "dst")


def neighbourhood(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """The node and one row per distinct (edge, neighbour) in either direction; one row of nulls if it has none."""
    out = edges.where(F.col("src") == node_id).select("src", F.col("dst").alias("other"), "type", "properties", F.lit("out").alias("direction"))
    back = edges.where((F.col("dst") == node_id) & (F.col("src") != node_id)).select(F.col("dst").alias("src"), F.col("src").alias("other"), "type", "properties", F.lit("in").alias("direction"))
    around = out.unionByName(back).withColumn("props", sorted_map(F.col("properties"))).select("src", "other", "type", "props", "direction").distinct()
    far = nodes.select(F.col("id").alias("other"), F.array_join("labels", ",").alias("other_labels"))
    return nodes.where(F.col("id") == node_id).select("id").join(around.join(far, "other"), F.col("id") == F.col("src"), "left").drop("src")


def search_nodes(nodes: DataFrame, label: str | None = None, key: str | None = None, value: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes of a label whose property contains a value; without a key any property may."""
    out = nodes.where(F.array_contains("labels", label)) if label else nodes
    if value and key:
        out = out.where(F.contains(F.col("properties")[key], F.lit(value)))
    elif value:
        out = out.where(F.exists(F.map_values("properties"), lambda v: F.contains(v, F.lit(value))))
    return out.orderBy("id").limit(min(max(limit, 1), 1000))


# Cleaning of what was extracted.


def sanitize_extraction(docs: DataFrame, column: str = "graph") -> DataFrame:
    """Edges of an extraction (see schema.extraction) whose ends are among its nodes; null ends and 'None' dropped."""
    g = F.col(column)
    ids = F.transform(F.filter(g["nodes"], lambda n: n["id"].isNotNull()), lambda n: n["id"])
    kept = F.filter(g["relationships"], lambda r: F.coalesce(F.array_contains(ids, r["source"]) & F.array_contains(ids, r["target"]) & ~r["source"].isin("None", "") & ~r["target"].isin("None", ""), F.lit(False)))
    return docs.withColumn(column, F.struct(g["nodes"].alias("nodes"), kept.alias("relationships")))


def flatten_nodes(docs: DataFrame, column: str = "graph", keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, id, type, properties) of the extracted nodes of known labels."""
    out = docs.select(*(keys or []), F.posexplode(f"{column}.nodes").alias("pos", "n")).select(*(keys or []), "pos", "n.id", "n.type", "n.properties")
    return out.where(F.col("id").isNotNull() & (F.col("id") != "None") & F.col("type").isin(NODE_LABELS))


def flatten_edges(docs: DataFrame, column: str = "graph", keys: list[str] | None = None) -> DataFrame:
    out = docs.select(*(keys or []), F.posexplode(f"{column}.relationships").alias("pos", "r")).select(*(keys or []), "pos", F.col("r.source").alias("src"), F.col("r.target").alias("dst"), "r.type", "r.properties")
    return out.where(F.col("type").isin(EDGE_TYPES))


def clean_companies(nodes: DataFrame) -> DataFrame:
    """(ord, old_id, id, name) of companies with a usable name; ids from the name's hash."""
    name = text.strip(F.col("properties")["name"])
    kept = nodes.where((F.col("type") == "Company") & geo.valid_company(F.col("properties")["name"]))
    return kept.select("ord", F.col("id").alias("old_id"), text.hashed_id("Company", name).alias("id"), name.alias("name"))


def clean_years(nodes: DataFrame) -> DataFrame:
    """(ord, old_id, id, name) of years that are whole numbers."""
    year = text.strip(F.col("properties")["name"]).try_cast("int").cast("string")
    return nodes.where((F.col("type") == "Year") & year.isNotNull()).select("ord", F.col("id").alias("old_id"), F.concat(F.lit("Year_"), year).alias("id"), year.alias("name"))


def clean_locations(nodes: DataFrame) -> DataFrame:
    """(ord, old_id, id, key, name, city, province) of locations that are no addresses, not yet merged."""
    p = F.col("properties")
    name = text.strip(p["name"])
    rows = nodes.where((F.col("type") == "Location") & geo.valid_place(p["name"]))
    province = F.coalesce(p["province"], F.lit(""))
    for part in ("省", "自治区", "特别行政区"):
        province = F.replace(province, F.lit(part), F.lit(""))
    city = F.replace(F.coalesce(p["city"], F.lit("")), F.lit("市"), F.lit(""))
    key = geo.place_key(name)
    return rows.select("ord", F.col("id").alias("old_id"), text.hashed_id("Location", key).alias("id"), key.alias("key"), name.alias("name"), text.strip(city).alias("city"), text.strip(province).alias("province"))


def merge_locations(locations: DataFrame) -> DataFrame:
    """One node a key: (id, name, city, province).

    City and province are the first that are not empty. The name is what reading the names in order leaves, where
    a shorter name replaces the present one and any other name replaces the bare key: the shortest name (the
    earliest of equals) after the last bare key, or the key. That needs no ordered list of a group, so a
    place with most of all rows is aggregated in parts like any other.
    """
    bare = F.when(F.col("name") == F.col("key"), F.col("ord"))
    last = locations.groupBy("key").agg(F.max(bare).alias("last_bare"))
    tail = F.when(F.col("last_bare").isNull() | (F.col("ord") > F.col("last_bare")), F.struct(F.length("name"), "ord"))
    filled = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("ord")))
    out = locations.join(last, "key").groupBy("key", "id").agg(F.min_by("name", tail).alias("tail"), filled("city").alias("city"), filled("province").alias("province"))
    return out.select("id", F.coalesce("tail", "key").alias("name"), F.coalesce("city", F.lit("")).alias("city"), F.coalesce("province", F.lit("")).alias("province"))


def keep_first_nodes(nodes: DataFrame, *more: str) -> DataFrame:
    """One row an id, the first by ord, without ordering whole groups; with more columns one row for each of their values too."""
    others = [c for c in nodes.columns if c not in ("id", *more)]
    first = nodes.groupBy("id", *more).agg(F.min_by(F.struct(*others), "ord").alias("n"))
    return first.select("id", *more, *[F.col(f"n.{c}").alias(c) for c in others])


def id_mapping(*cleaned: DataFrame) -> DataFrame:
    """(old_id, new_id) where they differ; of several, the one that came last."""
    rows = [c.where("old_id <> '' AND old_id <> id").select("old_id", F.col("id").alias("new_id"), "ord") for c in cleaned]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("old_id").agg(F.max_by("new_id", "ord").alias("new_id"))


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends through the mapping, one hop."""
    src, dst = (mapping.select(F.col("old_id").alias(c), F.col("new_id").alias("_" + c)) for c in ("src", "dst"))
    out = edges.join(src, "src", "left").join(dst, "dst", "left")
    return out.withColumn("src", F.coalesce("_src", "src")).withColumn("dst", F.coalesce("_dst", "dst")).select(*edges.columns)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that lack an end."""
    ids = nodes.select("id").distinct()
    found = edges.join(ids.withColumn("_s", F.lit(True)).withColumnRenamed("id", "src"), "src", "left").join(ids.withColumn("_d", F.lit(True)).withColumnRenamed("id", "dst"), "dst", "left")
    return found.where(F.col("_s").isNull() | F.col("_d").isNull()).select(*edges.columns)


def supplement_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that a batch lacks: to its only company or place, from sources without an edge of that type.

    nodes: batch, id, type; edges: batch, src, dst, type. Returns the added edges (batch, src, dst, type).
    """
    added = None
    for source, kind, target in (("JobPosting", "OFFERED_BY", "Company"), ("JobPosting", "LOCATED_IN", "Location"), ("Company", "LOCATED_IN", "Location")):
        only = nodes.where(F.col("type") == target).groupBy("batch").agg(F.min("id").alias("dst"), F.count("*").alias("n")).where("n = 1").drop("n")
        have = edges.where(F.col("type") == kind).select("batch", F.col("src").alias("id")).distinct()
        lacking = nodes.where(F.col("type") == source).select("batch", "id").distinct().join(have, ["batch", "id"], "left_anti")
        new = lacking.join(only, "batch").select("batch", F.col("id").alias("src"), "dst", F.lit(kind).alias("type"))
        added = new if added is None else added.unionByName(new)
    return added


def year_edges(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Year nodes and YEAR edges of postings (id, data_year, created_at)."""
    year = text.year_or_date(F.col("data_year"), F.col("created_at"))
    edges = postings.select(F.col("id").alias("src"), F.concat(F.lit("Year_"), year.cast("string")).alias("dst"), year.alias("year")).where("year IS NOT NULL").distinct()
    nodes = edges.select(F.col("dst").alias("id"), F.col("year").cast("string").alias("name")).distinct()
    return nodes, edges.select("src", "dst", F.lit("YEAR").alias("type"))


# Idempotent loads.


def new_nodes(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Nodes to append: the first writer of an id wins, stored ids stay."""
    return keep_first_nodes(candidates).join(stored.select("id"), "id", "left_anti")


def edge_key(edges: DataFrame) -> DataFrame:
    return edges.withColumn("_props", sorted_map(F.col("properties")))


def new_edges(candidates: DataFrame, nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges to append: both ends exist; one of each (src, type, dst, properties); not stored yet."""
    keys = ["src", "type", "dst", "_props"]
    fresh = edge_key(valid_edges(candidates, nodes)).dropDuplicates(keys)
    return fresh.join(edge_key(stored).select(*keys), keys, "left_anti").drop("_props")


def judged_edges(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate edges with _fault: field (src, type or dst is missing), end (an end is no node), or null."""
    ids = nodes.select("id").distinct()
    marked = candidates.join(ids.select(F.col("id").alias("src"), F.lit(1).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    lacking = reduce(Column.__or__, [F.coalesce(F.col(c), F.lit("")) == "" for c in ("src", "dst", "type")])
    fault = F.when(lacking, "field").when(F.col("_s").isNull() | F.col("_d").isNull(), "end")
    return marked.withColumn("_fault", fault).drop("_s", "_d")


def load_figures() -> list[Column]:
    """Of judged edges: rows, missing fields, missing ends, loadable; and the first example of a missing end."""
    fault = F.coalesce("_fault", F.lit(""))
    return [
        F.count(F.lit(1)).alias("edges"),
        F.count_if(fault == "field").alias("missing_field"),
        F.count_if(fault == "end").alias("missing_end"),
        F.count_if(fault == "").alias("loadable"),
        F.min(F.when(fault == "end", F.concat_ws(" ", "src", "type", "dst"))).alias("first_missing_end"),
    ]


def load_stats(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    return judged_edges(candidates, nodes).agg(*load_figures())


def load_edges(candidates: DataFrame, nodes: DataFrame, path: str) -> dict:
    """Writes the loadable edges to path; returns the load's figures, which are taken in the write itself, without a second pass."""
    seen = Observation()
    judged_edges(candidates, nodes).observe(seen, *load_figures()).where("_fault IS NULL").drop("_fault").write.mode("overwrite").parquet(path)
    return dict(seen.get)


def collected_neighbours(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """The node and the list of its distinct (rel, node) pairs, in order; an empty list if it has none."""
    pair = F.struct(F.struct("type", "props", "direction").alias("rel"), F.struct(F.col("other").alias("id"), F.col("other_labels").alias("labels")).alias("node"))
    return neighbourhood(edges, nodes, node_id).groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("other").isNotNull(), pair))).alias("relationships"))
