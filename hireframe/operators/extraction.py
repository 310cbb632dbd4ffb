"""Extraction pipeline: listings to documents, batches, cached and pluggable extraction, graph rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import text
from ..shipping import ship
from . import graph as G

BATCH = 10


def documents(listings: DataFrame, body: str = "requirements", least: int = 10) -> DataFrame:
    """(id, page_content, metadata) of listings that have title, company and more than ``least`` characters of text."""
    kept = listings.dropna(subset=["job_title", "company_name", body]).withColumn("_body", text.list_text(F.col(body))).where(F.length("_body") > least)
    year = text.year_or_date(F.col("data_year"), F.col("created_at"))
    content = text.supplement_header(F.col("company_name"), F.col("location"), F.col("job_title"), year, F.col("_body"))
    return kept.select("id", content.alias("page_content"), F.struct("id", "job_title", "company_name", "location", "salary_range", year.alias("data_year")).alias("metadata"))


def with_batches(docs: DataFrame, size: int = BATCH, key: str = "id") -> DataFrame:
    """batch: documents in blocks of ids; a function of the id alone, so no ordering of all rows is needed."""
    return docs.withColumn("batch", F.floor(F.col(key) / size).cast("long"))


def with_dense_batches(docs: DataFrame, size: int = BATCH, group: str = "data_year", key: str = "id") -> DataFrame:
    """batch: exactly ``size`` documents each (the last of a group fewer), numbered within a group."""
    return docs.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1) / size).cast("long"))


def content_hash(content: str = "page_content"):
    return F.md5(F.col(content).cast("binary"))


def split_cached(docs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their stored graph, misses); cache: doc_hash, result (JSON). Texts whose hash is there already are not needed."""
    hashed = docs if "doc_hash" in docs.columns else docs.withColumn("doc_hash", content_hash())
    stored = cache.groupBy("doc_hash").agg(F.max("result").alias("result"))
    hits = hashed.join(stored, "doc_hash").withColumn("graph", F.from_json("result", schema.extraction())).drop("result")
    return hits, hashed.join(stored, "doc_hash", "left_anti")


def cache_rows(extracted: DataFrame) -> DataFrame:
    key = F.col("doc_hash") if "doc_hash" in extracted.columns else content_hash()
    return extracted.select(key.alias("doc_hash"), F.to_json("graph").alias("result"))


def rule_based(frame: pd.DataFrame) -> list[dict]:
    """The default extractor: posting, company, place and year of a document's metadata."""
    out = []
    for m in frame["metadata"]:
        job, company, place = f"job_{m['id']}", f"company_{m['company_name']}", f"place_{m['location']}"
        nodes = [{"id": job, "type": "JobPosting", "properties": {"name": m["job_title"], "salary": m["salary_range"] or ""}}, {"id": company, "type": "Company", "properties": {"name": m["company_name"]}}]
        links = [(job, company, "OFFERED_BY")]
        if m["location"]:
            nodes.append({"id": place, "type": "Location", "properties": {"name": m["location"].split("-")[0]}})
            links.append((job, place, "LOCATED_IN"))
        if m["data_year"] and not pd.isna(m["data_year"]):
            year = str(int(m["data_year"]))
            nodes.append({"id": f"y{year}", "type": "Year", "properties": {"name": year}})
            links.append((job, f"y{year}", "YEAR"))
        out.append({"nodes": nodes, "relationships": [{"source": a, "target": b, "type": t, "properties": {}} for a, b, t in links]})
    return out


#: Columns that an extractor reads; one that states none is given all.
rule_based.reads = ("metadata",)


def rule_based_graph() -> Column:
    """rule_based as an expression of Spark."""
    m, none = F.col("metadata"), F.lit("None")
    text_of = lambda c: F.coalesce(m[c].cast("string"), none)
    empty = F.create_map().cast("map<string,string>")
    pairs = lambda *x: F.create_map(*x).cast("map<string,string>")
    node = lambda key, kind, props: F.struct(key.alias("id"), F.lit(kind).alias("type"), props.alias("properties"))
    link = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), empty.alias("properties"))
    job, company, place, year = F.concat(F.lit("job_"), text_of("id")), F.concat(F.lit("company_"), text_of("company_name")), F.concat(F.lit("place_"), m["location"]), F.concat(F.lit("y"), m["data_year"].cast("int").cast("string"))
    placed, dated = F.coalesce(m["location"] != "", F.lit(False)), F.coalesce(m["data_year"] != 0, F.lit(False))
    parts = [
        (None, node(job, "JobPosting", pairs(F.lit("name"), m["job_title"], F.lit("salary"), F.coalesce(m["salary_range"], F.lit("")))), None),
        (None, node(company, "Company", pairs(F.lit("name"), m["company_name"])), link(job, company, "OFFERED_BY")),
        (placed, node(place, "Location", pairs(F.lit("name"), F.substring_index(m["location"], "-", 1))), link(job, place, "LOCATED_IN")),
        (dated, node(year, "Year", pairs(F.lit("name"), m["data_year"].cast("int").cast("string"))), link(job, year, "YEAR")),
    ]
    some = lambda at: F.filter(F.array(*[p[at] if p[0] is None else F.when(p[0], p[at]) for p in parts if p[at] is not None]), lambda x: x.isNotNull())
    return F.struct(some(1).alias("nodes"), some(2).alias("relationships")).cast(schema.extraction())


#: The same as an expression, where an extractor has one: no row of it goes to Python.
rule_based.expression = rule_based_graph


def read_by(docs: DataFrame, extractor: Callable) -> DataFrame:
    """The id of docs and what the extractor reads: texts that it does not look at are not sent to Python."""
    reads = getattr(extractor, "reads", None)
    return docs if reads is None else docs.select("id", *reads)


def extract(docs: DataFrame, extractor: Callable[[pd.DataFrame], list[dict]] = rule_based) -> DataFrame:
    """docs with success, error_msg and graph (schema.extraction); an extractor in Python takes one Arrow batch at a time, a failing batch fails its rows only."""
    if (made := getattr(extractor, "expression", None)) is not None:
        return docs.withColumns({"graph": made(), "success": F.lit(True), "error_msg": F.lit(None).cast("string")})
    ship(docs.sparkSession)
    more = [T.StructField("graph", schema.extraction()), T.StructField("success", T.BooleanType()), T.StructField("error_msg", T.StringType())]
    out = T.StructType([*docs.schema.fields, *more])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                frame = frame.assign(graph=extractor(frame), success=True, error_msg=None)
            except Exception as e:  # the rows are retried by a later run
                frame = frame.assign(graph=[{"nodes": [], "relationships": []}] * len(frame), success=False, error_msg=str(e)[:500])
            yield frame

    return docs.mapInPandas(each, out)


def extract_each(docs: DataFrame, extractor: Callable[[pd.DataFrame], list[dict]] = rule_based) -> DataFrame:
    """extract with one document a call, so that a failing document fails alone; an expression takes each by itself anyway."""
    if getattr(extractor, "expression", None) is not None:
        return extract(docs, extractor)

    def one_by_one(frame: pd.DataFrame) -> list[dict]:
        return [extractor(frame.iloc[k : k + 1])[0] for k in range(len(frame))]

    return extract(docs, one_by_one)


def batch_graphs(extracted: DataFrame, batch: str = "batch", key: str = "id") -> DataFrame:
    """Each document with the nodes and relationships of its whole batch, in order of the documents; a batch is a few documents by contract."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("graph").alias("g"))), lambda a, b: F.signum(a["k"] - b["k"]).cast("int"))
    whole = extracted.groupBy(batch).agg(parts.alias("parts"))
    whole = whole.select(batch, F.struct(F.flatten(F.transform("parts", lambda p: p["g"]["nodes"])).alias("nodes"), F.flatten(F.transform("parts", lambda p: p["g"]["relationships"])).alias("relationships")).alias("graph"))
    return extracted.drop("graph").join(whole, batch)


def parsed_extractions(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with the graph that their JSON text tells of, after repair and strict filtering of labels, types and ends."""
    from ..functions import dialogue

    read = answers.withColumn("graph", F.from_json(dialogue.repair_json(F.col(answer)), schema.extraction())).where(F.col("graph").isNotNull())
    allowed = lambda name, kinds: F.filter(F.coalesce(f"graph.{name}", F.array()), lambda x: x["type"].isin(kinds)).alias(name)
    return G.sanitize_extraction(read.withColumn("graph", F.struct(allowed("nodes", schema.NODE_LABELS), allowed("relationships", schema.EDGE_TYPES))))


def graph_rows(extracted: DataFrame, apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cleaned (nodes, edges) of extractions: ids by name, merged places and years, remapped and valid edges.

    apart: companies of different names whose short hashes are equal keep a row each, as places do; a load keeps one row an id.
    """
    clean = G.sanitize_extraction(extracted.withColumnRenamed("id", "doc"))
    raw = G.flatten_nodes(clean, keys=["doc"]).withColumn("ord", F.struct("doc", "pos"))
    companies, places, years = G.clean_companies(raw), G.clean_locations(raw), G.clean_years(raw)
    text_map = "map<string,string>"
    props = lambda *names: F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v != "").cast(text_map)
    named = lambda df, label, *names: df.select("id", F.array(F.lit(label)).alias("labels"), props(*names).alias("properties"))
    jobs = G.keep_first_nodes(raw.where(F.col("type").isin("JobPosting", "Skill")).select("id", "type", "properties", "ord")).select("id", F.array("type").alias("labels"), "properties")
    nodes = jobs.unionByName(named(G.keep_first_nodes(companies.select("id", "name", "ord"), *["name"] * apart), "Company", "name")).unionByName(named(G.merge_locations(places), "Location", "name", "city", "province")).unionByName(named(G.keep_first_nodes(years.select("id", "name", "ord")), "Year", "name"))
    edges = G.flatten_edges(clean).select("src", "dst", "type", "properties")
    edges = G.valid_edges(G.remap_edges(edges, G.id_mapping(companies, places, years)), nodes)
    return nodes, G.edge_key(edges).dropDuplicates(["src", "type", "dst", "_props"]).drop("_props")
