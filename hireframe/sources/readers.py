"""Sources: CSV, spreadsheets, JSON pages, HTML pages, folders of sheets. All bytes come through Spark's readers."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..shipping import ship


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header, quoted line breaks allowed; no inference pass: columns are text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def load_listings(spark: SparkSession, kind: str, **options) -> DataFrame:
    """Listings from a jdbc table, a csv file or a table in any format of Spark."""
    if kind == "csv":
        return read_csv(spark, options["path"], options.get("schema"))
    if kind in ("jdbc", "mysql"):
        return spark.read.format("jdbc").options(**options).load()
    return spark.read.format(kind).load(options["path"])


def sheet_files(spark: SparkSession, path: str, pattern: str = "*.xlsx", skip_prefix: str = "ict_jobs_deduped_") -> DataFrame:
    """(path, name, content) of a folder's sheets, without lock files and our own outputs, in order of the lower-case name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return files.where(~F.startswith("name", F.lit("~$")) & ~F.startswith("name", F.lit(skip_prefix))).withColumn("ord", F.lower("name"))


# Spreadsheets: the parts of Office Open XML that tables need.

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _elements(file, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, one after the other; what was read is let go."""
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == tag:
            yield element
            if above:
                above[-1].clear()


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of a workbook's first sheet as text, row by row; the sheet is never whole in memory, but for its packed bytes and shared texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as file:
                shared = ["".join(t.text or "" for t in si.iter(NS + "t")) for si in _elements(file, NS + "si")]
        first = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        with z.open(first) as file:
            for row in _elements(file, NS + "row"):
                yield _cells(row, shared)


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
    cells: dict[int, str | None] = {}
    for k, c in enumerate(row.iter(NS + "c")):
        kind, value = c.get("t"), c.find(NS + "v")
        at = column_number(c.get("r") or "") if c.get("r") else k
        if kind == "inlineStr":
            cells[at] = "".join(t.text or "" for t in c.iter(NS + "t"))
        elif value is not None:
            cells[at] = shared[int(value.text)] if kind == "s" else value.text
    return [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def sheet_bytes(header: list[str], rows: Iterable[list]) -> bytes:
    """A workbook with one sheet of text cells."""
    out = io.BytesIO()
    write_sheet(out, header, rows)
    return out.getvalue()


def write_sheet(out, header: list[str], rows: Iterable[list]) -> None:
    """Writes a workbook with one sheet of text cells to an open file, row by row."""
    from xml.sax.saxutils import escape

    line = lambda cells: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' if v is not None else "<c/>" for v in cells) + "</row>"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    start = '<?xml version="1.0" encoding="UTF-8"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, start + body)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f"{start}<worksheet {main}><sheetData>{line(header)}".encode())
            for row in rows:
                sheet.write(line(row).encode())
            sheet.write(b"</sheetData></worksheet>")


#: Rows that a sheet can hold below its header, by its format.
SHEET_ROWS = 1_048_575


def write_xlsx(df: DataFrame, path: str, most: int = SHEET_ROWS) -> str:
    """One workbook at path; more rows than a sheet holds go to csv with a byte order mark instead. Returns the kind written.

    The format is one file of at most ``most`` rows, which one task writes row by row; larger tables stay distributed.
    """
    spark = df.sparkSession
    if df.limit(most + 1).count() > most:
        marked = [F.col(f"`{c}`").alias(("\ufeff" if k == 0 else "") + c) for k, c in enumerate(df.columns)]
        df.select(*marked).write.mode("overwrite").option("header", True).option("escape", '"').csv(path + ".csv")
        return "csv"
    columns = df.columns
    said = lambda rows: ([None if v is None else str(v) for v in r] for r in rows)
    if re.match(r"(?:file:)?/", path):
        ship(spark)
        local = re.sub(r"^file:/+", "/", path)

        def write(rows):
            os.makedirs(os.path.dirname(local), exist_ok=True)
            part = f"{local}.{uuid.uuid4().hex}"  # a task that runs again does not write into the first one's file
            with open(part, "wb") as out:
                write_sheet(out, columns, said(rows))
            os.replace(part, local)
            return iter([1])

        df.coalesce(1).rdd.mapPartitions(write).count()
        return "xlsx"
    # other file systems have no client in Python: the driver packs the rows as they come
    data = sheet_bytes(columns, said(df.toLocalIterator()))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return "xlsx"


#: Rows of a sheet that a reading task has in hand.
ROWS_AT_ONCE = 2000


def header_of(row: list[str | None]) -> list[str]:
    return [h or f"c{i}" for i, h in enumerate(row)]


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one or many sheets as text columns, with _file and _row; a sheet is one task's work."""
    ship(spark)
    files = sheet_files(spark, path)

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                rows = sheet_rows(content)
                header, done = header_of(next(rows, [])), 0
                while part := list(islice(rows, ROWS_AT_ONCE)):
                    data = [{h: r[i] for i, h in enumerate(header) if i < len(r) and r[i] is not None} for r in part]
                    yield pd.DataFrame({"_file": name, "_row": range(done, done + len(data)), "cells": data})
                    done += len(data)

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                first = list(islice(sheet_rows(content), 2))
                if len(first) == 2:
                    yield pd.DataFrame({"_file": [name], "header": [header_of(first[0])]})

    rows = files.mapInPandas(cells, "_file string, _row long, cells map<string,string>")
    headers = [r["header"] for r in files.mapInPandas(heads, "_file string, header array<string>").orderBy(F.lower("_file")).collect()]  # one row a file
    names = list(dict.fromkeys(h for header in headers for h in header))
    return rows.select("_file", "_row", *[F.col("cells")[n].alias(n) for n in names])


# JSON pages of the list API.

JOB = "encryptJobId string, jobId string, jobName string, brandName string, cityName string, areaDistrict string, businessDistrict string, jobDegree string, jobExperience string, salaryDesc string, jobLabels array<string>, skills array<string>, bossName string, bossTitle string, brandIndustry string, brandScaleName string, jobDesc string, postDescription string, jobDescription string, encryptJobDesc string, jobType string"
PAGE_SCHEMA = f"struct<zpData:struct<page:int,currentPage:int,totalPage:int,totalPages:int,totalCount:int,jobList:array<struct<{', '.join(JOB.split(', ')).replace(' ', ':').replace(',:', ',')}>>>>"


def list_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Pages with their counters from any of the names these have; unreadable bodies give nulls."""
    z = F.from_json(body, PAGE_SCHEMA)["zpData"]
    return pages.withColumn("_z", z).withColumn("page_no", F.coalesce("_z.page", "_z.currentPage", F.lit(1))).withColumn("pages", F.coalesce("_z.totalPage", "_z.totalPages", F.lit(1))).withColumn("total", F.coalesce("_z.totalCount", F.lit(0)))


def list_jobs(pages: DataFrame, body: str = "body", default_city: str = "全国") -> DataFrame:
    """One row a listed job: page_no, idx and the fields of a crawl sheet."""
    rows = list_pages(pages, body).select("page_no", F.posexplode("_z.jobList").alias("idx", "j"))
    j = lambda n: F.coalesce(F.col(f"j.{n}"), F.lit(""))
    key = F.coalesce("j.encryptJobId", "j.jobId", F.lit(""))
    place = F.concat_ws("_", "page_no", "idx")
    return rows.select(
        "page_no",
        "idx",
        text.surrogate_id(key, j("jobName"), j("brandName"), j("cityName"), place).alias("职位ID"),
        j("jobName").alias("岗位名称"),
        text.work_location(j("cityName"), j("areaDistrict"), j("businessDistrict"), default_city).alias("工作地点"),
        j("brandName").alias("公司名称"),
        j("salaryDesc").alias("薪资范围"),
        F.array_join(F.coalesce("j.jobLabels", F.array()), ",").alias("职位标签"),
        F.array_join(F.coalesce("j.skills", F.array()), " ").alias("技能关键词"),
        text.first_nonblank(*[F.col(f"j.{k}") for k in text.DESCRIPTION_KEYS]).alias("职位描述"),
    )


# HTML.


def links(html: Column, most: int = 30) -> Column:
    """Distinct non-empty targets of a page's links, in order, at most ``most`` (the page list's own limit)."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))), 1, most)


class _Blocks(HTMLParser):
    """Texts of elements, by tag and class."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.done = wanted, [], []

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.handle_endtag("p")
        attrs = {k: v or "" for k, v in attrs}
        if self.wanted(tag, attrs):
            self.open.append([tag, attrs, []])

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            name, attrs, parts = self.open.pop()
            self.done.append((name, attrs, " ".join("".join(parts).split())))

    def handle_data(self, data):
        for _, _, parts in self.open:
            parts.append(data)


def paragraphs_of(html: str | None, least: int = 10, css_class: str | None = None) -> list[str]:
    """Paragraph texts longer than ``least``, outside label lists; with a class only those."""
    parser = _Blocks(lambda tag, attrs: tag == "p" and (css_class is None or css_class in attrs.get("class", "").split()) and "label" not in attrs.get("class", ""))
    parser.feed(html or "")
    parser.close()
    for tag, attrs, parts in parser.open:
        parser.done.append((tag, attrs, " ".join("".join(parts).split())))
    return [t for _, _, t in parser.done if len(t) > least]


@F.pandas_udf(T.ArrayType(T.StringType()))
def paragraphs(column: pd.Series) -> pd.Series:
    return column.map(paragraphs_of)


def longest_paragraph(html: Column) -> Column:
    """The longest paragraph, the first of equals; null without any."""
    found = F.transform(paragraphs(html), lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p")))
    return F.array_max(found)["p"]
