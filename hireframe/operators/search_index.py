"""Substring search over stored rows with a signature of character grams beside each file.

A file's signature of a column has a bit for each (hashed) run of three characters that a value of it holds, whatever the
case. A file can hold a keyword only if all of the keyword's runs are there, so a search reads the signatures, some
kilobytes a file, and then only the files that are left, with the same test as without an index. Files are the unit that
is pruned: they are written with a bounded number of rows, in an order that brings like values together.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .listings import grams, search

#: Bits of a signature, as many as a bitmap has; rows of a file.
BITS, ROWS = 32_768, 100_000
RUN = 3


def bit_numbers(value: Column) -> Column:
    """Bits of a text's runs of three characters."""
    return F.array_distinct(F.transform(grams(F.lower(value), RUN), lambda g: F.pmod(F.xxhash64(g), F.lit(BITS))))


def save_searchable(df: DataFrame, path: str, columns: list[str], order: list[str], rows: int = ROWS) -> None:
    """Stores df in the order given, in files of at most so many rows, and the signatures of some text columns."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("file"), *columns)
    # like values lie together, so a file has far fewer values than rows; each is taken apart once a file
    values = [stored.select("file", F.lit(c).alias("column"), F.col(c).alias("value")).distinct() for c in columns]
    parts = [v.select("file", "column", F.explode(bit_numbers(F.col("value"))).alias("bit")) for v in values]
    signed = reduce(DataFrame.unionByName, parts).groupBy("file", "column").agg(F.bitmap_construct_agg("bit").alias("bits"))
    signed.write.mode("overwrite").parquet(f"{path}/signatures")


def may_hold(bits: Column, keyword: str) -> Column:
    """Whether a file with this signature can hold the keyword; wildcards part it, pieces shorter than a run tell nothing."""
    pieces = [p for p in re.split(r"[%_\\]", keyword) if len(p) >= RUN]
    if not pieces:
        return F.lit(True)
    wanted = F.flatten(F.array(*[bit_numbers(F.lit(p)) for p in pieces]))
    byte = lambda n: F.conv(F.hex(F.substring(bits, F.floor(n / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.forall(wanted, lambda n: F.floor(byte(n) / F.pow(F.lit(2), n % 8)) % 2 == 1)


def files_of(spark: SparkSession, path: str, keywords: dict[str, str], everywhere: bool = False) -> list[str]:
    """Names of the files that can hold the keywords of their columns: any of them, or all."""
    signed = spark.read.parquet(f"{path}/signatures")
    held = reduce(Column.__or__, [(F.col("column") == c) & may_hold(F.col("bits"), k) for c, k in keywords.items()])
    least = len(keywords) if everywhere else 1
    kept = signed.where(held).groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sorted(r["file"] for r in kept.select("file").collect())  # one name a file


def search_indexed(spark: SparkSession, path: str, job_title: str | None = None, company_name: str | None = None, location: str | None = None, search_keyword: str | None = None, data_year: int | None = None) -> DataFrame:
    """The rows that the search of listings gives, read from the files that can hold them only."""
    base = spark.read.parquet(f"{path}/rows")
    names: set[str] | None = None
    signed = {r["column"] for r in spark.read.parquet(f"{path}/signatures").select("column").distinct().collect()}
    asked = [({c: v}, True) for c, v in (("job_title", job_title), ("company_name", company_name), ("location", location)) if v and c in signed]
    anywhere = ["job_title", "company_name", "requirements", "search_keyword"]
    if search_keyword and signed.issuperset(anywhere):
        asked.append(({c: search_keyword for c in anywhere}, False))
    for keywords, everywhere in asked:
        if all(len(p) < RUN for k in keywords.values() for p in re.split(r"[%_\\]", k)):
            continue  # too short to prune by
        some = set(files_of(spark, path, keywords, everywhere))
        names = some if names is None else names & some
    rows = base if names is None else spark.read.schema(base.schema).parquet(*[f"{path}/rows/{n}" for n in sorted(names)]) if names else base.limit(0)
    return search(rows, job_title, company_name, location, search_keyword, data_year)
