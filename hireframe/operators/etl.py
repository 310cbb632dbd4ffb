"""Batch ETL on crawl sheets: union, de-duplication, merging, import. Row order is an explicit ordinal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import written

#: Names that an id column may have, best first.
ID_ALIASES = ["职位id", "职位Id", "job_id", "jobId", "id"]


def with_id_column(df: DataFrame, name: str = "职位ID", aliases: list[str] | None = None) -> DataFrame:
    """The first alias that is there, renamed; a fixed order."""
    if name in df.columns:
        return df
    found = next((a for a in aliases or ID_ALIASES if a in df.columns), None)
    return df.withColumnRenamed(found, name) if found else df


def union_sheets(sheets: list[DataFrame]) -> DataFrame:
    """All rows, columns in the order of first appearance, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def drop_empty_ids(df: DataFrame, key: str, into: str = "_nid") -> DataFrame:
    return df.withColumn(into, text.normalize_id(F.col(key))).where(F.length(into) > 0)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; independent of how rows are partitioned."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def append_sheet(target: DataFrame, extra: DataFrame, key: str, order: str) -> DataFrame:
    """target and extra, first row of each id, target before extra."""
    rows = union_sheets([target.withColumn("_source", F.lit(0)), extra.withColumn("_source", F.lit(1))])
    return keep_first(drop_empty_ids(rows, key), ["_nid"], [F.col("_source"), F.col(order)]).drop("_source", "_nid")


def first_nonblank(column: str, order: str) -> Column:
    """Aggregate: the first value that is not blank, else the first; partial aggregation applies."""
    filled = F.when(text.strip(F.col(column)) != "", F.col(column))
    return F.coalesce(F.min_by(filled, F.when(filled.isNotNull(), F.col(order))), F.min_by(column, order))


def longest_of(cleaned: Column, order: str) -> Column:
    """Aggregate: the longest of cleaned texts, the earliest of equals; empty if all are blank."""
    return F.coalesce(F.max_by(cleaned, F.when(cleaned != "", F.struct(F.length(cleaned), -F.col(order)))), F.lit(""))


def longest_text(column: str, order: str) -> Column:
    return longest_of(text.strip_brand_noise(F.col(column)), order)


def merge_by_id(rows: DataFrame, key: str, order: str, desc: str, duty: str) -> DataFrame:
    """One row an id: first non-blank values in file order, the best texts, repeated duties dropped."""
    # texts are cleaned in a projection of their own, so once
    kept = drop_empty_ids(rows, key).withColumns({"_desc": text.strip_brand_noise(F.col(desc)), "_duty": text.strip_brand_noise(F.col(duty))})
    others = [c for c in rows.columns if c not in (key, order, desc, duty)]
    merged = kept.groupBy("_nid").agg(*[first_nonblank(c, order).alias(c) for c in others], longest_of(F.col("_desc"), order).alias("_d"), longest_of(F.col("_duty"), order).alias("_r"))
    both = text.merge_description_duty(F.col("_d"), F.col("_r"))
    return merged.withColumn("_both", both).select(F.col("_nid").alias(key), *others, F.col("_both.description").alias(desc), F.col("_both.duty").alias(duty))


def merge_metrics(rows: DataFrame, key: str) -> DataFrame:
    """Input rows, rows without an id, duplicates and output rows, in one pass."""
    nid = text.normalize_id(F.col(key))
    out = rows.select(nid.alias("nid")).groupBy("nid").agg(F.count("*").alias("n"))
    out = out.agg(F.sum("n").alias("input_rows"), F.sum(F.when(F.col("nid") == "", F.col("n")).otherwise(0)).alias("dropped_empty_id"), F.count_if(F.col("nid") != "").alias("output_rows"))
    return out.withColumn("duplicates", F.col("input_rows") - F.col("dropped_empty_id") - F.col("output_rows"))


def page_duplicates(rows: DataFrame, group: str, page: str, key: str, limit: float = 0.8) -> DataFrame:
    """Per page: how many of its ids an earlier page of the group had, their share, and whether it is to be skipped."""
    first = F.min(page).over(Window.partitionBy(group, key))
    seen = rows.withColumn("_first", first)
    out = seen.groupBy(group, page).agg(F.count("*").alias("jobs"), F.sum(F.when(F.col("_first") < F.col(page), 1).otherwise(0)).alias("duplicates"))
    return out.withColumn("ratio", F.round(F.col("duplicates") / F.col("jobs"), 4)).withColumn("skipped", F.col("duplicates") / F.col("jobs") > limit)


def import_projection(sheet: DataFrame, now: Column) -> DataFrame:
    """A crawl sheet as rows of job_listings (without ids)."""
    col = lambda name, most=None: text.clipped(F.col(name), most)
    return sheet.select(
        F.coalesce(col("岗位名称", 250), F.lit("未知")).alias("job_title"),
        F.coalesce(col("公司名称", 250), F.lit("未知")).alias("company_name"),
        col("薪资范围", 100).alias("salary_range"),
        F.lit(None).cast("int").alias("salary_avg"),
        col("城市", 100).alias("location"),
        F.lit(1).alias("openings"),
        col("职位描述").alias("requirements"),
        col("搜索关键词", 100).alias("search_keyword"),
        text.to_year(F.col("数据年份")).alias("data_year"),
        now.alias("created_at"),
    )


def with_surrogate_ids(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Dense ids from start + 1 in a total order, ranked in two steps so that no task sorts all rows.

    The ranges are written before they are counted: read again from the same files, a row keeps its range though executors are lost.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    offsets, total = [], start
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    table = rows.sparkSession.createDataFrame(offsets or [(0, start)], "_part int, _offset long")
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_n", number).join(F.broadcast(table), "_part").withColumn("id", F.col("_n") + F.col("_offset")).drop("_part", "_n", "_offset")


def write_sheet(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or csv in UTF-8 with a header."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


# Keyed changes of the account tables.


def insert_unless_known(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """known and the rows of new whose key is not there yet (the first of new's own repeats)."""
    fresh = keep_first(new, [key], [F.col(c) for c in new.columns if c != key] or [F.col(key)])
    return known.unionByName(fresh.join(known.select(key), key, "left_anti").select(*known.columns), allowMissingColumns=True)


def partial_update(known: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null values of changes replace those of the same key."""
    fields = [c for c in changes.columns if c != key and c in known.columns]
    named = changes.select(key, *[F.col(c).alias("_new_" + c) for c in fields])
    out = known.join(named, key, "left")
    return out.select(*[F.coalesce(F.col("_new_" + c), F.col(c)).alias(c) if c in fields else F.col(c) for c in known.columns])


def delete_keys(known: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return known.join(keys.select(key), key, "left_anti")
