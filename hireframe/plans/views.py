"""Domain views over the driver's tables, in DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city_mapping with a fixed order; the dimension has 25 rows."""
    from pyspark.sql import Window

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.col("n_name").alias("short_name"), F.col("r_name").alias("full_name"), F.row_number().over(Window.orderBy("n_name")).alias("ord"))


CITIES = "cities AS (SELECT n_name AS short_name, r_name AS full_name, row_number() OVER (ORDER BY n_name) AS ord FROM nation JOIN region ON n_regionkey = r_regionkey)"


def salary_text(order: str = "o_orderkey", k: str = "k"):
    """Salary texts of many shapes, made from whole numbers."""
    return F.expr(f"""CASE {order} % 14
        WHEN 0 THEN concat({k}, '-', {k} + 3, 'K') WHEN 1 THEN concat({k}, '-', {k} + 3, 'K·13薪') WHEN 2 THEN concat({k}, '000-', {k} + 2, '000元/月')
        WHEN 3 THEN concat({k}, '万以上/月') WHEN 4 THEN '面议' WHEN 5 THEN concat({k}, '0元/小时') WHEN 6 THEN concat({k}, '-', {k} + 7, '万/年')
        WHEN 7 THEN concat({k}, '00元/天') WHEN 8 THEN concat({k}, '-', {k} + 1, '万') WHEN 9 THEN concat({k}, '千-', {k} + 1, '万')
        WHEN 10 THEN concat({k}, '00-', {k} + 1, '00元/天') WHEN 11 THEN concat('约', {k}, 'K') WHEN 12 THEN concat({k}, '千以下/月') END""")


SALARY_SQL = """CASE o_orderkey % 14
        WHEN 0 THEN concat(k, '-', k + 3, 'K') WHEN 1 THEN concat(k, '-', k + 3, 'K·13薪') WHEN 2 THEN concat(k, '000-', k + 2, '000元/月')
        WHEN 3 THEN concat(k, '万以上/月') WHEN 4 THEN '面议' WHEN 5 THEN concat(k, '0元/小时') WHEN 6 THEN concat(k, '-', k + 7, '万/年')
        WHEN 7 THEN concat(k, '00元/天') WHEN 8 THEN concat(k, '-', k + 1, '万') WHEN 9 THEN concat(k, '千-', k + 1, '万')
        WHEN 10 THEN concat(k, '00-', k + 1, '00元/天') WHEN 11 THEN concat('约', k, 'K') WHEN 12 THEN concat(k, '千以下/月') END"""


def listings(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """job_listings from orders, customers and nations; with texts also requirements, from documents."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    out = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    k = (F.floor(F.col("o_totalprice") / 20000) + 1).cast("long")
    pay = F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 10) AS INT) END")
    out = out.withColumn("k", k).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("job_title"),
        F.col("c_name").alias("company_name"),
        salary_text().alias("salary_range"),
        pay.alias("salary_avg"),
        F.concat("n_name", F.lit("-"), "c_mktsegment").alias("location"),
        F.lit(1).alias("openings"),
        F.col("c_mktsegment").alias("search_keyword"),
        F.year("o_orderdate").alias("data_year"),
        F.col("o_orderdate").alias("created_at"),
    )
    if texts:
        docs = table(spark, sf_dir, "documents")
        n = docs.count()
        out = out.withColumn("_doc", F.col("id") % n).join(docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("requirements")), "_doc", "left").drop("_doc")
    return out


def listing_sql(texts: bool = False) -> str:
    more = ", d.text AS requirements" if texts else ""
    join = " LEFT JOIN documents d ON d.doc_id = o_orderkey % (SELECT count(*) FROM documents)" if texts else ""
    return f"""orders_k AS (SELECT *, CAST(floor(o_totalprice / 20000) AS BIGINT) + 1 AS k FROM orders),
job_listings AS (SELECT o_orderkey AS id, o_orderpriority AS job_title, c_name AS company_name, {SALARY_SQL} AS salary_range,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 10) AS INT) END AS salary_avg,
  n_name || '-' || c_mktsegment AS location, 1 AS openings, c_mktsegment AS search_keyword, year(o_orderdate) AS data_year, o_orderdate AS created_at{more}
  FROM orders_k JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey{join})"""


LISTINGS = listing_sql()
LISTINGS_TEXT = listing_sql(True)

# Latin letters to Han characters, to give the Han tokenizer something to read.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "数据开发工程师负责系统设计维护熟悉了解分布式技"


def han_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, requirements): the documents in Han letters; and (doc_id, data_year, n): the listings that use them."""
    docs = table(spark, sf_dir, "documents")
    size = docs.count()
    uses = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % size).alias("doc_id"), F.year("o_orderdate").alias("data_year")).agg(F.count("*").alias("n"))
    return docs.select("doc_id", F.translate(F.lower("text"), LATIN, HAN).alias("requirements")), uses


HAN_TEXTS = f"""han_texts AS (SELECT translate(lower(text), '{LATIN}', '{HAN}') AS requirements, year(o_orderdate) AS data_year, count(*) AS n
  FROM orders JOIN documents ON doc_id = o_orderkey % (SELECT count(*) FROM documents) GROUP BY doc_id, text, year(o_orderdate))"""
