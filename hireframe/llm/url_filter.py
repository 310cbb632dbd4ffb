"""URL filter by rules (host, path prefix), as a sort-merge range join in DataFrame operations.

A host is turned into its reversed labels (``www.example.com`` -> ``com.example.www``), so a rule for a
host and its subdomains becomes a prefix of the key. A verdict depends on host and path alone, so each
pair of them is judged once: it asks at every level of its host that some rule can have; within one host a
rule's path prefix is the interval [path, path + 0xFF) of bytes, and the intervals of a host are nested or
disjoint. Rule bounds and pairs are sorted together by (host, path) and swept once: the running sum of
starts and ends is the depth of the stack of active rules, and the rule last opened at that depth is its
top. A rule covers a set of hosts times a set of paths, which is no one interval of a joined key: that is
why the levels of a host are asked one by one, and the longest of their tops wins. Rows then take the
verdict of their pair by a join.

Skew: a host may hold most pairs (all of ``com``), and a pair most rows. Hosts above 1/512 of the asked keys (at
most 512 of them, whatever the input) are split into salts, and their rules repeated for each salt; rows of a hot
pair are dealt over salts in the join, by their place in what was read, so rows that are equal are split as well.

Defined results: null url or no ``://`` gives empty host and path and the default verdict; repeated rows
stay; of rules with the same host and path, ``block`` wins; an empty rule table leaves every url to the
default; of the rules that fit, the longest (host plus path) wins, the longer host on ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import hot_keys, spread_join, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host is hot above this share of the asked keys; at most so many hosts can be.
HOT_SHARES = 512

#: The fixed rules of the query op1_url_filter.
QUERY_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: its key, host, path, the rule that won (or null) and the verdict."""
    ruled = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("host"), F.col("path"), F.col("verdict"))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("rhost", reversed_host(F.col("host")))
    )
    depth = ruled.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("d")).first()["d"] or 1

    urls = pages.select(F.col(key).alias("_id"), F.coalesce(url_host(F.col(url)), F.lit("")).alias("host"), F.coalesce(url_path(F.col(url)), F.lit("")).alias("path"))
    pairs = written(urls.groupBy("host", "path").agg(F.count("*").alias("rows")), "url-pairs")
    labels = F.reverse(F.split("host", r"\.", -1))
    levels = F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(depth)))
    asked = (
        pairs.withColumn("_labels", labels)
        .select("host", "path", "_labels", F.explode(levels).alias("level"))
        .select("host", "path", F.array_join(F.slice("_labels", F.lit(1), F.col("level")), ".").alias("rhost"))
    )
    counts = asked.groupBy("rhost").count()
    total = counts.agg(F.sum("count").alias("n")).first()["n"] or 0
    hot = counts.where(F.col("count") * HOT_SHARES > total).select("rhost", F.ceil(F.col("count") * HOT_SHARES / F.lit(max(total, 1))).cast("int").alias("salts"))

    def salted(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), "rhost", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    bounds = (
        salted(ruled)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select(
            "rhost",
            "salt",
            F.struct(F.length("host") + F.length("path"), F.length("host"), F.concat("host", "path"), "verdict").alias("rule"),
            F.explode(
                F.array(
                    F.struct(F.col("path").cast("binary").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
                    F.struct(F.concat(F.col("path").cast("binary"), F.unhex(F.lit("FF"))).alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("step")),
                )
            ).alias("e"),
        )
        .select("rhost", "salt", F.when(F.col("e.kind") == 0, F.col("rule")).alias("rule"), "e.*")
    )
    points = salted(asked).select(
        "rhost",
        F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"),
        F.col("path").cast("binary").alias("at"),
        F.lit(1).alias("kind"),
        F.lit(0).alias("step"),
        "host",
        "path",
    )
    swept = bounds.unionByName(points, allowMissingColumns=True)
    order = Window.partitionBy("rhost", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("rhost", "salt", "depth").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    topped = (
        swept.withColumn("depth", F.sum("step").over(order))
        .withColumn("top", F.last("rule", ignorenulls=True).over(level))
        .where((F.col("kind") == 1) & (F.col("depth") > 0) & F.col("top").isNotNull())
    )
    best = topped.groupBy("host", "path").agg(F.max("top").alias("top"))
    rows = pairs.agg(F.sum("rows").alias("n")).first()["n"] or 0
    place = F.monotonically_increasing_id()  # of a row among those its task reads: the same whenever the task runs again
    judged = spread_join(urls, best, ["host", "path"], hot_keys(pairs, ["host", "path"], "rows", rows), place, "left")
    return judged.select(F.col("_id").alias(key), "host", "path", F.col("top.col3").alias("rule"), F.coalesce(F.col("top.verdict"), F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, QUERY_RULES))


ORACLE = """
WITH rules(rhost, rpath, verdict) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')),
rest AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT rid, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT rid, max((length(rhost) + length(rpath), length(rhost), rhost || rpath, verdict)) AS t
         FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, t[3] AS rule, coalesce(t[4], 'allow') AS verdict FROM parts LEFT JOIN hits USING (rid)
"""
