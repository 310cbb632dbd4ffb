"""Data quality: salary enrichment, mapping coverage, cleaning of the city dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, salary
from .listings import match_provinces


def salary_table(listings: DataFrame, mode: str = "compat") -> DataFrame:
    """(salary_range, monthly): each distinct text parsed once; there are far fewer texts than listings."""
    return listings.select("salary_range").where("salary_range IS NOT NULL").distinct().withColumn("monthly", salary.parse_salary(F.col("salary_range"), mode))


def fill_salary(listings: DataFrame, mode: str = "compat") -> DataFrame:
    """salary_avg parsed where it is needed and the text gives it; with a column monthly, what the text gives."""
    out = listings.join(salary_table(listings, mode), "salary_range", "left")
    needed = salary.needs_salary(F.col("salary_range"), F.col("salary_avg"))
    filled = F.when(needed, F.coalesce("monthly", "salary_avg")).otherwise(F.col("salary_avg"))
    return out.withColumn("salary_avg", filled).select(*listings.columns, "monthly")


def unparsed_formats(listings: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent salary texts that the parser does not read."""
    counts = listings.where(salary.needs_salary(F.col("salary_range"), F.col("salary_avg"))).groupBy("salary_range").agg(F.count("*").alias("cnt"))
    failed = counts.where(salary.parse_salary(F.col("salary_range")).isNull())
    return failed.select(F.coalesce("salary_range", F.lit("NULL")).alias("format"), "cnt").orderBy(F.desc("cnt"), "format").limit(top)


def unparsed_report(listings: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent unread formats, and one row "others" with the number of formats and rows beyond them."""
    counts = unparsed_formats(listings, 2**31 - 1)
    best = counts.orderBy(F.desc("cnt"), "format").limit(top)
    sums = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"))
    others = sums(counts).crossJoin(sums(best).toDF("n_best", "rows_best"))  # one row each
    rest = others.select(F.lit("others").alias("format"), (F.col("rows") - F.col("rows_best")).alias("cnt"), (F.col("n") - F.col("n_best")).alias("formats"))
    return best.select("format", "cnt", F.lit(1).cast("long").alias("formats")).unionByName(rest)


def location_counts(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("location").isNotNull() & (F.col("location") != "")).groupBy("location").agg(F.count("id").alias("cnt"))


def coverage(listings: DataFrame, cities: DataFrame) -> DataFrame:
    """(location, cnt, province, matched): each distinct location against the dimension, without the alias tier."""
    found = match_provinces(location_counts(listings), cities, aliases=False, unknown=None, carry=["cnt"])
    return found.select("location", "cnt", "province", F.col("province").isNotNull().alias("matched"))


def coverage_report(covered: DataFrame) -> DataFrame:
    """One row of counts and percentages."""
    hit = F.when(F.col("matched"), 1).otherwise(0)
    out = covered.agg(F.sum(hit).alias("matched_locations"), F.sum(1 - hit).alias("unmatched_locations"), F.sum(F.col("cnt") * hit).alias("matched_rows"), F.sum("cnt").alias("total_rows"))
    return out.withColumn("matched_percent", F.round(100 * F.try_divide("matched_rows", "total_rows"), 2))


def missing_cities(covered: DataFrame) -> DataFrame:
    """Unmatched locations and the city names that the dimension lacks, most frequent first."""
    return covered.where("NOT matched").select("location", geo.city_name(F.col("location")).alias("city"), "cnt").orderBy(F.desc("cnt"), "location")


def clean_cities(cities: DataFrame) -> DataFrame:
    """(short_name, full_name, cleaned, changed): what a cleaning run would write; write ``cleaned`` to apply it."""
    cleaned = geo.clean_full_name(F.col("full_name"))
    return cities.select("short_name", "full_name", cleaned.alias("cleaned"), (~F.col("full_name").eqNullSafe(cleaned)).alias("changed"))
