"""Listing search, pages and yearly statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import salary, text

#: Rows of the city dimension, at most: it is broadcast, and tried row by row on locations without an exact match.
MOST_CITIES = 20_000


def search(listings: DataFrame, job_title: str | None = None, company_name: str | None = None, location: str | None = None, search_keyword: str | None = None, data_year: int | None = None) -> DataFrame:
    """Substring filters that all hold; the keyword may be in any of four columns. Empty and 0 mean no filter.

    Wildcards in a value stay wildcards; case does not count.
    """
    like = lambda c, v: F.col(c).ilike(f"%{v}%")
    tests = [like(c, v) for c, v in (("job_title", job_title), ("company_name", company_name), ("location", location)) if v]
    if search_keyword:
        tests.append(reduce(Column.__or__, [like(c, search_keyword) for c in ("job_title", "company_name", "requirements", "search_keyword")]))
    if data_year:
        tests.append(F.col("data_year") == data_year)
    return listings.where(reduce(Column.__and__, tests)) if tests else listings


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 20, most: int = 100) -> DataFrame:
    """Rows skip .. skip + limit in an order; limit is held within 1..most. No total order is computed beyond them."""
    return df.orderBy(*order).offset(max(skip, 0)).limit(min(max(limit, 1), most))


def listing_page(listings: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    return page(listings, [F.desc("created_at"), F.desc("id")], skip, limit)


def page_envelope(df: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """One row: total, page, size and pages."""
    pages = F.ceil(F.col("total") / limit)
    return df.agg(F.count("*").alias("total")).select("total", F.lit(skip // limit + 1).alias("page"), F.lit(limit).alias("size"), pages.alias("pages"))


def year_range(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where(F.col("data_year").between(start, end))


def zero_filled(counts: DataFrame, category: str) -> DataFrame:
    """A row for each year and category, 0 where counts (data_year, category, cnt) has none.

    counts is small (years times categories); it becomes one row, so what it is made from is read once.
    """
    row = counts.agg(F.collect_list(F.struct("data_year", category, "cnt")).alias("c"))
    row = row.select("c", F.explode(F.array_distinct("c.data_year")).alias("data_year")).select("c", "data_year", F.explode(F.array_distinct(f"c.{category}")).alias(category))
    own = F.filter("c", lambda x: (x["data_year"] == F.col("data_year")) & x[category].eqNullSafe(F.col(category)))
    return row.select("data_year", category, F.coalesce(F.get(own, F.lit(0))["cnt"], F.lit(0)).cast("long").alias("cnt"))


def salary_statistics(listings: DataFrame, start: int = 2022, end: int = 2026) -> DataFrame:
    """(data_year, bucket, bucket_no, cnt): listings by year and salary class, all classes for each year; one pass, one shuffle of counts."""
    paid = year_range(listings.select("data_year", "salary_avg"), start, end).where(F.col("salary_avg").isNotNull() & (F.col("salary_avg") > 0))
    bucket = salary.salary_class(F.col("salary_avg"))
    counts = paid.groupBy("data_year").agg(*[F.count_if(bucket == label).alias(f"n{i}") for i, label in enumerate(salary.LABELS)])
    entries = F.array(*[F.struct(F.lit(i).alias("bucket_no"), F.lit(label).alias("bucket"), F.col(f"n{i}").alias("cnt")) for i, label in enumerate(salary.LABELS)])
    return counts.select("data_year", F.inline(entries))


def yearly_totals(stats: DataFrame) -> DataFrame:
    """Totals by year and over all (null year)."""
    return stats.rollup("data_year").agg(F.sum("cnt").alias("total"))


def shares(stats: DataFrame) -> DataFrame:
    """Non-empty classes with their share of the year in percent."""
    whole = F.sum("cnt").over(Window.partitionBy("data_year"))
    return stats.where("cnt > 0").withColumn("percent", F.round(100 * F.col("cnt") / whole, 2))


#: Characters of the grams by which names are found within others.
GRAM = 3


def grams(c: Column, *sizes: int) -> Column:
    """Distinct runs of so many characters."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n)))
    runs = [F.when(F.length(c) >= n, one(n)) for n in sizes]
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(r, F.array().cast("array<string>")) for r in runs])))


def name_grams(cities: DataFrame) -> DataFrame:
    """An inverted list of names (side, gram, short_name, full_name, ord): 'name' has each name by its rarest gram, 'part' by all of its grams.

    A text that holds a name holds its rarest gram; a part of a name of at most GRAM characters is a gram, a longer one begins with one.
    Empty texts are part of every name, and an empty name of every text: for these the first name, or the first empty one, will do.
    """
    named = cities.where("short_name IS NOT NULL").select("short_name", "full_name", "ord")
    size = F.least(F.length("short_name"), F.lit(GRAM))
    own = F.when(size == 0, F.array(F.lit(""))).otherwise(F.coalesce(*[F.when(size == n, grams(F.col("short_name"), n)) for n in range(1, GRAM + 1)]))
    each = named.withColumn("gram", F.explode(own))
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(often, "gram").groupBy("short_name", "full_name", "ord").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    parts = named.withColumn("gram", F.explode(grams(F.col("short_name"), *range(1, GRAM + 1))))
    first = named.orderBy("ord").limit(1).withColumn("gram", F.lit(""))
    sides = [rarest.withColumn("side", F.lit("name")), parts.withColumn("side", F.lit("part")), first.withColumn("side", F.lit("part"))]
    return reduce(DataFrame.unionByName, sides)


def match_provinces(locations: DataFrame, cities: DataFrame, column: str = "location", aliases: bool = True, unknown: str | None = "未知", carry: list[str] | None = None) -> DataFrame:
    """Distinct locations with province and tier: 1 exact city, 2 exact alias without 市, 3 first partial match.

    Exact tiers are hash joins. For what they leave, each location once, a partial match (a name within the location, or the
    location's city within a name) is found by an equality of character grams and then verified. The city table is a
    dimension of at most MOST_CITIES rows (checked) with an order (ord). carry: columns to keep, where locations are distinct already.
    """
    from ..functions.geo import city_name

    if cities.limit(MOST_CITIES + 1).count() > MOST_CITIES:
        raise ValueError(f"the city table is a dimension of at most {MOST_CITIES} rows")
    found = locations.select(F.col(column).alias("location"), *(carry or []))
    found = found if carry else found.distinct()
    found = found.withColumn("_where", text.strip(F.col("location"))).withColumn("_city", city_name(F.col("location")))
    first = cities.groupBy("short_name").agg(F.min_by("full_name", "ord").alias("t1"))
    alias = cities.where(F.endswith("short_name", F.lit("市"))).groupBy(F.expr("left(short_name, length(short_name) - 1)").alias("alias")).agg(F.max_by("full_name", "ord").alias("t2"))
    exact = found.join(F.broadcast(first), F.col("_city") == F.col("short_name"), "left").drop("short_name")
    exact = exact.join(F.broadcast(alias), F.col("_city") == F.col("alias"), "left").drop("alias") if aliases else exact.withColumn("t2", F.lit(None).cast("string"))
    asked = lambda side, g: F.struct(F.lit(side).alias("side"), g.alias("gram"))
    within = F.transform(F.array_append(grams(F.col("_where"), *range(1, GRAM + 1)), F.lit("")), lambda g: asked("name", g))
    left = F.col("t1").isNull() & F.col("t2").isNull()
    # the city is asked for by its beginning; a location that is settled asks for nothing
    asking = F.when(left, F.array_append(within, asked("part", F.left("_city", F.lit(GRAM)))))
    exact = exact.withColumn("_ask", F.explode_outer(asking)).select("*", "_ask.side", "_ask.gram").drop("_ask")
    names = name_grams(cities).select(F.col("side").alias("_side"), F.col("gram").alias("_gram"), "short_name", "full_name", "ord")
    partial = F.contains("_where", "short_name") | F.contains("short_name", "_city") | F.contains("_city", "short_name")
    third = exact.join(names, (F.col("side") == F.col("_side")) & (F.col("gram") == F.col("_gram")) & partial, "left")
    kept = [F.first(c).alias(c) for c in ("t1", "t2", *(carry or []))]
    out = third.groupBy("location").agg(*kept, F.min_by("full_name", "ord").alias("t3"))
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    return out.select("location", *(carry or []), F.coalesce("t1", "t2", "t3", F.lit(unknown)).alias("province"), tier.alias("tier"))


def location_statistics(listings: DataFrame, cities: DataFrame, start: int = 2022, end: int = 2026) -> DataFrame:
    """(data_year, province, cnt), all provinces for each year."""
    placed = year_range(listings.select("data_year", "location"), start, end).where(F.col("location").isNotNull() & (F.col("location") != ""))
    counts = placed.groupBy("location", "data_year").agg(F.count("*").alias("n"))
    # a location's years in one row: as many entries as there are years
    by_location = counts.groupBy("location").agg(F.collect_list(F.struct("data_year", "n")).alias("years"))
    matched = match_provinces(by_location, cities, carry=["years"]).select("province", F.inline("years"))
    return zero_filled(matched.groupBy("data_year", "province").agg(F.sum("n").alias("cnt")), "province").select("data_year", "province", "cnt")


def used_texts(texts: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """texts with how often they are used: n over all years, and years (data_year, n), of uses (key, data_year, n); one row a text."""
    by_text = uses.groupBy(key).agg(F.sum("n").alias("n"), F.collect_list(F.struct("data_year", "n")).alias("years"))  # as many entries as there are years
    return texts.join(by_text, key)


def words_of(texts: DataFrame, column: str = "requirements", least: int = 2, carry: tuple[str, ...] = ("n", "years")) -> DataFrame:
    """(word, and what is carried): the Han runs of each text that are no stop words, one row a use in a text.

    What a text's words are counted by comes with them, so they are summed where they are read: only counts of words move.
    """
    words = texts.select(*carry, F.explode(text.han_runs(F.col(column), least)).alias("word"))
    return words.where(~F.col("word").isin(text.STOP_WORDS))


def word_counts(words: DataFrame) -> DataFrame:
    """(data_year, word, cnt) of words (word, years): how many listings of a year have the text."""
    return words.select("word", F.inline("years")).groupBy("data_year", "word").agg(F.sum("n").alias("cnt"))


def overall_counts(words: DataFrame) -> DataFrame:
    """(word, cnt) over all years."""
    return words.groupBy("word").agg(F.sum("n").alias("cnt"))


def top_words(counts: DataFrame, top: int = 100) -> DataFrame:
    """The most frequent of (word, cnt); equal counts in the order of the words."""
    return counts.orderBy(F.desc("cnt"), "word").limit(min(max(top, 10), 500))


def top_words_by_year(words: DataFrame, top: int = 100) -> DataFrame:
    """Yearly counts of the words in the overall top; other words go before the years are told apart."""
    best = top_words(overall_counts(words), top).select("word")
    return word_counts(words.join(F.broadcast(best), "word", "left_semi")).select("data_year", "word", "cnt")


def word_totals(counts: DataFrame) -> DataFrame:
    """Uses and number of words of (word, cnt)."""
    return counts.agg(F.sum("cnt").alias("total_words"), F.count("*").alias("unique_words"))


def color_ratio(words: DataFrame) -> DataFrame:
    """Min-max scaled counts of a top list (0 where all are equal), rank and tier."""
    low, high = words.agg(F.min("cnt").alias("low")), words.agg(F.max("cnt").alias("high"))
    ranked = Window.orderBy(F.desc("cnt"), "word")  # over a top list of at most 500 rows
    ratio = F.coalesce(F.try_divide(F.col("cnt") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    out = words.crossJoin(F.broadcast(low)).crossJoin(F.broadcast(high)).withColumn("rank", F.row_number().over(ranked))
    return out.select("word", "cnt", "rank", F.round(ratio, 6).alias("ratio"), text.rank_tier(F.col("rank")).alias("tier"))


def yearly_top(counts: DataFrame, top: int = 10) -> DataFrame:
    """Per year, the most frequent words with their rank."""
    order = Window.partitionBy("data_year").orderBy(F.desc("cnt"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
