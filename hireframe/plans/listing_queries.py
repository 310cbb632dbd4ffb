"""Queries on listings: search, statistics, salaries, places and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, salary, text
from ..operators import listings as L
from ..operators import quality as Q
from ..operators import search_index as I
from ..scratch import fresh_path
from . import views as V
from .catalogue import query

YEARS = (1995, 2001)
CLASS = "CASE WHEN salary_avg < 3000 THEN 0 WHEN salary_avg < 5000 THEN 1 WHEN salary_avg < 8000 THEN 2 WHEN salary_avg < 10000 THEN 3 WHEN salary_avg < 15000 THEN 4 WHEN salary_avg < 20000 THEN 5 WHEN salary_avg < 30000 THEN 6 WHEN salary_avg < 50000 THEN 7 ELSE 8 END"
LABELS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(salary.LABELS))
A1 = f"""{V.LISTINGS}, paid AS (SELECT data_year, {CLASS} AS bucket_no FROM job_listings WHERE data_year BETWEEN 1995 AND 2001 AND salary_avg > 0),
labels(bucket_no, bucket) AS (VALUES {LABELS}),
stats AS (SELECT y.data_year, l.bucket_no, l.bucket, count(p.data_year) AS cnt FROM (SELECT DISTINCT data_year FROM paid) y CROSS JOIN labels l
  LEFT JOIN paid p ON p.data_year = y.data_year AND p.bucket_no = l.bucket_no GROUP BY ALL)"""


@query("a1_salary_statistics", f"WITH {A1} SELECT * FROM stats")
def a1(spark, d):
    return L.salary_statistics(V.listings(spark, d), *YEARS)


@query("a1_salary_year_totals", f"WITH {A1} SELECT data_year, CAST(sum(cnt) AS BIGINT) AS total FROM stats GROUP BY ROLLUP (data_year)")
def a1_totals(spark, d):
    return L.yearly_totals(a1(spark, d))


@query("a20_salary_share", f"WITH {A1} SELECT *, round(100 * cnt / sum(cnt) OVER (PARTITION BY data_year), 2) AS percent FROM stats WHERE cnt > 0")
def a20(spark, d):
    return L.shares(a1(spark, d))


PLACES = f"""{V.LISTINGS}, {V.CITIES}, placed AS (SELECT DISTINCT location, trim(split_part(split_part(trim(location), '-', 1), '市', 1)) AS city FROM job_listings WHERE location <> ''),
provinces AS (SELECT location, city, coalesce((SELECT full_name FROM cities WHERE short_name = city), (SELECT arg_min(full_name, ord) FROM cities WHERE contains(location, short_name) OR contains(short_name, city) OR contains(city, short_name))) AS province FROM placed)"""


@query(
    "a2_location_statistics",
    f"""WITH {PLACES}, stats AS (SELECT data_year, coalesce(province, '未知') AS province, count(*) AS cnt FROM job_listings JOIN provinces USING (location) WHERE data_year BETWEEN 1995 AND 2001 GROUP BY ALL)
SELECT y.data_year, p.province, coalesce(cnt, 0) AS cnt FROM (SELECT DISTINCT data_year FROM stats) y CROSS JOIN (SELECT DISTINCT province FROM stats) p LEFT JOIN stats s ON s.data_year = y.data_year AND s.province = p.province""",
)
def a2(spark, d):
    return L.location_statistics(V.listings(spark, d), V.cities(spark, d), *YEARS)


@query(
    "j1_partial_match",
    f"""WITH {V.CITIES}, cut AS (SELECT DISTINCT 'X' || n_name AS location FROM nation UNION SELECT left(n_name, 5) || '市辖' FROM nation UNION SELECT '-' || n_name FROM nation UNION SELECT '火星'),
cit AS (SELECT location, trim(split_part(split_part(location, '-', 1), '市', 1)) AS city FROM cut)
SELECT location, coalesce((SELECT full_name FROM cities WHERE short_name = city), (SELECT arg_min(full_name, ord) FROM cities WHERE contains(location, short_name) OR contains(short_name, city) OR contains(city, short_name)), '未知') AS province FROM cit""",
)
def j1(spark, d):
    names = V.table(spark, d, "nation").select(F.explode(F.array(F.concat(F.lit("X"), "n_name"), F.concat(F.left("n_name", F.lit(5)), F.lit("市辖")), F.concat(F.lit("-"), "n_name"), F.lit("火星"))).alias("location"))
    return L.match_provinces(names, V.cities(spark, d)).select("location", "province")


@query(
    "j1_partial_customers",
    f"""WITH {V.CITIES}, cut AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'x' || c_name || n_name WHEN 1 THEN left(n_name, CAST(2 + c_custkey % 6 AS INT)) || '市-' || c_name WHEN 2 THEN c_mktsegment || c_custkey ELSE ' ' || n_name || '市 ' END AS location FROM customer JOIN nation ON c_nationkey = n_nationkey),
cit AS (SELECT location, trim(split_part(split_part(trim(location), '-', 1), '市', 1)) AS city FROM cut)
SELECT location, coalesce((SELECT full_name FROM cities WHERE short_name = city), (SELECT arg_min(full_name, ord) FROM cities WHERE contains(trim(location), short_name) OR contains(short_name, city) OR contains(city, short_name)), '未知') AS province FROM cit""",
)
def j1_customers(spark, d):
    homes = V.table(spark, d, "customer").join(F.broadcast(V.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('x', c_name, n_name) WHEN 1 THEN concat(left(n_name, CAST(2 + c_custkey % 6 AS INT)), '市-', c_name) WHEN 2 THEN concat(c_mktsegment, c_custkey) ELSE concat(' ', n_name, '市 ') END")
    return L.match_provinces(homes.select(place.alias("location")), V.cities(spark, d)).select("location", "province")


WORDS = f"""{V.HAN_TEXTS}, words AS (SELECT data_year, n, unnest(regexp_extract_all(requirements, '[一-龥]{{2,10}}')) AS word FROM han_texts),
counts AS (SELECT data_year, word, CAST(sum(n) AS BIGINT) AS cnt FROM words WHERE word NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)}) GROUP BY ALL),
tops AS (SELECT word, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts GROUP BY word ORDER BY cnt DESC, word LIMIT 100)"""


def _words(spark, d):
    texts, uses = V.han_texts(spark, d)
    return L.words_of(L.used_texts(texts, uses, "doc_id"))


@query("a3_wordcloud_top", f"WITH {WORDS} SELECT * FROM tops")
def a3_top(spark, d):
    return L.top_words(L.overall_counts(_words(spark, d)))


@query("a3_wordcloud_by_year", f"WITH {WORDS} SELECT * FROM counts WHERE word IN (SELECT word FROM tops)")
def a3_years(spark, d):
    return L.top_words_by_year(_words(spark, d))


@query("a3_wordcloud_totals", f"WITH {WORDS} SELECT CAST(sum(cnt) AS BIGINT) AS total_words, count(DISTINCT word) AS unique_words FROM counts")
def a3_totals(spark, d):
    return L.word_totals(L.overall_counts(_words(spark, d)))


@query("o3_yearly_top_words", f"WITH {WORDS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY data_year ORDER BY cnt DESC, word) AS INT) AS rank FROM counts) WHERE rank <= 10")
def o3(spark, d):
    return L.yearly_top(L.word_counts(_words(spark, d)))


@query(
    "w8_wordcloud_color_ratio",
    f"""WITH {WORDS}, r AS (SELECT *, CAST(row_number() OVER (ORDER BY cnt DESC, word) AS INT) AS rank, min(cnt) OVER () AS lo, max(cnt) OVER () AS hi FROM tops)
SELECT word, cnt, rank, round(coalesce((cnt - lo) / nullif(hi - lo, 0), 0), 6) AS ratio, CASE WHEN rank <= 10 THEN 'danger' WHEN rank <= 30 THEN 'warning' WHEN rank <= 50 THEN 'success' ELSE 'info' END AS tier FROM r""",
)
def w8(spark, d):
    return L.color_ratio(a3_top(spark, d))


@query("t9_han_runs", "SELECT doc_id, CAST(len(regexp_extract_all(translate(lower(text), '" + V.LATIN + "', '" + V.HAN + "'), '[一-龥]{2,10}')) AS INT) AS n_runs FROM documents")
def t9(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.size(text.han_runs(F.translate(F.lower("text"), V.LATIN, V.HAN))).alias("n_runs"))


@query("f1_filtered_listing_page", f"WITH {V.LISTINGS} SELECT * FROM job_listings WHERE job_title ILIKE '%high%' AND company_name ILIKE '%customer%' AND location ILIKE '%nation_1%' AND data_year = 1997 ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20")
def f1(spark, d):
    return L.listing_page(L.search(V.listings(spark, d), job_title="high", company_name="customer", location="nation_1", data_year=1997), 20, 20)


@query("f2_keyword_search", f"WITH {V.LISTINGS_TEXT} SELECT id, job_title, search_keyword FROM job_listings WHERE job_title ILIKE '%urgent%' OR company_name ILIKE '%urgent%' OR requirements ILIKE '%urgent%' OR search_keyword ILIKE '%urgent%'")
def f2(spark, d):
    return L.search(V.listings(spark, d, texts=True), search_keyword="urgent").select("id", "job_title", "search_keyword")


@query("a4_page_envelope", f"WITH {V.LISTINGS} SELECT count(*) AS total, 3 AS page, 20 AS size, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM job_listings WHERE data_year = 1998")
def a4(spark, d):
    return L.page_envelope(L.search(V.listings(spark, d), data_year=1998), 40, 20)


@query("f6_point_lookup", f"WITH {V.LISTINGS} SELECT * FROM job_listings WHERE id = 77 LIMIT 1")
def f6(spark, d):
    return V.listings(spark, d).where(F.col("id") == 77).limit(1)


@query("f7_row_cleaning", f"WITH sized AS (SELECT doc_id, length(text) AS n_chars FROM documents), {V.LISTINGS} SELECT id, n_chars FROM job_listings JOIN sized ON doc_id = id % (SELECT count(*) FROM documents) WHERE n_chars > 10")
def f7(spark, d):
    kept = V.listings(spark, d, texts=True).dropna(subset=["job_title", "company_name", "requirements"]).where(F.length("requirements") > 10)
    return kept.select("id", F.length("requirements").cast("long").alias("n_chars"))


@query("s4_keyset_page", f"WITH {V.LISTINGS} SELECT id, job_title FROM job_listings WHERE id > 500 OR id IN (3, 5) ORDER BY id LIMIT 500")
def s4(spark, d):
    from ..streaming.incremental import next_page

    return next_page(V.listings(spark, d), last=500, failed=[3, 5], limit=500).select("id", "job_title")


def _num(pattern: str, g: int = 1) -> str:
    return f"try_cast(nullif(regexp_extract(s, '^(?:{pattern})', {g}), '') AS DOUBLE)"


def _unit(pattern: str, g: int) -> str:
    return f"(CASE regexp_extract(s, '^(?:{pattern})', {g}) WHEN '万' THEN 10000.0 WHEN '千' THEN 1000.0 END)"


def _rules_sql(inner: str) -> tuple[str, str]:
    """The rules before and after the bonus rule, on a column s; written out for the oracle's dialect."""
    n = r"(\d+\.?\d*)"
    two = rf"{n}-{n}"
    e = r"([\d.]+)-([\d.]+)(万|千)"
    open_ = r"([\d.]+)(万|千)(?:以下|以上)/月"
    first = [
        f"CASE WHEN contains(s, '元/小时') THEN {_num(n + '元/小时')} * 174.0 END",
        f"CASE WHEN contains(s, '元/时') THEN ({_num(two + '元/时')} + {_num(two + '元/时', 2)}) / 2 * 174.0 END",
        f"CASE WHEN contains(s, '元/时') AND NOT regexp_matches(s, '{two}元/时') THEN {_num(n + '元/时')} * 174.0 END",
        f"CASE WHEN contains(s, '元/天') THEN {_num(n + '元/天')} * 21.75 END",
        rf"CASE WHEN regexp_matches(s, '\d+-\d+元/天') THEN ({_num(two + '元/天')} + {_num(two + '元/天', 2)}) / 2 * 21.75 END",
        f"CASE WHEN contains(s, '以上/月') THEN {_num(n + '(万|千)以上/月')} * {_unit(n + '(万|千)以上/月', 2)} END",
        f"CASE WHEN contains(s, '以上/年') THEN {_num(n + '(万|千)以上/年')} * {_unit(n + '(万|千)以上/年', 2)} / 12 END",
    ]
    later = [
        f"({_num(e + '/月')} + {_num(e + '/月', 2)}) * {_unit(e + '/月', 3)} / 2",
        rf"CASE WHEN regexp_matches(s, '\d+-\d+元/月') THEN ({_num('([0-9]+)-([0-9]+)元/月')} + {_num('([0-9]+)-([0-9]+)元/月', 2)}) / 2 END",
        rf"CASE WHEN regexp_matches(s, '\d+-\d+元') THEN ({_num('([0-9]+)-([0-9]+)元')} + {_num('([0-9]+)-([0-9]+)元', 2)}) / 2 END",
        rf"CASE WHEN regexp_matches(s, '\d+万') THEN {_num('([0-9]+)万')} * 10000 END",
        rf"CASE WHEN NOT regexp_matches(s, '\d+万') AND regexp_matches(s, '\d+元') THEN {_num('([0-9]+)元')} END",
        f"({_num(e + '/年')} + {_num(e + '/年', 2)}) * {_unit(e + '/年', 3)} / 12",
        f"({_num(e + '(?:[^/]|$)')} + {_num(e + '(?:[^/]|$)', 2)}) * {_unit(e + '(?:[^/]|$)', 3)} / 12",
        f"({_num('([0-9.]+)-([0-9.]+)K$')} + {_num('([0-9.]+)-([0-9.]+)K$', 2)}) / 2 * 1000",
        f"({_num('([0-9.]+)千-([0-9.]+)万$')} * 1000 + {_num('([0-9.]+)千-([0-9.]+)万$', 2)} * 10000) / 2",
        f"{_num(open_)} * {_unit(open_, 2)} * CASE WHEN contains(s, '以下') THEN 0.8 ELSE 1.2 END",
    ]
    return ", ".join(first), ", ".join(later)


_FIRST, _LATER = _rules_sql("s")
SALARY_SQL = f"""texts AS (SELECT DISTINCT salary_range FROM job_listings WHERE salary_range IS NOT NULL),
base AS (SELECT salary_range, CAST(round_even(coalesce({_FIRST}, {_LATER}), 0) AS INT) AS b FROM (SELECT salary_range, split_part(trim(salary_range), '·', 1) AS s FROM texts)),
parsed AS (SELECT t.salary_range, CASE WHEN s IN ('', 'nan', '面议') THEN NULL ELSE CAST(round_even(coalesce({_FIRST},
  CASE WHEN len(string_split(s, '·')) = 2 AND contains(split_part(s, '·', 2), '薪') THEN b * try_cast(nullif(regexp_extract(split_part(s, '·', 2), '^([0-9]+)薪', 1), '') AS DOUBLE) / 12 END, {_LATER}), 0) AS INT) END AS monthly
  FROM (SELECT salary_range, trim(salary_range) AS s FROM texts) t JOIN base ON base.salary_range = t.salary_range)"""


@query("x2_salary_parse", f"WITH {V.LISTINGS}, {SALARY_SQL} SELECT id, j.salary_range, CASE WHEN j.salary_range IS NOT NULL AND coalesce(salary_avg, 0) = 0 THEN coalesce(monthly, salary_avg) ELSE salary_avg END AS salary_avg, monthly FROM job_listings j LEFT JOIN parsed p ON p.salary_range = j.salary_range")
def x2(spark, d):
    return Q.fill_salary(V.listings(spark, d)).select("id", "salary_range", "salary_avg", "monthly")


@query("a7_unparsed_formats", f"WITH {V.LISTINGS}, {SALARY_SQL} SELECT j.salary_range AS format, count(*) AS cnt FROM job_listings j JOIN parsed p ON p.salary_range = j.salary_range WHERE coalesce(salary_avg, 0) = 0 AND monthly IS NULL GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 20")
def a7(spark, d):
    return Q.unparsed_formats(V.listings(spark, d))


@query("f8_needs_salary", f"WITH {V.LISTINGS} SELECT count(*) AS cnt FROM job_listings WHERE salary_range IS NOT NULL AND (salary_avg IS NULL OR salary_avg = 0)")
def f8(spark, d):
    return V.listings(spark, d).where(salary.needs_salary(F.col("salary_range"), F.col("salary_avg"))).agg(F.count("*").alias("cnt"))


@query("x3_city_name", f"WITH {V.LISTINGS} SELECT DISTINCT location, trim(split_part(split_part(trim(location), '-', 1), '市', 1)) AS city FROM job_listings")
def x3(spark, d):
    return V.listings(spark, d).select("location").distinct().withColumn("city", geo.city_name(F.col("location")))


PROVINCE_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in {**{m + "市": m for m in geo.MUNICIPALITIES}, **geo.PROVINCES}.items())
NAMES = ["北京市", '"湖北"', " 河北省 ", "内蒙古", "广西", "香港", "武汉市", "", "'上海市'", "云南", "新疆维吾尔自治区"]


@query(
    "x4_province_clean",
    f"""WITH known(a, b) AS (VALUES {PROVINCE_ROWS}), names AS (SELECT n_nationkey, ([{", ".join("'" + n.replace("'", "''") + "'" for n in NAMES)}])[n_nationkey % {len(NAMES)} + 1] AS full_name FROM nation),
s AS (SELECT *, trim(trim(trim(trim(trim(full_name), '"'), ''''), '"'), '''') AS t FROM names)
SELECT n_nationkey, full_name, CASE WHEN full_name = '' THEN '' ELSE coalesce(b, t) END AS cleaned, CASE WHEN full_name = '' THEN '' ELSE coalesce(b, t) END <> full_name AS changed FROM s LEFT JOIN known ON a = t""",
)
def x4(spark, d):
    names = F.array(*[F.lit(n) for n in NAMES])
    rows = V.table(spark, d, "nation").select("n_nationkey", F.element_at(names, F.col("n_nationkey") % len(NAMES) + 1).alias("full_name"))
    cleaned = Q.clean_cities(rows.withColumn("short_name", F.col("n_nationkey")))
    return cleaned.withColumnRenamed("short_name", "n_nationkey")


@query("a5_location_counts", f"WITH {V.LISTINGS} SELECT location, count(id) AS cnt FROM job_listings WHERE location <> '' GROUP BY location")
def a5(spark, d):
    return Q.location_counts(V.listings(spark, d))


def _half(spark, d):
    return V.cities(spark, d).where(F.col("ord") % 2 == 0)


COVER = f"""{V.LISTINGS}, {V.CITIES}, half AS (SELECT * FROM cities WHERE ord % 2 = 0), counts AS (SELECT location, trim(split_part(location, '-', 1)) AS city, count(*) AS cnt FROM job_listings GROUP BY ALL),
covered AS (SELECT location, city, cnt, coalesce((SELECT full_name FROM half WHERE short_name = city), (SELECT arg_min(full_name, ord) FROM half WHERE contains(location, short_name) OR contains(short_name, city) OR contains(city, short_name))) AS province FROM counts)"""


@query("a6_mapping_coverage", f"WITH {COVER} SELECT count(province) AS matched_locations, count(*) - count(province) AS unmatched_locations, CAST(sum(CASE WHEN province IS NOT NULL THEN cnt ELSE 0 END) AS BIGINT) AS matched_rows, CAST(sum(cnt) AS BIGINT) AS total_rows, round(100 * sum(CASE WHEN province IS NOT NULL THEN cnt ELSE 0 END) / sum(cnt), 2) AS matched_percent FROM covered")
def a6(spark, d):
    return Q.coverage_report(Q.coverage(V.listings(spark, d), _half(spark, d)))


@query("o5_unmatched_locations", f"WITH {COVER} SELECT location, city, cnt FROM covered WHERE province IS NULL")
def o5(spark, d):
    return Q.missing_cities(Q.coverage(V.listings(spark, d), _half(spark, d)))


def _searchable(spark, d):
    """Listings in files of some thousand rows, by company, with signatures."""
    path = fresh_path(spark, "searchable")
    rows = V.listings(spark, d).withColumn("requirements", F.concat_ws(" ", "job_title", "location"))
    I.save_searchable(rows, path, ["job_title", "company_name", "location", "requirements", "search_keyword"], ["company_name"], rows=2000)
    return path


@query("f2_indexed_search", f"WITH {V.LISTINGS} SELECT id, company_name, location FROM job_listings WHERE company_name ILIKE '%#00000012%' AND location ILIKE '%nation_1%'")
def f2_indexed(spark, d):
    return I.search_indexed(spark, _searchable(spark, d), company_name="#00000012", location="Nation_1").select("id", "company_name", "location")


@query("f2_indexed_keyword", f"WITH {V.LISTINGS} SELECT id, company_name FROM job_listings WHERE job_title ILIKE '%r#0000001_7%' OR company_name ILIKE '%r#0000001_7%' OR concat_ws(' ', job_title, location) ILIKE '%r#0000001_7%' OR search_keyword ILIKE '%r#0000001_7%'")
def f2_indexed_keyword(spark, d):
    return I.search_indexed(spark, _searchable(spark, d), search_keyword="R#0000001_7").select("id", "company_name")
