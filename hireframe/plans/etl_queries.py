"""Queries of the sheet ETL; documents are the crawl rows, their copies the repeated postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import etl as E
from . import views as V
from .catalogue import query

TITLE = "split_part(text, ' ', 1)"
# the second half before the first, so that no text holds it; the text with other white space, equal but for that
_HALF = {"spark": "CAST(length(text) DIV 2 AS INT)", "sql": "(length(text) // 2)"}
TURNED = {k: f"concat(substr(text, {h} + 1), ' ', left(text, {h}))" for k, h in _HALF.items()}
SECOND = {k: f"substr(text, {h} + 1)" for k, h in _HALF.items()}
SPACED = "replace(text, ' ', ' \n')"
SHEET_DUTY = {k: f"CASE WHEN (doc_id {div} 6) % 2 = 0 THEN {SPACED} ELSE {TURNED[k]} END" for k, div in (("spark", "DIV"), ("sql", "//"))}
CRAWL = "crawl AS (SELECT doc_id AS ord, CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN (doc_id // 6) || '.0' ELSE ' ' || (doc_id // 6) END AS jid, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END AS company, lang AS city, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS description, " + SHEET_DUTY["sql"] + " AS duty FROM documents)"
NID = "CASE WHEN regexp_matches(trim(coalesce(jid, '')), '^\\d+\\.0$') THEN left(trim(jid), length(trim(jid)) - 2) ELSE trim(coalesce(jid, '')) END"


def _crawl(spark, d):
    return V.table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"),
        F.expr("CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN concat(doc_id DIV 6, '.0') ELSE concat(' ', doc_id DIV 6) END").alias("jid"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END").alias("company"),
        F.col("lang").alias("city"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END").alias("description"),
        F.expr(SHEET_DUTY["spark"]).alias("duty"),
    )


SPACE_RE = r"[\s]+"
STRIP = r"regexp_replace({0}, '^[\s]+|[\s]+$', '', 'g')"


def _clean(c: str) -> str:
    """Brand cleaning for texts without brand strings: only blanks are squeezed."""
    return STRIP.format(rf"regexp_replace(regexp_replace(coalesce({c}, ''), '[ \t\r\f\x0B]{{2,}}', ' ', 'g'), '\n{{3,}}', '\n\n', 'g')".replace("\\t", "\t").replace("\\r", "\r").replace("\\f", "\f").replace("\\x0B", "\x0b").replace("\\n", "\n"))


KEY = "regexp_replace({0}, '[\\s]+', '', 'g')"
MERGED = f"""{CRAWL}, n AS (SELECT *, {NID} AS nid, {_clean("description")} AS cd, {_clean("duty")} AS cr FROM crawl),
g AS (SELECT nid, coalesce(arg_min(company, ord) FILTER (trim(company) <> ''), arg_min(company, ord)) AS company, coalesce(arg_min(city, ord) FILTER (trim(city) <> ''), arg_min(city, ord)) AS city,
  coalesce(arg_max(cd, (length(cd), -ord)) FILTER (cd <> ''), '') AS d, coalesce(arg_max(cr, (length(cr), -ord)) FILTER (cr <> ''), '') AS r FROM n WHERE nid <> '' GROUP BY nid),
k AS (SELECT *, {KEY.format("d")} AS nd, {KEY.format("r")} AS nr FROM g)"""


@query(
    "a11_dedupe_merge",
    f"""WITH {MERGED} SELECT nid AS jid, company, city, CASE WHEN d = '' THEN r WHEN r = '' THEN d WHEN contains(nd, nr) OR contains(nr, nd) THEN CASE WHEN length(d) >= length(r) THEN d ELSE r END ELSE d END AS description,
 CASE WHEN d = '' OR r = '' OR contains(nd, nr) OR contains(nr, nd) THEN '' ELSE r END AS duty FROM k""",
)
def a11(spark, d):
    return E.merge_by_id(_crawl(spark, d), "jid", "ord", "description", "duty")


@query("a12_keep_first", "SELECT arg_min(doc_id, doc_id) AS doc_id, text FROM documents GROUP BY text")
def a12(spark, d):
    return E.keep_first(V.table(spark, d, "documents").select("doc_id", "text"), ["text"], [F.col("doc_id")])


@query(
    "u2_append_sheet",
    f"WITH {CRAWL}, s AS (SELECT *, CASE WHEN city = 'en' THEN 0 ELSE 1 END AS src, {NID} AS nid FROM crawl), r AS (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY src, ord) AS rn FROM s WHERE nid <> '') SELECT ord, jid, company, city FROM r WHERE rn = 1",
)
def u2(spark, d):
    rows = _crawl(spark, d).select("ord", "jid", "company", "city")
    return E.append_sheet(rows.where("city = 'en'"), rows.where("city <> 'en'"), "jid", "ord")


@query("u1_union_sheets", "SELECT doc_id, lang, NULL AS source FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, NULL, source FROM documents WHERE lang = 'de'")
def u1(spark, d):
    docs = V.table(spark, d, "documents")
    return E.union_sheets([docs.where("lang = 'fr'").select("doc_id", "lang"), docs.where("lang = 'de'").select("doc_id", "source")])


@query("a13_longest_text", f"SELECT source, coalesce(arg_max(c, (length(c), -doc_id)) FILTER (c <> ''), '') AS best FROM (SELECT doc_id, source, {_clean('text')} AS c FROM documents) GROUP BY source")
def a13(spark, d):
    return V.table(spark, d, "documents").groupBy("source").agg(E.longest_text("text", "doc_id").alias("best"))


@query("a14_dedupe_meta", f"WITH {CRAWL}, n AS (SELECT {NID} AS nid FROM crawl) SELECT count(*) AS input_rows, count(*) FILTER (nid = '') AS dropped_empty_id, count(DISTINCT nid) FILTER (nid <> '') AS output_rows, count(*) - count(*) FILTER (nid = '') - count(DISTINCT nid) FILTER (nid <> '') AS duplicates FROM n")
def a14(spark, d):
    return E.merge_metrics(_crawl(spark, d), "jid")


@query(
    "a15_page_duplicate_ratio",
    """WITH r AS (SELECT o_custkey % 20 AS grp, o_orderkey // 200 AS page, o_custkey AS jid FROM orders), f AS (SELECT *, min(page) OVER (PARTITION BY grp, jid) AS fp FROM r)
SELECT grp, page, count(*) AS jobs, CAST(sum(CASE WHEN fp < page THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, round(sum(CASE WHEN fp < page THEN 1 ELSE 0 END) / count(*), 4) AS ratio, sum(CASE WHEN fp < page THEN 1 ELSE 0 END) / count(*) > 0.8 AS skipped FROM f GROUP BY grp, page""",
)
def a15(spark, d):
    rows = V.table(spark, d, "orders").select(F.expr("o_custkey % 20").alias("grp"), F.expr("o_orderkey DIV 200").alias("page"), F.col("o_custkey").alias("jid"))
    return E.page_duplicates(rows, "grp", "page", "jid")


_BRANDS = "CASE doc_id % 6 WHEN 0 THEN '【BOSS直聘】招聘 ' WHEN 1 THEN 'boss直聘  上直聘 ' WHEN 2 THEN 'xBOSSx BOSS ok，直聘。' WHEN 3 THEN '下载 boss ' WHEN 4 THEN 'see https://m.kanzhun.com/a?b=1 and KANZHUN here  ' ELSE 'www.kanzhun.com/x\n\n\n\n' END"
# brand strings before, in the middle of and after the whole text
BRANDINGS = {k: f"concat({_BRANDS}, left(text, {h}), '\n', {_BRANDS}, '\n', substr(text, {h} + 1), '\n', {_BRANDS})" for k, h in _HALF.items()}
BRANDED = BRANDINGS["sql"]
_T1 = BRANDED
for _s in text.BRAND_STRINGS:
    _T1 = f"replace({_T1}, '{_s}', '')"
_T1 = rf"regexp_replace({_T1}, '(?i)上直聘|用直聘|下载\s*BOSS|打开\s*BOSS直聘', '', 'g')"
# RE2 has no look-around: the letters around are captured and put back
_T1 = rf"regexp_replace({_T1}, '(?i)(^|[^A-Za-z])BOSS($|[^A-Za-z])', '\1\2', 'g')"
_T1 = rf"regexp_replace({_T1}, '(^|[\s，,。.；;：:])直聘($|[\s，,。.；;：:])', '\1\2', 'g')"
_UNDOMAIN = r"regexp_replace(regexp_replace({0}, '(?i)https?://[^\s)\]\"'']*kanzhun[^\s)\]\"'']*', '', 'g'), '(?i)[a-z0-9.-]*kanzhun[a-z0-9./?#&=%-]*', '', 'g')"
_T2 = rf"regexp_replace(regexp_replace({BRANDED}, '(?i)https?://[^\s)\]\"'']*kanzhun[^\s)\]\"'']*', '', 'g'), '(?i)[a-z0-9.-]*kanzhun[a-z0-9./?#&=%-]*', '', 'g')"


@query("t1_brand_noise", f"SELECT doc_id, {_clean(_T1)} AS cleaned FROM documents")
def t1(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.strip_brand_noise(F.expr(BRANDINGS["spark"])).alias("cleaned"))


@query("t2_domain_noise", f"SELECT doc_id, {_clean(_T2)} AS cleaned FROM documents")
def t2(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.strip_domain_noise(F.expr(BRANDINGS["spark"])).alias("cleaned"))


PAIR_DUTY = {k: f"CASE doc_id % 3 WHEN 0 THEN {SECOND[k]} WHEN 1 THEN {SPACED} ELSE {TURNED[k]} END" for k in _HALF}
PAIR = f"""p AS (SELECT doc_id, {_clean("text")} AS d, {_clean(PAIR_DUTY["sql"])} AS r FROM documents),
k AS (SELECT *, {KEY.format("d")} AS nd, {KEY.format("r")} AS nr FROM p)"""


@query(
    "t4_merge_pair",
    f"WITH {PAIR} SELECT doc_id, CASE WHEN d = '' THEN r WHEN r = '' THEN d WHEN contains(nd, nr) OR contains(nr, nd) THEN CASE WHEN length(d) >= length(r) THEN d ELSE r END ELSE d END AS description, CASE WHEN d = '' OR r = '' OR contains(nd, nr) OR contains(nr, nd) THEN '' ELSE r END AS duty FROM k",
)
def t4(spark, d):
    both = text.merge_description_duty(F.col("text"), F.expr(PAIR_DUTY["spark"]))
    return V.table(spark, d, "documents").select("doc_id", both.alias("b")).select("doc_id", "b.*")


THIRD = {k: f"CASE WHEN doc_id % 2 = 0 THEN {SPACED} ELSE {TURNED[k]} END" for k in _HALF}
BLOCKS = f"[{_clean(_UNDOMAIN.format('text'))}, {_clean(_UNDOMAIN.format(SECOND['sql']))}, {_clean(_UNDOMAIN.format(THIRD['sql']))}]"


@query(
    "t5_merge_blocks",
    f"""WITH b AS (SELECT doc_id, unnest({BLOCKS}) AS b, generate_subscripts({BLOCKS}, 1) AS i FROM documents), n AS (SELECT *, {KEY.format("b")} AS n FROM b),
k AS (SELECT * FROM n x WHERE n <> '' AND NOT EXISTS (SELECT 1 FROM n y WHERE y.doc_id = x.doc_id AND y.n <> x.n AND contains(y.n, x.n))),
f AS (SELECT * FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.doc_id = x.doc_id AND y.n = x.n AND y.i < x.i))
SELECT doc_id, coalesce(string_agg(b, '\n\n' ORDER BY i) , '') AS merged FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
)
def t5(spark, d):
    merged = text.merge_blocks(F.col("text"), F.expr(SECOND["spark"]), F.expr(THIRD["spark"]))
    return V.table(spark, d, "documents").select("doc_id", merged.alias("merged"))


@query("t3_comparison_key", f"SELECT doc_id, {KEY.format('text')} AS k FROM documents")
def t3(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.comparison_key(F.col("text")).alias("k"))


STYLED = {k: f"concat('.a-b {{color:red}} ', left(text, {h}), '\n.c{{}}', substr(text, {h} + 1), '\n.d{{x}}')" for k, h in _HALF.items()}


@query("t8_css_strip", rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({STYLED['sql']}, '\.[a-zA-Z0-9_-]+\s*\{{[^}}]*\}}', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents")
def t8(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.strip_css_rules(F.expr(STYLED["spark"])).alias("cleaned"))


MORE = {k: f"CASE WHEN doc_id % 2 = 0 THEN {SECOND[k]} ELSE {TURNED[k]} END" for k in _HALF}


@query("t11_append_unless_contained", f"SELECT doc_id, CASE WHEN contains(text, s) THEN text ELSE text || chr(10) || s END AS merged FROM (SELECT doc_id, text, {STRIP.format(MORE['sql'])} AS s FROM documents)")
def t11(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.append_unless_contained(F.col("text"), F.expr(MORE["spark"])).alias("merged"))


@query(
    "f15_import_projection",
    f"""WITH {CRAWL} SELECT coalesce(nullif(trim(city), ''), '未知') AS job_title, coalesce(nullif(trim(company), ''), '未知') AS company_name, nullif(trim(coalesce(jid, '')), '') AS salary_range, CAST(NULL AS INT) AS salary_avg, CASE WHEN ord % 9 = 0 THEN NULL ELSE city END AS location, 1 AS openings,
nullif({STRIP.format("description")}, '') AS requirements, city AS search_keyword, CAST(2020 + ord % 7 AS INT) AS data_year, TIMESTAMP '2024-01-02 03:04:05' AS created_at FROM crawl""",
)
def f15(spark, d):
    rows = _crawl(spark, d)
    sheet = rows.select(
        F.col("city").alias("岗位名称"), F.col("company").alias("公司名称"), F.col("jid").alias("薪资范围"), F.expr("CASE WHEN ord % 9 = 0 THEN 'NaN' ELSE city END").alias("城市"),
        F.col("description").alias("职位描述"), F.col("city").alias("搜索关键词"), F.concat((2020 + F.col("ord") % 7).cast("string"), F.lit(".0")).alias("数据年份"),
    )
    return E.import_projection(sheet, F.expr("timestamp_ntz '2024-01-02 03:04:05'"))


@query("f9_empty_ids", f"WITH {CRAWL} SELECT ord, {NID} AS nid FROM crawl WHERE {NID} <> ''")
def f9(spark, d):
    return E.drop_empty_ids(_crawl(spark, d), "jid", "nid").select("ord", "nid")


@query("f16_id_alias", "SELECT o_orderkey AS \"职位ID\", o_orderstatus FROM orders")
def f16(spark, d):
    return E.with_id_column(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("jobId"), "o_orderstatus"))


@query("x7_work_location", "SELECT o_orderkey, CASE WHEN a <> '' AND b <> '' THEN concat_ws('-', c, a, b) WHEN a <> '' THEN c || '-' || a WHEN c <> '' THEN c ELSE '全国' END AS place FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS c, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS b FROM orders)")
def x7(spark, d):
    rows = V.table(spark, d, "orders")
    parts = [F.expr("CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END")]
    return rows.select("o_orderkey", text.work_location(*parts).alias("place"))


@query("x8_surrogate_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN o_orderstatus || '_' || o_orderpriority || '_' ELSE 'job_' || o_orderkey END AS jid FROM orders")
def x8(spark, d):
    rows = V.table(spark, d, "orders")
    third = lambda k, c: F.expr(f"CASE WHEN o_orderkey % 3 = {k} THEN {c} END")
    jid = text.surrogate_id(third(0, "CAST(o_custkey AS STRING)"), third(1, "o_orderstatus"), third(1, "o_orderpriority"), F.lit(None).cast("string"), F.col("o_orderkey"))
    return rows.select("o_orderkey", jid.alias("jid"))


@query("x6_first_nonblank", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE '' END AS v FROM documents")
def x6(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.first_nonblank(F.expr("CASE WHEN doc_id % 3 = 0 THEN lang ELSE ' ' END"), F.expr("CASE WHEN doc_id % 3 = 1 THEN concat(' ', source) END")).alias("v"))


@query("x11_year_fallback", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 1 THEN 2001 WHEN o_orderkey % 4 = 3 THEN NULL ELSE year(o_orderdate) END AS INT) AS y FROM orders")
def x11(spark, d):
    year = F.expr("CASE WHEN o_orderkey % 4 = 1 THEN 2001 WHEN o_orderkey % 4 = 2 THEN 0 END")
    created = F.expr("CASE WHEN o_orderkey % 4 = 3 THEN 'soon' ELSE CAST(o_orderdate AS STRING) END")
    return V.table(spark, d, "orders").select("o_orderkey", text.year_or_date(year, created).alias("y"))


@query("x12_requirements_text", "SELECT doc_id, lang || ' ' || source AS t FROM documents")
def x12(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.list_text(F.expr("concat('[\\'', ', \\'', lang, '\\', \\'', source, '\\']')")).alias("t")).withColumn("t", F.expr("t"))


@query("x13_supplement_header", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '公司名称：' || o_orderstatus || chr(10) ELSE '' END || '职位名称：' || o_orderpriority || chr(10) || '年份：' || year(o_orderdate) || chr(10) || chr(10) || 'body' AS t FROM orders")
def x13(spark, d):
    head = text.supplement_header(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END"), F.lit(""), F.col("o_orderpriority"), F.year("o_orderdate"), F.lit("body"))
    return V.table(spark, d, "orders").select("o_orderkey", head.alias("t"))


@query(
    "x14_batch_prompt",
    "SELECT batch, string_agg('=== 职位 ' || lang || ' (公司: ' || source || ') ===' || chr(10) || chr(10) || text || chr(10) || chr(10) || chr(10), chr(10) ORDER BY doc_id) AS prompt FROM (SELECT *, doc_id // 10 AS batch FROM documents) GROUP BY batch",
)
def x14(spark, d):
    rows = V.table(spark, d, "documents").withColumn("batch", F.expr("doc_id DIV 10"))
    piece = text.batch_piece(F.col("lang"), F.col("source"), F.lit(None).cast("int"), F.col("text"))
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("doc_id", piece.alias("p")))).alias("ps"))
    return grouped.select("batch", F.array_join("ps.p", "\n").alias("prompt"))


@query("x15_hash_ids", "SELECT n_nationkey, 'Location_' || left(md5(n_name), 6) AS id, left(sha256(n_name), 16) AS print FROM nation")
def x15(spark, d):
    return V.table(spark, d, "nation").select("n_nationkey", text.hashed_id("Location", F.col("n_name")).alias("id"), text.fingerprint(F.col("n_name")).alias("print"))


@query("x28_url", "SELECT n_nationkey, 'https://www.zhipin.com/web/geek/jobs?query=' || replace(n_name, '_', '%20') || '%2F%E6%95%B0&city=100010000' AS url FROM nation")
def x28(spark, d):
    return V.table(spark, d, "nation").select("n_nationkey", text.search_url(F.concat(F.replace("n_name", F.lit("_"), F.lit(" ")), F.lit("/数"))).alias("url"))


@query("x29_id_from_url", "SELECT n_nationkey, n_name AS jid FROM nation")
def x29(spark, d):
    return V.table(spark, d, "nation").select("n_nationkey", text.id_from_url(F.concat(F.lit("https://x/job_detail/"), "n_name", F.lit(".html?a=1"))).alias("jid"))


@query("x39_comma_list", "SELECT n_nationkey, n_name || '|x' AS items FROM nation")
def x39(spark, d):
    return V.table(spark, d, "nation").select("n_nationkey", F.array_join(text.comma_list(F.concat("n_name", F.lit(" ,, x ,"))), "|").alias("items"))


@query("s12_page_sections", "SELECT doc_id, trim(source) AS duty, trim(lang) AS requirement FROM documents")
def s12(spark, d):
    said = F.concat(F.lit("岗位职责：\n"), "source", F.lit("\n任职要求: "), "lang", F.lit("\n工作地址：x"))
    return V.table(spark, d, "documents").select("doc_id", text.page_sections(said).alias("s")).select("doc_id", "s.*")


@query("u5_map_union", "SELECT o_orderkey, '1' AS a, o_orderstatus AS b, '3' AS c FROM orders")
def u5(spark, d):
    m = text.merged_maps(F.expr("map('a', '1', 'b', '2')"), F.create_map(F.lit("b"), "o_orderstatus", F.lit("c"), F.lit("3")))
    return V.table(spark, d, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", *[F.col("m")[k].alias(k) for k in "abc"])


@query("x36_stamp", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def x36(spark, d):
    return V.table(spark, d, "events").select("event_id", text.stamp(F.col("ts")).alias("at"))


@query("x42_page_offset", "SELECT n_nationkey, (greatest(n_nationkey, 1) - 1) * 20 AS skip FROM nation")
def x42(spark, d):
    return V.table(spark, d, "nation").select("n_nationkey", text.page_offset(F.col("n_nationkey"), 20).alias("skip"))


@query("x9_clipped", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE left(trim(source), 4) END AS v FROM documents")
def x9(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.clipped(F.expr("CASE WHEN doc_id % 3 = 0 THEN ' NaN ' ELSE concat(' ', source) END"), 4).alias("v"))


@query("f10_missing_columns", "SELECT 'x' AS missing UNION ALL SELECT 'y'")
def f10(spark, d):
    from .. import schema

    names = schema.missing_columns(V.table(spark, d, "nation"), ["x", "n_name", "y"])
    return spark.createDataFrame([(n,) for n in names], "missing string")


@query("k5_added_column", "SELECT n_nationkey, n_name, CAST(NULL AS INT) AS salary_avg FROM nation")
def k5(spark, d):
    from .. import schema

    rows = V.table(spark, d, "nation").select("n_nationkey", "n_name")
    return schema.add_column_if_absent(schema.add_column_if_absent(rows, "salary_avg", "int"), "n_name", "int")


@query("o8_users_page", "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY id LIMIT 10 OFFSET 5")
def o8(spark, d):
    from ..operators.listings import page

    return page(V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), [F.col("id")], 5, 10)


@query("o10_distinct_keys", "SELECT DISTINCT year(o_orderdate) AS y FROM orders")
def o10(spark, d):
    return V.table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().orderBy("y")
