"""Queries of accounts, workbooks, keyed updates, batches of extractions and stored conversation state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema
from ..functions import dialogue as D
from ..operators import accounts as A
from ..operators import extraction as X
from ..operators import graph as G
from ..operators import keyed as E
from ..operators import quality as Q
from ..scratch import fresh_path, written
from ..sources import readers as R
from ..streaming import incremental as S
from ..streaming import stateful as M
from . import views as V
from .catalogue import query
from .listing_queries import NAMES, PROVINCE_ROWS, SALARY_SQL
from .source_queries import BUILT

NOW, SECRET = 1_700_000_000, "a secret of the tests"


def _users(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_custkey", F.lit("@x.org")).alias("email"), F.col("c_name").alias("name"), F.lit("hash").alias("hashed_password"))


@query("f17_public_users", "SELECT c_custkey AS id, c_custkey || '@x.org' AS email, c_name AS name FROM customer")
def f17(spark, d):
    return A.public_users(_users(spark, d))


@query("x40_passwords", "SELECT n_nationkey, true AS fits, false AS wrong, false AS empty, true AS cut FROM nation")
def x40(spark, d):
    rows = V.table(spark, d, "nation").select("n_nationkey", F.repeat("n_name", F.lit(20)).alias("word"))
    rows = written(rows.withColumn("stored", A.hashed_password("word")), "hashes")
    beyond = F.concat(F.substring("word", 1, A.MAX_BYTES), F.lit("anything"))
    return rows.select("n_nationkey", A.verified("word", "stored").alias("fits"), A.verified(F.reverse(F.concat(F.lit("x"), "word")), "stored").alias("wrong"), A.verified(F.lit(""), "stored").alias("empty"), A.verified(beyond, "stored").alias("cut"))


@query("x40_tokens", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS subject, CAST(NULL AS VARCHAR) AS forged FROM customer")
def x40_tokens(spark, d):
    rows = V.table(spark, d, "customer").withColumn("token", A.access_token(F.col("c_name"), SECRET, F.expr(f"CASE WHEN c_custkey % 3 = 0 THEN {NOW - 1} ELSE {NOW + 60} END")))
    return rows.select("c_custkey", A.token_subject(F.col("token"), SECRET, F.lit(NOW)).alias("subject"), A.token_subject(F.col("token"), SECRET + "!", F.lit(NOW)).alias("forged"))


@query("x34_driver_url", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 3 THEN 'mysql://' ELSE 'postgresql+psycopg://' END || n_name AS url FROM nation")
def x34(spark, d):
    given = F.expr("concat(CASE n_nationkey % 4 WHEN 0 THEN ' postgres://' WHEN 1 THEN 'postgresql://' WHEN 2 THEN 'postgresql+psycopg://' ELSE 'mysql://' END, n_name)")
    return V.table(spark, d, "nation").select("n_nationkey", A.driver_url(given).alias("url"))


def _stored_listings(spark, d):
    path = fresh_path(spark, "stored-listings")
    E.save_bucketed(V.listings(spark, d).select("id", "salary_range", "salary_avg"), path, "id")
    return path


def _files(spark, path):
    return sorted(spark.read.parquet(path).inputFiles())


FILLED = "CASE WHEN j.salary_range IS NOT NULL AND coalesce(salary_avg, 0) = 0 THEN coalesce(monthly, salary_avg) ELSE salary_avg END"


@query("k4_salary_update", f"WITH {V.LISTINGS}, {SALARY_SQL} SELECT id, j.salary_range, {FILLED} AS salary_avg FROM job_listings j LEFT JOIN parsed p ON p.salary_range = j.salary_range")
def k4(spark, d):
    path = _stored_listings(spark, d)
    changes = Q.fill_salary(E.read_bucketed(spark, path)).where("monthly IS NOT NULL").select("id", "salary_avg")
    E.update_bucketed(spark, path, changes, "id")
    return E.read_bucketed(spark, path)


@query("k6_dry_run", f"WITH {V.LISTINGS}, {SALARY_SQL} SELECT id FROM (SELECT id, salary_avg AS old, {FILLED} AS new FROM job_listings j LEFT JOIN parsed p ON p.salary_range = j.salary_range) WHERE new IS NOT NULL AND old IS DISTINCT FROM new")
def k6(spark, d):
    """The keys that an update would change; the stored table has no new file."""
    path = _stored_listings(spark, d)
    before = _files(spark, path)
    changes = Q.fill_salary(E.read_bucketed(spark, path)).where("monthly IS NOT NULL").select("id", "salary_avg")
    changed = E.update_bucketed(spark, path, changes, "id", dry_run=True)
    if _files(spark, path) != before:
        raise RuntimeError("a dry run has written")
    return changed.select("id")


def _stored_cities(spark, d):
    """A dimension with a place for each customer, named in all the ways that are cleaned."""
    path = fresh_path(spark, "stored-cities")
    names = F.array(*[F.lit(n) for n in NAMES])
    rows = V.table(spark, d, "customer").select(F.col("c_name").alias("short_name"), F.element_at(names, (F.col("c_custkey") % len(NAMES) + 1).cast("int")).alias("full_name"))
    E.save_bucketed(rows, path, "short_name")
    return path


CLEANED = f"""WITH known(a, b) AS (VALUES {PROVINCE_ROWS}), names AS (SELECT c_name AS short_name, ([{", ".join("'" + n.replace("'", "''") + "'" for n in NAMES)}])[c_custkey % {len(NAMES)} + 1] AS full_name FROM customer),
s AS (SELECT *, trim(trim(trim(trim(trim(full_name), '"'), ''''), '"'), '''') AS t FROM names), c AS (SELECT short_name, full_name, CASE WHEN full_name = '' THEN '' ELSE coalesce(b, t) END AS cleaned FROM s LEFT JOIN known ON a = t)"""


@query("k6_city_dry_run", f"{CLEANED} SELECT short_name, full_name AS old_full_name, cleaned AS new_full_name FROM c WHERE full_name <> cleaned")
def k6_cities(spark, d):
    path = _stored_cities(spark, d)
    before = _files(spark, path)
    changed = E.clean_dimension(spark, path)
    if _files(spark, path) != before:
        raise RuntimeError("a dry run has written")
    return changed


@query("k6_city_update", f"{CLEANED} SELECT short_name, cleaned AS full_name FROM c")
def k6_city_update(spark, d):
    path = _stored_cities(spark, d)
    E.clean_dimension(spark, path, dry_run=False)
    return E.read_bucketed(spark, path)


@query("k14_created_tables", "SELECT n_name AS short_name, r_name AS full_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'Customer ' || c_custkey, c_mktsegment FROM customer")
def k14(spark, d):
    """Tables are created once; a second run leaves them and their rows alone."""
    database = "k14_" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE {database} LOCATION '{fresh_path(spark, database)}'")
    for _ in range(2):
        schema.create_tables(spark, ["city_mapping"], database)
        if spark.table(f"{database}.city_mapping").isEmpty():
            more = V.table(spark, d, "customer").select(F.concat(F.lit("Customer "), "c_custkey").alias("short_name"), F.col("c_mktsegment").alias("full_name"))
            V.cities(spark, d).select("short_name", "full_name").unionByName(more).write.insertInto(f"{database}.city_mapping")
    return spark.table(f"{database}.city_mapping")


@query(
    "o4_unparsed_report",
    f"""WITH {V.LISTINGS}, {SALARY_SQL}, f AS (SELECT j.salary_range AS format, count(*) AS cnt FROM job_listings j JOIN parsed p ON p.salary_range = j.salary_range WHERE coalesce(salary_avg, 0) = 0 AND monthly IS NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, format) AS n FROM f) SELECT format, cnt, CAST(1 AS BIGINT) AS formats FROM r WHERE n <= 5 UNION ALL SELECT 'others', CAST(coalesce(sum(cnt) FILTER (n > 5), 0) AS BIGINT), count(*) FILTER (n > 5) FROM r""",
)
def o4(spark, d):
    return Q.unparsed_report(V.listings(spark, d), 5)


def _workbooks(spark, d):
    """Folders of workbooks, as many as it takes that no sheet is over the format's rows: one up to twice that number of customers."""
    folder = fresh_path(spark, "workbooks")
    rows = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("职位ID"), "c_name", "c_mktsegment")
    key = F.col("职位ID").cast("long")
    most = rows.groupBy(key % 2).count().agg(F.max("count")).first()[0] or 0
    parts = 1 if most <= R.SHEET_ROWS else -(-most * 11 // (10 * R.SHEET_ROWS))  # a tenth more, as the hash deals unevenly
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64("职位ID"), F.lit(parts)) == part)
        for k, name in enumerate(["B.xlsx", "a.xlsx", "~$a.xlsx", "ict_jobs_deduped_1.xlsx"]):
            if R.write_xlsx(some.where(key % 2 == k % 2), f"{folder}/{part}/{name}") != "xlsx":
                raise RuntimeError("a part beyond a sheet's rows")
    return f"{folder}/*"


@query("s6_workbooks", 'SELECT CAST(c_custkey AS VARCHAR) AS "职位ID", c_name, c_mktsegment FROM customer')
def s6(spark, d):
    return R.read_xlsx(spark, _workbooks(spark, d)).select("职位ID", "c_name", "c_mktsegment")


@query("s7_sheet_files", "SELECT * FROM (VALUES (1, 'a.xlsx'), (2, 'B.xlsx')) t(place, name)")
def s7(spark, d):
    names = [r["name"] for r in R.sheet_files(spark, _workbooks(spark, d)).select("name", "ord").distinct().orderBy("ord").collect()]
    return spark.createDataFrame(list(enumerate(names, 1)), "place int, name string")


@query("s8_source_kinds", "SELECT kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders, (VALUES ('csv'), ('parquet'), ('orc')) k(kind) GROUP BY kind")
def s8(spark, d):
    orders, parts = V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), []
    for kind in ("csv", "parquet", "orc"):
        path = fresh_path(spark, f"listings-{kind}")
        (orders.write.option("header", True) if kind == "csv" else orders.write).format(kind).save(path)
        read = R.load_listings(spark, kind, path=path)
        parts.append(read.agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("keys")).select(F.lit(kind).alias("kind"), "n", "keys"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k2_csv_fallback", "SELECT c_custkey, c_name FROM customer")
def k2(spark, d):
    """More rows than the workbook may hold: written as csv with a byte order mark."""
    path = fresh_path(spark, "book.xlsx")
    if R.write_xlsx(V.table(spark, d, "customer").select("c_custkey", "c_name"), path, most=10) != "csv":
        raise RuntimeError("a workbook beyond its limit")
    return R.read_csv(spark, path + ".csv", "c_custkey long, c_name string")


@query("s17_clicked_cards", "WITH c AS (SELECT o_orderpriority AS keyword, CAST(1 + o_orderkey // 4 % 12 AS INT) AS page, o_custkey AS jid, o_orderkey FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY keyword, page ORDER BY o_orderkey) AS pos FROM c WHERE NOT (keyword LIKE '1%' AND page = 4)), q AS (SELECT * FROM p WHERE pos <= 15 AND page <= 10 AND NOT (keyword LIKE '1%' AND page > 4)) SELECT keyword, page, pos, jid FROM (SELECT *, row_number() OVER (PARTITION BY jid ORDER BY keyword, page, pos) AS n FROM q) WHERE n = 1")
def s17(spark, d):
    from pyspark.sql import Window

    cards = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("keyword"), F.expr("CAST(1 + o_orderkey DIV 4 % 12 AS INT)").alias("page"), F.col("o_custkey").alias("jid"), "o_orderkey")
    cards = cards.where("NOT (keyword LIKE '1%' AND page = 4)").withColumn("pos", F.row_number().over(Window.partitionBy("keyword", "page").orderBy("o_orderkey")).cast("long"))
    return S.clicked_cards(cards).select("keyword", "page", "pos", "jid")


def _extracted(spark, d):
    """Extractions with batch and hash of the text; the texts themselves are not written again."""
    docs = X.documents(V.listings(spark, d, texts=True))
    return written(X.extract(X.with_batches(docs).withColumn("doc_hash", X.content_hash()).drop("page_content")), "extracted")


@query("j16_batch_graphs", f"WITH {BUILT} SELECT id, id // 10 AS batch, CAST(count(*) OVER (PARTITION BY id // 10) * 4 AS INT) AS nodes, CAST(count(*) OVER (PARTITION BY id // 10) * 3 AS INT) AS relationships FROM used")
def j16(spark, d):
    return X.batch_graphs(_extracted(spark, d).drop("doc_hash")).select("id", "batch", F.size("graph.nodes").alias("nodes"), F.size("graph.relationships").alias("relationships"))


@query("g9_single_extraction", f"WITH {BUILT} SELECT id, 'job_' || id AS job, 'company_' || company_name AS company, true AS success FROM used")
def g9(spark, d):
    out = X.extract_each(X.documents(V.listings(spark, d, texts=True)))
    return out.select("id", F.col("graph.nodes")[0]["id"].alias("job"), F.col("graph.nodes")[1]["id"].alias("company"), "success")


@query("k10_cache_write", f"WITH {BUILT} SELECT true AS hit, count(*) AS n FROM used")
def k10(spark, d):
    extracted = _extracted(spark, d)
    cache = written(X.cache_rows(extracted), "cache")
    hits, misses = X.split_cached(extracted.drop("graph", "success", "error_msg"), cache)
    return hits.where("size(graph.nodes) = 4").select(F.lit(True).alias("hit")).unionByName(misses.select(F.lit(False).alias("hit"))).groupBy("hit").agg(F.count("*").alias("n"))


@query("g2_parsed_answers", "SELECT o_orderkey, 'p' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders WHERE o_orderkey % 3 <> 2")
def g2(spark, d):
    """Answers whose JSON is cut or has stray commas are mended; what is no JSON gives nothing; unknown labels go."""
    body = F.expr("""concat('{"nodes":[{"id":"p', o_orderkey, '","type":"JobPosting","properties":{}},{"id":"c', o_custkey, '","type":"Company","properties":{}},{"id":"z","type":"Other","properties":{}}],"relationships":[{"source":"z","target":"c', o_custkey, '","type":"OFFERED_BY","properties":{}},{"source":"p', o_orderkey, '","target":"c', o_custkey, '","type":"OFFERED_BY","properties":{}')""")
    answer = F.when(F.col("o_orderkey") % 3 == 0, F.concat(body, F.lit("}]}"))).when(F.col("o_orderkey") % 3 == 1, body).otherwise(F.lit("no answer"))
    parsed = X.parsed_extractions(V.table(spark, d, "orders").select("o_orderkey", answer.alias("answer")))
    return G.flatten_edges(parsed, keys=["o_orderkey"]).select("o_orderkey", "src", "dst")


@query("st7_fallback", "WITH c AS (SELECT user_id AS thread, event_id AS seq, props AS content FROM events WHERE event_type = 'click' AND user_id % 3 > 0) SELECT * FROM c UNION ALL SELECT DISTINCT user_id, 0, 'whole ' || user_id FROM events WHERE user_id NOT IN (SELECT thread FROM c)")
def st7(spark, d):
    events = V.table(spark, d, "events")
    chunks = events.where("event_type = 'click' AND user_id % 3 > 0").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), F.col("props").alias("content"))
    results = events.select(F.col("user_id").alias("thread")).distinct().withColumn("content", F.concat(F.lit("whole "), "thread"))
    return S.with_fallback(chunks, results)


@query("st8_thread_state", "WITH m AS (SELECT conv_id AS thread, CAST(turn AS BIGINT) AS seq, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT thread, count(*) AS messages, max(seq) AS last_seq, string_agg(text, '|' ORDER BY seq DESC) FILTER (back <= 6) AS tail FROM m GROUP BY thread")
def st8(spark, d):
    """The messages come in three parts of several files, a part a micro-batch; the stream is stopped and resumed before the last."""
    source, out, mark = (fresh_path(spark, f"threads{x}") for x in ("-messages", "", "-checkpoint"))
    rows = V.table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").cast("long").alias("seq"), "role", F.col("text").alias("content"))
    for k in range(3):
        S.append_files(rows.where(F.col("seq") % 3 == k), source, ["thread"])
        if k:
            state = M.thread_state(S.parquet_stream(spark, source, files_per_batch=S.FILES), out, mark)
    return state.select("thread", "messages", "last_seq", F.array_join(F.transform("tail", lambda m: m["content"]), "|").alias("tail"))
