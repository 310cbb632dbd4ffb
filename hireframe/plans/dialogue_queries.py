"""Queries on conversations and tool calls. Messages come from conversations; busier threads with tools from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialogue as D
from ..functions import text
from ..operators import conversation as C
from ..scratch import fresh_path
from ..streaming import incremental as S
from ..streaming import stateful as M
from . import views as V
from .catalogue import query

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TOKENS = "CASE WHEN strlen(coalesce({0}, '')) = 0 THEN 0 ELSE greatest(1, CAST(floor(strlen({0}) / 3.0) AS INT)) END"


def _chat(spark, d):
    return V.table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


CHAT = "chat AS (SELECT conv_id AS thread, turn AS seq, role, text AS content FROM conversations)"
RESULTS = ["[{\"n\": 1}]", "查询失败: x", "【参数错误】Cypher 为空", "【重复查询】x", "{\"a\": 1}", "abc ...[已截断，共 5 字符]", "", "【语法预检】x", "【系统限制】x", "【安全拒绝】x", "other"]
QUERIES = ["MATCH (n) RETURN n", "MATCH  (n)  RETURN n", "", "SHOW DATABASES", "MATCH (n) DELETE n", "MATCH (m) RETURN m LIMIT 3", "RETURN 1; RETURN 2"]


def _array(values):
    return F.array(*[F.lit(v) for v in values])


def _sql_list(values):
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "])"


def _tools(spark, d):
    """Messages of threads with tools, from events."""
    e = V.table(spark, d, "events")
    role = F.expr("CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'assistant' WHEN 'signup' THEN 'system' ELSE 'tool' END")
    content = F.when(role == "tool", F.element_at(_array(RESULTS), (F.col("event_id") % len(RESULTS) + 1).cast("int"))).otherwise(F.col("props"))
    return e.select((F.col("user_id") % 97).alias("thread"), F.col("event_id").alias("seq"), role.alias("role"), content.alias("content"), F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("tool_call_id"), F.expr("CASE WHEN event_type = 'view' THEN slice(array('t0', 't1', 't2'), 1, CAST(event_id % 4 AS INT)) END").alias("calls"))


TOOLS = f"""tools AS (SELECT user_id % 97 AS thread, event_id AS seq, CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'assistant' WHEN 'signup' THEN 'system' ELSE 'tool' END AS role,
  CASE WHEN event_type IN ('error', 'purchase') THEN {_sql_list(RESULTS)}[event_id % {len(RESULTS)} + 1] ELSE props END AS content, 't' || (event_id % 3) AS tool_call_id FROM events),
turns AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY seq) AS BIGINT) AS turn_no FROM tools)"""
ROUND = "({0} <> '' AND NOT starts_with({0}, '【') AND (starts_with({0}, '查询失败:') OR contains(left({0}, 400), '[已截断') OR starts_with({0}, '[') OR starts_with({0}, '{{')))"
FAULT = "(starts_with({0}, '【参数错误】') OR starts_with({0}, '【语法预检】') OR starts_with({0}, '【安全拒绝】'))"
KIND = """CASE WHEN starts_with({0}, '【系统限制】') THEN 'system_cap' WHEN starts_with({0}, '【重复查询】') THEN 'duplicate' WHEN starts_with({0}, '【参数错误】') THEN 'param' WHEN starts_with({0}, '【语法预检】') THEN 'syntax'
 WHEN starts_with({0}, '【安全拒绝】') THEN 'security' WHEN starts_with({0}, '查询失败:') THEN 'neo4j_error' WHEN starts_with({0}, '[') OR starts_with({0}, '{{') THEN 'json' WHEN contains(left({0}, 400), '[已截断') THEN 'json_truncated' ELSE 'other' END"""
CLASS = r"CASE WHEN length(trim({0})) < 8 THEN '参数错误' WHEN regexp_matches(upper({0}), '\b(DELETE|SET|CREATE|MERGE)\b') THEN '安全拒绝' WHEN NOT regexp_matches(upper({0}), '\b(MATCH|CALL|WITH|UNWIND|RETURN)\b') THEN '语法预检' WHEN regexp_matches(trim({0}), ';\s*[^\s;]') THEN '语法预检' ELSE 'ok' END"


def _calls(spark, d):
    """Calls of the tool with their results: thread, turn_no, seq, query, result."""
    e = V.table(spark, d, "events")
    pick = lambda values, by: F.element_at(_array(values), (by % len(values) + 1).cast("int"))
    return e.select((F.col("user_id") % 97).alias("thread"), F.expr("event_id DIV 1000").alias("turn_no"), F.col("event_id").alias("seq"), pick(QUERIES, F.expr("event_id * 3 + user_id")).alias("query"), pick(RESULTS, F.col("event_id")).alias("result"))


CALLS = rf"""calls AS (SELECT user_id % 97 AS thread, event_id // 1000 AS turn_no, event_id AS seq, {_sql_list(QUERIES)}[(event_id * 3 + user_id) % {len(QUERIES)} + 1] AS query, {_sql_list(RESULTS)}[event_id % {len(RESULTS)} + 1] AS result FROM events),
keyed AS (SELECT *, CASE WHEN trim(query) = '' THEN '__kg_cypher_empty__' ELSE regexp_replace(trim(query), '\s+', ' ', 'g') END AS key FROM calls),
nth AS (SELECT *, CAST(row_number() OVER (PARTITION BY thread, turn_no, key ORDER BY seq) AS INT) AS nth FROM keyed)"""


@query("x20_token_estimate", f"SELECT conv_id, turn, {TOKENS.format('text')} AS tokens FROM conversations")
def x20(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


@query("w3_budget_suffix", f"WITH {CHAT}, t AS (SELECT *, {TOKENS.format('content')} AS tokens FROM chat), s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY thread ORDER BY seq DESC) AS BIGINT) AS tail_tokens FROM t) SELECT thread, seq, tokens, tail_tokens FROM s WHERE tail_tokens <= 120")
def w3(spark, d):
    rows = _chat(spark, d).withColumn("tokens", C.message_tokens(F.col("content")))
    return C.within_budget(rows, "tokens", 120).select("thread", "seq", "tokens", "tail_tokens")


@query("w4_tail_since_user", f"WITH {TOOLS}, l AS (SELECT thread, max(CASE WHEN role = 'user' THEN seq END) AS u FROM tools GROUP BY thread) SELECT tools.thread, seq, role FROM tools JOIN l ON l.thread = tools.thread WHERE u IS NULL OR seq > u")
def w4(spark, d):
    return C.tail_since_user(_tools(spark, d)).select("thread", "seq", "role")


@query("a22_turn_counters", f"WITH {TOOLS} SELECT thread, turn_no, count(*) AS used, count(*) FILTER ({ROUND.format('content')}) AS round_trips, count(*) FILTER ({FAULT.format('content')}) AS preflight_errors FROM turns WHERE role = 'tool' GROUP BY ALL")
def a22(spark, d):
    return C.turn_counters(_tools(spark, d))


@query("w7_recent_summaries", f"WITH {TOOLS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY thread, turn_no ORDER BY seq) - 1 AS INT) AS i, count(*) OVER (PARTITION BY thread, turn_no) AS n FROM turns WHERE role = 'tool') SELECT thread, turn_no, i, {KIND.format('content')} AS kind, content AS head FROM r WHERE i >= n - 6")
def w7(spark, d):
    return C.recent_results(_tools(spark, d))


@query("w5_duplicate_queries", f"WITH {CALLS}, p AS (SELECT *, last_value(result IGNORE NULLS) OVER (PARTITION BY thread, turn_no, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM nth) SELECT thread, turn_no, seq, key, nth, previous FROM p WHERE nth > 1")
def w5(spark, d):
    return C.duplicate_queries(_calls(spark, d)).select("thread", "turn_no", "seq", "key", "nth", "previous")


DECISIONS = f"""WITH {CALLS}, c AS (SELECT *, count(result) OVER w AS used, count(*) FILTER ({ROUND.format('result')}) OVER w AS rt, count(*) FILTER ({FAULT.format('result')}) OVER w AS er, {CLASS.format('query')} AS class FROM nth WINDOW w AS (PARTITION BY thread, turn_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT thread, turn_no, seq, CASE WHEN used >= 12 THEN 'hard_cap' WHEN nth > 1 THEN 'duplicate' WHEN er >= 2 THEN 'preflight_cap' WHEN class <> 'ok' THEN class WHEN rt >= 5 THEN 'round_cap' ELSE 'execute' END AS decision FROM c"""


@query("st9_quota_decision", DECISIONS)
def st9(spark, d):
    return C.quota_decisions(_calls(spark, d)).select("thread", "turn_no", "seq", "decision")


@query("st9_online_quota", DECISIONS)
def st9_online(spark, d):
    """The same decisions from a stream: calls come in four parts, and the stream is stopped and resumed after each two."""
    source, out, mark = (fresh_path(spark, f"quota{x}") for x in ("-calls", "", "-checkpoint"))
    calls = _calls(spark, d)
    last = calls.agg(F.max("seq")).first()[0] or 0
    for k in range(4):
        S.append_files(calls.where(F.floor(F.col("seq") * 4 / (last + 1)) == k), source, ["thread", "turn_no"])
        if k % 2:
            with M.state_in_rocksdb(spark):
                decided = S.append_batches(M.online_quota(S.parquet_stream(spark, source, files_per_batch=S.FILES)), out, mark)
    return decided


@query("j13_paired_calls", f"WITH {TOOLS}, a AS (SELECT thread, turn_no, seq, row_number() OVER (PARTITION BY thread, turn_no ORDER BY seq) AS n FROM turns WHERE role = 'assistant'), b AS (SELECT thread, turn_no, seq, row_number() OVER (PARTITION BY thread, turn_no ORDER BY seq) AS n FROM turns WHERE role = 'tool') SELECT b.thread, b.turn_no, CAST(b.n AS INT) AS nth, b.seq AS result_seq, a.seq AS call_seq FROM b LEFT JOIN a ON a.thread = b.thread AND a.turn_no = b.turn_no AND a.n = b.n")
def j13(spark, d):
    rows = C.with_turns(_tools(spark, d))
    return C.paired_calls(rows.where("role = 'assistant'").withColumn("query", F.col("content")), rows.where("role = 'tool'")).select("thread", "turn_no", "nth", "result_seq", "call_seq")


@query("j12_calls_with_results", f"WITH {TOOLS} SELECT a.thread, a.tool_call_id, count(*) AS n, min(b.seq) AS first_result FROM tools a JOIN tools b ON a.thread = b.thread AND a.tool_call_id = b.tool_call_id AND b.seq > a.seq WHERE a.role = 'assistant' AND b.role = 'tool' GROUP BY ALL")
def j12(spark, d):
    rows = _tools(spark, d)
    calls = rows.where("role = 'assistant'").select("thread", "tool_call_id", "seq")
    return C.calls_with_results(calls, rows.where("role = 'tool'")).groupBy("thread", "tool_call_id").agg(F.count("*").alias("n"), F.min("result_seq").alias("first_result"))


@query(
    "j12_stream_pairs",
    """WITH a AS (SELECT user_id AS thread, event_id % 3 AS call, event_id AS call_seq, ts FROM events WHERE event_type = 'view'), b AS (SELECT user_id AS thread, event_id % 3 AS call, event_id AS result_seq, ts FROM events WHERE event_type IN ('purchase', 'error'))
SELECT a.thread, a.call, call_seq, result_seq FROM a LEFT JOIN b ON b.thread = a.thread AND b.call = a.call AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""",
)
def j12_stream(spark, d):
    """Calls and results as two streams; a last mark on both sides, later than all, lets the watermark pass the open calls."""
    source, out, mark = (fresh_path(spark, f"pairs{x}") for x in ("-events", "", "-checkpoint"))
    e = V.table(spark, d, "events").select(F.col("user_id").alias("thread"), (F.col("event_id") % 3).alias("call"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    last = e.agg(F.max("seq")).first()[0] or 0
    for k in range(3):
        S.append_files(e.where(F.floor(F.col("seq") * 3 / (last + 1)) == k), source, ["thread"])
    none = [F.lit(v).cast("long").alias(c) for c, v in (("thread", -1), ("call", -1), ("seq", None))]  # rows without a key are dropped before they count for the watermark
    for days in (2, 4):  # each mark in a batch of its own: the watermark of one counts in the next
        marks = e.agg((F.max("at") + F.expr(f"INTERVAL {days} DAY")).alias("at")).where("at IS NOT NULL")
        S.append_files(marks.select(*none, "at", F.explode(F.array(F.lit("view"), F.lit("error"))).alias("event_type")), source, ["event_type"])
        stream = S.parquet_stream(spark, source, files_per_batch=S.FILES)
        calls = stream.where("event_type = 'view'").select("thread", "call", F.col("seq").alias("call_seq"), F.col("at").alias("started"))
        results = stream.where("event_type IN ('purchase', 'error')").select("thread", "call", F.col("seq").alias("result_seq"), F.col("at").alias("ended"))
        with M.state_partitions(spark):
            paired = S.append_batches(M.paired_streams(calls, results, ["thread", "call"], "6 hours", "1 hour"), out, mark)
    return paired.where("call_seq IS NOT NULL").select("thread", "call", "call_seq", "result_seq")


@query(
    "w6_repair_rounds",
    f"""WITH {TOOLS}, m AS (SELECT *, CASE WHEN event_type = 'view' THEN (['t0', 't1', 't2'])[1:event_id % 4] END AS calls FROM tools JOIN (SELECT event_id, event_type FROM events) ON event_id = seq),
r AS (SELECT *, sum(CASE WHEN role = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY thread ORDER BY seq) AS round FROM m),
h AS (SELECT thread, round, role AS head, calls AS asked, coalesce(lead(role) OVER (PARTITION BY thread ORDER BY round), 'end') AS next FROM r WHERE role <> 'tool'),
k AS (SELECT r.*, head, asked, next, row_number() OVER (PARTITION BY r.thread, r.round, r.tool_call_id ORDER BY seq) AS again FROM r LEFT JOIN h ON h.thread = r.thread AND h.round = r.round),
g AS (SELECT *, role = 'tool' AND coalesce(head = 'assistant' AND list_contains(asked, tool_call_id) AND again = 1, false) AS answers FROM k),
o AS (SELECT *, coalesce(head = 'assistant' AND next <> 'assistant' AND count(*) FILTER (answers) OVER (PARTITION BY thread, round) < coalesce(len(asked), 0), false) AS undone FROM g)
SELECT thread, seq, role, CAST(CASE WHEN undone AND role = 'assistant' THEN 0 ELSE coalesce(len(calls), 0) END AS INT) AS n_calls FROM o WHERE role <> 'tool' OR answers AND NOT undone""",
)
def w6(spark, d):
    return C.repaired_rounds(_tools(spark, d)).select("thread", "seq", "role", F.size(F.coalesce("calls", F.array().cast("array<string>"))).alias("n_calls"))


@query("x22_result_kind", f"WITH {TOOLS} SELECT seq, {KIND.format('content')} AS kind, {ROUND.format('content')} AS round_trip FROM tools WHERE role = 'tool'")
def x22(spark, d):
    return _tools(spark, d).where("role = 'tool'").select("seq", D.result_kind(F.col("content")).alias("kind"), D.is_round_trip(F.col("content")).alias("round_trip"))


LINE = STRIP.format("split_part(" + STRIP.format("coalesce(q, '')") + ", chr(10), 1)")
TITLE = "CASE WHEN l = '' THEN '新对话' WHEN length(l) > 80 THEN left(l, 79) || '…' ELSE l END"
SESSIONS = f"{CHAT}, f AS (SELECT thread, arg_min(content, seq) FILTER (role = 'user') AS q, count(*) AS messages, max(seq) AS updated FROM chat GROUP BY thread), s AS (SELECT thread, messages, updated, {LINE} AS l FROM f), sessions AS (SELECT thread, {TITLE} AS title, messages, updated FROM s)"


@query("x19_session_title", f"WITH {SESSIONS} SELECT thread, title FROM sessions")
def x19(spark, d):
    return C.sessions(_chat(spark, d)).select("thread", "title")


@query("o6_sessions_page", f"WITH {SESSIONS} SELECT * FROM sessions ORDER BY updated DESC, thread LIMIT 20 OFFSET 10")
def o6(spark, d):
    return C.session_page(C.sessions(_chat(spark, d)), 10, 20)


@query("o7_messages", f"WITH {CHAT} SELECT * FROM chat")
def o7(spark, d):
    rows = _chat(spark, d)
    return C.session_messages(rows, rows.select("thread").distinct())


@query("c4_question_budget", f"WITH {CHAT} SELECT thread, seq, {TOKENS.format(STRIP.format('content'))} AS tokens, {TOKENS.format(STRIP.format('content'))} <= 30 AS accepted FROM chat WHERE role = 'user'")
def c4(spark, d):
    return C.over_budget(_chat(spark, d).where("role = 'user'"), 30).select("thread", "seq", "tokens", "accepted")


@query("c5_prompt_log", f"WITH {CHAT}, r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY seq DESC) AS b FROM chat) SELECT thread, seq, role, CASE WHEN length(content) > 100 THEN left(content, 100) || '…' ELSE content END AS head, CAST(length(content) AS INT) AS n_chars FROM r WHERE b <= 3")
def c5(spark, d):
    return C.prompt_log(_chat(spark, d), 3, 100)


@query("c7_cut_result", "SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN left(text, 50) || chr(10) || '...[已截断，共 ' || length(text) || ' 字符]' ELSE text END AS body FROM conversations")
def c7(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", D.cut_result(F.col("text"), 50).alias("body"))


@query("c6_tool_events", """SELECT event_id, '{"event":"' || event_type || '","n":' || event_id || '}' AS line FROM events""")
def c6(spark, d):
    return V.table(spark, d, "events").select("event_id", F.col("event_type").alias("event"), F.col("event_id").alias("n")).select("event_id", C.tool_event(["event", "n"]).alias("line"))


@query("c1_recovered_query", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 3 = 1 THEN 'b' WHEN event_id % 2 = 0 THEN 'c' ELSE '' END AS query, CASE WHEN event_id % 3 = 0 THEN 'by_id' WHEN event_id % 3 = 1 THEN 'last_single' WHEN event_id % 2 = 0 THEN 'prose' ELSE '' END AS source FROM events")
def c1(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN ' a ' END").alias("by_id"), F.expr("CASE WHEN event_id % 3 = 1 THEN 'b' ELSE ' ' END").alias("last_single"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'c' END").alias("prose"))
    return C.recovered_query(rows).select("event_id", "query", "source")


@query("c3_filled_calls", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'call_' || (user_id % 97) || '_' || event_id || '_0' ELSE 'x' END AS first_id FROM events")
def c3(spark, d):
    one = F.expr("array(struct(CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' END AS id, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'kg' END AS name, '{}' AS args))")
    rows = V.table(spark, d, "events").select("event_id", (F.col("user_id") % 97).alias("thread"), F.col("event_id").alias("seq"), one.alias("calls"))
    return C.filled_calls(rows).select("event_id", F.coalesce(F.get(F.col("calls"), F.lit(0))["id"], F.lit("")).alias("first_id"))


@query(
    "o12_fragments",
    """WITH f AS (SELECT user_id AS thread, event_id // 20 AS call, event_id AS pos, event_id % 5 AS i, CASE WHEN event_id % 9 = 0 THEN '"' ELSE event_type || event_id END AS frag FROM events)
SELECT thread, call, string_agg(frag, '' ORDER BY CASE WHEN i = 4 THEN 1 ELSE 0 END, CASE WHEN i = 4 THEN 0 ELSE i END, pos) AS query FROM f WHERE frag <> '"' GROUP BY thread, call""",
)
def o12(spark, d):
    rows = V.table(spark, d, "events").select(F.col("user_id").alias("thread"), F.expr("event_id DIV 20").alias("call"), F.col("event_id").alias("pos"), F.expr("CASE WHEN event_id % 5 = 4 THEN 'last' ELSE CAST(event_id % 5 AS STRING) END").alias("idx"), F.expr("CASE WHEN event_id % 9 = 0 THEN '\"' ELSE concat(event_type, event_id) END").alias("frag"))
    return C.joined_fragments(rows)


@query("c2_read_start", "SELECT event_id, (['MATCH (n) RETURN n', 'MATCH (n) RETURN n', 'MATCH (n) RETURN n', 'MATCH x y', 'return 1'])[event_id % 5 + 1] AS query FROM events")
def c2(spark, d):
    lost = ["MATCH (n) RETURN n", "(n) RETURN n", "n) RETURN n", "x y", "return 1"]
    return V.table(spark, d, "events").select("event_id", C.read_start(F.element_at(_array(lost), (F.col("event_id") % 5 + 1).cast("int"))).alias("query"))


@query("x21_query_key", r"WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '  ' ELSE text END AS t FROM conversations) SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN '__kg_cypher_empty__' ELSE regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') END AS key FROM q")
def x21(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", C.dedupe_key(F.expr("CASE WHEN turn % 5 = 0 THEN '  ' ELSE text END")).alias("key"))


@query("x26_preview", "SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS head FROM conversations")
def x26(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", text.preview(F.col("text"), 40).alias("head"))


@query("x31_plain_text", "SELECT conv_id, turn, role || text AS body FROM conversations")
def x31(spark, d):
    blocks = F.expr("array(named_struct('type', 'text', 'text', role), named_struct('type', 'image', 'text', 'no'), named_struct('type', 'text', 'text', text))")
    return V.table(spark, d, "conversations").select("conv_id", "turn", D.plain_text(blocks).alias("body"))


@query("x32_tool_call_fields", "SELECT event_id, event_type AS name, 'i' || event_id AS id, props AS args FROM events")
def x32(spark, d):
    shapes = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"id":"i', event_id, '","name":" ', event_type, '","args":', props, '}')
        WHEN 1 THEN concat('{"tool_call_id":"i', event_id, '","name":"', event_type, '","arguments":', props, '}') ELSE concat('{"id":"i', event_id, '","function":{"name":"', event_type, '","arguments":', props, '}}') END""")
    args = F.expr("replace(args, ':', ': ')")
    return V.table(spark, d, "events").withColumn("c", shapes).select("event_id", D.tool_call_name(F.col("c")).alias("name"), D.tool_call_id(F.col("c")).alias("id"), D.tool_call_args(F.col("c")).alias("args")).withColumn("args", args)


@query("x35_usage", "SELECT event_id, event_id AS prompt_tokens, CASE WHEN event_id % 2 = 0 THEN 7 END AS completion_tokens FROM events")
def x35(spark, d):
    line = F.expr("""CASE WHEN event_id % 2 = 0 THEN concat('{"token_usage":{"prompt_tokens":', event_id, ',"completion_tokens":7}}') ELSE concat('{"usage":{"input_tokens":', event_id, '}}') END""")
    return V.table(spark, d, "events").select("event_id", D.usage(line).alias("u")).select("event_id", "u.*")


@query("x23_arg_normalise", "SELECT event_id, (['MATCH (n)', 'RETURN 1', 'plain', 'only', ''])[event_id % 5 + 1] AS query FROM events")
def x23(spark, d):
    shapes = F.expr("""CASE event_id % 5 WHEN 0 THEN '{"cypher_query":" MATCH (n) "}' WHEN 1 THEN '{"query":"{\\\\"cypher\\\\":\\\\"RETURN 1\\\\"}"}' WHEN 2 THEN 'plain' WHEN 3 THEN '{"x":"only"}' ELSE '{"x":"a","y":"b"}' END""")
    return V.table(spark, d, "events").select("event_id", D.normalized_argument(shapes).alias("query"))


@query(
    "x24_query_from_prose",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'MATCH (n) WHERE n.k = ' || event_id || ' RETURN n' WHEN 1 THEN 'MATCH (a' || event_id || ') RETURN a' || event_id WHEN 3 THEN 'CALL db.labels(' || event_id || ')'
 WHEN 5 THEN 'optional match (b) return b.x' || event_id WHEN 7 THEN 'RETURN ' || event_id || ' AS n' ELSE '' END AS query FROM events""",
)
def x24(spark, d):
    """Answers with a fenced query, one amid prose up to an empty line, none, a call, a writing one, lower case, one too short, and a fence without its language."""
    said = F.expr("""CASE event_id % 8 WHEN 0 THEN concat('see ```cypher\nMATCH (n) WHERE n.k = ', event_id, ' RETURN n\n``` ok') WHEN 1 THEN concat('so: MATCH (a', event_id, ') RETURN a', event_id, '\n\nand MATCH more')
 WHEN 2 THEN concat('nothing MATCHED ', event_id) WHEN 3 THEN concat('I CALL db.labels(', event_id, ')') WHEN 4 THEN concat('```\nMATCH (n) SET n.x = ', event_id, '\n``` but MATCH (m) RETURN m')
 WHEN 5 THEN concat('try optional match (b) return b.x', event_id, '``` MATCH (c)') WHEN 6 THEN 'MATCH x' ELSE concat('```\r\nRETURN ', event_id, ' AS n\r\n```') END""")
    return V.table(spark, d, "events").select("event_id", D.query_in_prose(said).alias("query"))


@query("x25_json_leak_trim", "SELECT event_id, (['MATCH (n) RETURN n', 'RETURN 1', 'WHERE n.x = \"a\"', 'LIMIT 5'])[event_id % 4 + 1] AS query FROM events")
def x25(spark, d):
    leaks = ['MATCH (n) RETURN n"}', 'RETURN 1\\"}"', 'WHERE n.x = "a"', 'LIMIT 5"}}']
    return V.table(spark, d, "events").select("event_id", D.trim_json_leak(F.element_at(_array(leaks), (F.col("event_id") % 4 + 1).cast("int"))).alias("query"))


@query("x37_json_repair", r"SELECT event_id, regexp_replace(props, '\s*([:,])\s*', '\1 ', 'g') AS fixed FROM events")
def x37(spark, d):
    return V.table(spark, d, "events").select("event_id", D.repair_json(F.expr("left(props, length(props) - CAST(event_id % 2 AS INT))")).alias("fixed"))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
# the texts are in normal form KC already; the line at the end is written as that form has it
_PANEL = "'职位描述' || chr(10) || text || chr(10) || '· •' || chr(10) || '李女士 今日活跃' || chr(10) || 'ABC'"


@query(
    "t7_side_panel_clean",
    rf"""WITH l AS (SELECT doc_id, list_transform(string_split_regex({_PANEL}, '\r\n|[\n\r\x0B\f\x1C-\x1E]'), lambda x: {_STRIP.format("x")}) AS lines FROM documents),
k AS (SELECT doc_id, list_filter(lines, lambda x: x <> '' AND NOT regexp_matches(lower(x), '{"|".join(D.PANEL_WORDS)}') AND NOT (regexp_matches(x, '先生|女士') AND regexp_matches(x, '活跃|招聘经理|沟通')) AND NOT regexp_matches(x, '^[\s·•]+$')) AS lines FROM l)
SELECT doc_id, {_STRIP.format("array_to_string(list_transform(lines, lambda x: CASE WHEN x = '职位描述' THEN '' ELSE x END), chr(10))")} AS cleaned FROM k""",
)
def t7(spark, d):
    said = F.concat(F.lit("职位描述\n"), "text", F.lit("\n· •\n李女士 今日活跃\nＡＢＣ"))
    return V.table(spark, d, "documents").select("doc_id", D.clean_side_panel(said).alias("cleaned"))


_SAID = "'岗位职责:1、' || left(text, length(text) // 2) || chr(10) || '任职要求:' || substr(text, length(text) // 2 + 1)"
_PART = "regexp_extract(" + _SAID + ", '(?s)^(.*?)(?:任职资格|任职要求|岗位要求)(.*)$', {0})"
_DUTY = r"regexp_replace({0}, '(?m)^(?:工作职责|岗位职责|工作内容|职位描述)[：:\s\d、．.]*', '', 'g')".format(_STRIP.format(_PART.format(1)))


@query(
    "x27_split_duty",
    f"SELECT doc_id, {_STRIP.format(_DUTY)} AS duty, {_STRIP.format(_PART.format(2))} AS requirement FROM documents",
)
def x27(spark, d):
    said = F.concat(F.lit("岗位职责：1、"), F.expr("left(text, CAST(length(text) DIV 2 AS INT))"), F.lit("\n任职要求："), F.expr("substr(text, CAST(length(text) DIV 2 AS INT) + 1)"))
    return V.table(spark, d, "documents").select("doc_id", D.split_duty(said).alias("s")).select("doc_id", "s.*")


ASKED = "asked AS (SELECT conv_id % 9 AS user_id, 's' || conv_id AS session_id, text AS question, turn AS tm FROM conversations WHERE role = 'user'), old AS (SELECT DISTINCT conv_id % 9 AS user_id, 's' || conv_id AS session_id, 'old' AS title, CAST(0 AS BIGINT) AS updated_at FROM conversations WHERE conv_id % 4 = 0)"
FIRST = LINE.replace("coalesce(q, '')", "coalesce(arg_min(question, tm), '')")


def _asked(spark, d):
    rows = V.table(spark, d, "conversations").select((F.col("conv_id") % 9).alias("user_id"), F.concat(F.lit("s"), "conv_id").alias("session_id"), F.col("text").alias("question"), F.col("turn").alias("at"), "role")
    old = rows.where("CAST(substr(session_id, 2) AS INT) % 4 = 0").select("user_id", "session_id", F.lit("old").alias("title"), F.lit(0).cast("long").alias("updated_at")).distinct()
    return old, rows


@query(
    "k13_chat_sessions",
    f"""WITH {ASKED}, l AS (SELECT user_id, session_id, {FIRST} AS l FROM asked GROUP BY ALL), n AS (SELECT user_id, session_id, {TITLE} AS title FROM l WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.session_id = l.session_id)),
s AS (SELECT user_id, session_id, title FROM old UNION ALL SELECT * FROM n), t AS (SELECT conv_id % 9 AS user_id, 's' || conv_id AS session_id, max(turn) AS u FROM conversations GROUP BY ALL)
SELECT s.user_id, s.session_id, CASE WHEN s.user_id = 5 THEN 'renamed' ELSE title END AS title, u AS updated_at FROM s JOIN t ON t.session_id = s.session_id""",
)
def k13(spark, d):
    old, rows = _asked(spark, d)
    out = C.touched(C.with_sessions(old, rows.where("role = 'user'")), rows)
    return C.renamed(out, out.where("user_id = 5").select("user_id", "session_id", F.lit(" renamed ").alias("title")))


@query("k11_token_log", "WITH c AS (SELECT user_id AS thread, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id FROM events) SELECT thread, CAST(n AS INT) AS n, 'call#' || n || chr(9) || 'prompt_tokens=' || event_id || chr(9) || 'completion_tokens=' AS line FROM c UNION ALL SELECT DISTINCT user_id, 0, 'SYSTEM_PROMPT_TEMPLATE' || chr(9) || 'prompt_tokens=5' FROM events")
def k11(spark, d):
    calls = V.table(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), F.expr("""concat('{"usage":{"input_tokens":', event_id, '}}')""").alias("message"))
    return C.token_log(calls, "x" * 10)


@query("a25_same_calls", "SELECT event_id, event_id % 2 = 0 AS same FROM events")
def a25(spark, d):
    calls = lambda name: F.array(F.struct(name.alias("name"), F.col("props").alias("args")))
    return V.table(spark, d, "events").select("event_id", C.same_calls(calls(F.col("event_type")), calls(F.expr("CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'z' END"))).alias("same"))
