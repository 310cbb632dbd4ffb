"""Conversation logs: sessions, token budgets, turns and quotas of tool calls.

messages: thread, seq, role (user, assistant, tool, system), content; tool rows also tool_call_id, and
assistant rows a list of tool calls. Windows are per thread or per turn of a thread, never over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dialogue as D
from ..functions import text
from ..functions.guards import preflight

EMPTY_KEY = "__kg_cypher_empty__"


def by_seq(*keys: str):
    return Window.partitionBy(*keys).orderBy("seq")


def message_tokens(content: Column, calls: Column | None = None, tool_name: Column | None = None, divisor: float = 3.0) -> Column:
    """Estimate of a message: its text, and the JSON of its calls or its tool's name."""
    out = text.token_estimate(content, divisor)
    for extra in (calls, tool_name):
        if extra is not None:
            out = out + text.token_estimate(extra, divisor)
    return out


def within_budget(messages: DataFrame, tokens: str, most: int) -> DataFrame:
    """The longest tail of each thread whose tokens stay within a budget; 0 keeps all."""
    if most <= 0:
        return messages
    tail = F.sum(tokens).over(Window.partitionBy("thread").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("tail_tokens", tail).where(F.col("tail_tokens") <= most)


def with_turns(messages: DataFrame) -> DataFrame:
    """turn: the number of user messages so far in the thread."""
    return messages.withColumn("turn_no", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(by_seq("thread").rowsBetween(Window.unboundedPreceding, 0)))


def tail_since_user(messages: DataFrame) -> DataFrame:
    """Rows after the last user message of each thread (all rows of a thread without one)."""
    last = messages.groupBy("thread").agg(F.max(F.when(F.col("role") == "user", F.col("seq"))).alias("last_user"))
    return messages.join(last, "thread").where(F.col("last_user").isNull() | (F.col("seq") > F.col("last_user"))).drop("last_user")


def turn_counters(messages: DataFrame) -> DataFrame:
    """Per thread and turn: tool results, those from the store, those that preflight made."""
    tools = with_turns(messages).where(F.col("role") == "tool")
    return tools.groupBy("thread", "turn_no").agg(F.count("*").alias("used"), F.count_if(D.is_round_trip(F.col("content"))).alias("round_trips"), F.count_if(D.is_preflight_error(F.col("content"))).alias("preflight_errors"))


def recent_results(messages: DataFrame, most: int = 6, head: int = 180) -> DataFrame:
    """The last tool results of each turn: position in the turn from 0, kind and head."""
    tools = with_turns(messages).where(F.col("role") == "tool")
    whole = Window.partitionBy("thread", "turn_no")
    ranked = tools.withColumn("i", F.row_number().over(whole.orderBy("seq")) - 1).withColumn("n", F.count("*").over(whole))
    return ranked.where(F.col("i") >= F.col("n") - most).select("thread", "turn_no", "i", D.result_kind(F.col("content")).alias("kind"), text.preview(F.col("content"), head).alias("head"))


def dedupe_key(query: Column) -> Column:
    q = text.collapse_spaces(query)
    return F.when(q == "", F.lit(EMPTY_KEY)).otherwise(q)


def duplicate_queries(calls: DataFrame, snippet: int = 800) -> DataFrame:
    """calls (thread, turn_no, seq, query, result) that repeat a query of their turn, with the last result it had."""
    before = Window.partitionBy("thread", "turn_no", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    keyed = calls.withColumn("key", dedupe_key(F.col("query")))
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("thread", "turn_no", "key").orderBy("seq")))
    return keyed.withColumn("previous", F.last(text.preview(F.col("result"), snippet), ignorenulls=True).over(before)).where(F.col("nth") > 1)


def quota_decisions(calls: DataFrame, hard: int = 12, errors: int = 2, rounds: int = 5) -> DataFrame:
    """What becomes of each call of a turn, by the results before it: hard_cap, duplicate, preflight_cap, the preflight class, round_cap or execute."""
    before = Window.partitionBy("thread", "turn_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("thread", "turn_no", "key").orderBy("seq")
    counted = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(before), F.lit(0))
    out = calls.withColumn("key", dedupe_key(F.col("query"))).withColumns({
        "used": counted(F.col("result").isNotNull()),
        "round_trips": counted(D.is_round_trip(F.col("result"))),
        "errors": counted(D.is_preflight_error(F.col("result"))),
        "nth": F.row_number().over(same),
        "class": preflight(F.col("query")),
    })
    decision = F.when(F.col("used") >= hard, "hard_cap").when(F.col("nth") > 1, "duplicate").when(F.col("errors") >= errors, "preflight_cap").when(F.col("class") != "ok", F.col("class")).when(F.col("round_trips") >= rounds, "round_cap").otherwise("execute")
    return out.withColumn("decision", decision)


def paired_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results of a turn, first to first; a result without a call is kept with a null call."""
    nth = F.row_number().over(by_seq("thread", "turn_no"))
    left = calls.withColumn("nth", nth).select("thread", "turn_no", "nth", F.col("seq").alias("call_seq"), "query")
    right = results.withColumn("nth", nth).select("thread", "turn_no", "nth", F.col("seq").alias("result_seq"), "content")
    return right.join(left, ["thread", "turn_no", "nth"], "left")


def calls_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and the results that name their id and come after them."""
    r = results.select("thread", "tool_call_id", F.col("seq").alias("result_seq"), "content")
    return calls.join(r, ["thread", "tool_call_id"]).where(F.col("result_seq") > F.col("seq"))


def repaired_rounds(messages: DataFrame) -> DataFrame:
    """messages that a model accepts: (thread, seq, role, content, calls, tool_call_id).

    A tool result stays if the assistant message before it asked for its id and had no answer to that id yet. If a user
    or system message, or the thread's end, comes while ids are unanswered, the round is undone: the results right
    before go, and the last assistant message with calls loses them. calls: an array of ids.
    """
    rows = messages.withColumn("_round", F.sum(F.when(F.col("role") == "tool", 0).otherwise(1)).over(by_seq("thread").rowsBetween(Window.unboundedPreceding, 0)))
    head = F.when(F.col("role") != "tool", F.struct("role", "calls"))
    whole = Window.partitionBy("thread", "_round")
    rows = rows.withColumn("_head", F.first(head, ignorenulls=True).over(whole))
    asked = (F.col("role") == "tool") & (F.col("_head.role") == "assistant") & F.coalesce(F.array_contains(F.col("_head.calls"), F.col("tool_call_id")), F.lit(False))
    again = F.row_number().over(Window.partitionBy("thread", "_round", "tool_call_id").orderBy("seq"))
    rows = rows.withColumn("_kept", (F.col("role") != "tool") | (asked & (again == 1)))
    answered = F.sum(F.when(F.col("_kept") & (F.col("role") == "tool"), 1).otherwise(0)).over(whole)
    wanted = F.size(F.array_distinct(F.coalesce(F.col("_head.calls"), F.array().cast("array<string>"))))
    rows = rows.withColumn("_open", (F.col("_head.role") == "assistant") & (answered < wanted))
    # the round after: another assistant message takes over silently, anything else (or the end) undoes the round
    heads = rows.where("role <> 'tool'").select("thread", F.col("_round").alias("_r"), F.lead("role").over(Window.partitionBy("thread").orderBy("_round")).alias("_next"))
    rows = rows.join(heads, (rows["thread"] == heads["thread"]) & (rows["_round"] == heads["_r"]), "left").drop(heads["thread"])
    undone = F.col("_open") & (F.coalesce("_next", F.lit("end")) != "assistant")
    out = rows.where(F.col("_kept") & ~((F.col("role") == "tool") & F.coalesce(undone, F.lit(False))))
    return out.withColumn("calls", F.when(undone & (F.col("role") == "assistant"), F.array().cast("array<string>")).otherwise(F.col("calls"))).select("thread", "seq", "role", "content", "calls", "tool_call_id")


def joined_fragments(fragments: DataFrame) -> DataFrame:
    """Per call, its fragments in the order of their index (numbers first), joined; blank and lone quotes dropped."""
    number = F.col("idx").try_cast("int")
    order = F.struct(F.when(F.col("idx").isNull() | number.isNotNull(), 0).otherwise(1).alias("k"), F.coalesce(number, F.when(F.col("idx").isNull(), F.col("pos"))).alias("n"), F.col("idx").alias("s"), F.col("pos").alias("p"), F.col("frag").alias("frag"))
    kept = fragments.where((text.strip(F.col("frag")) != "") & ~text.strip(F.col("frag")).isin('"', "'", '""'))
    return kept.groupBy("thread", "call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["frag"]), "").alias("query"))


def read_start(query: Column) -> Column:
    """A query that lost its first word, with it."""
    s = text.strip(query)
    known = s.rlike(r"(?i)^(MATCH|OPTIONAL\s+MATCH|CALL|WITH|UNWIND|RETURN)\b")
    return F.when((s == "") | known, s).when(F.startswith(s, F.lit("(")), F.concat(F.lit("MATCH "), s)).when(F.contains(F.left(s, F.lit(96)), F.lit(")")), F.concat(F.lit("MATCH ("), s)).otherwise(F.concat(F.lit("MATCH "), s))


def filled_calls(messages: DataFrame, calls: str = "calls") -> DataFrame:
    """Calls (id, name, args) without unnamed ones; a missing id is made from the message's place."""
    named = F.filter(calls, lambda c: F.coalesce(text.strip(c["name"]), F.lit("")) != "")
    made = F.transform(named, lambda c, i: F.struct(F.coalesce(F.nullif(c["id"], F.lit("")), F.concat_ws("_", F.lit("call"), F.col("thread").cast("string"), F.col("seq").cast("string"), i.cast("string"))).alias("id"), text.strip(c["name"]).alias("name"), c["args"].alias("args")))
    return messages.withColumn(calls, made)


def same_calls(a: Column, b: Column) -> Column:
    """Whether two lists of calls say the same."""
    return F.to_json(a).eqNullSafe(F.to_json(b))


def over_budget(questions: DataFrame, most: int, column: str = "content", divisor: float = 3.0) -> DataFrame:
    return questions.withColumn("tokens", text.token_estimate(text.strip(F.col(column)), divisor)).withColumn("accepted", F.col("tokens") <= most)


def prompt_log(messages: DataFrame, most: int = 24, chars: int = 400) -> DataFrame:
    """The last messages of each thread with their heads."""
    back = F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("seq")))
    return messages.withColumn("_back", back).where(F.col("_back") <= most).select("thread", "seq", "role", text.preview(F.col("content"), chars).alias("head"), F.length("content").alias("n_chars"))


def sessions(messages: DataFrame) -> DataFrame:
    """One row a thread: title from the first user message, number of messages, last seq."""
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("seq")))
    return messages.groupBy("thread").agg(text.session_title(first).alias("title"), F.count("*").alias("messages"), F.max("seq").alias("updated"))


def session_page(all_sessions: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    return all_sessions.orderBy(F.desc("updated"), "thread").offset(max(skip, 0)).limit(min(max(limit, 1), 100))


def session_messages(messages: DataFrame, owned: DataFrame) -> DataFrame:
    """Messages of the threads that a user owns, in order within a thread."""
    return messages.join(owned.select("thread"), "thread", "left_semi").orderBy("thread", "seq")


def recovered_query(calls: DataFrame) -> DataFrame:
    """calls (.., by_id, last_single, prose): the first that gives a query, and which it was."""
    q = [F.nullif(text.strip(F.col(c)), F.lit("")) for c in ("by_id", "last_single", "prose")]
    source = F.when(q[0].isNotNull(), "by_id").when(q[1].isNotNull(), "last_single").when(q[2].isNotNull(), "prose").otherwise("")
    return calls.withColumn("query", F.coalesce(*q, F.lit(""))).withColumn("source", source)


def tool_event(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def answer(chunks: DataFrame) -> DataFrame:
    """A thread's chunks in order as one text."""
    return chunks.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "").alias("content"))


# The stored log.


def with_sessions(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """stored (user_id, session_id, title, updated_at) with a row for each asked (user_id, session_id, question, at) that has none.

    Of several questions of a new session the first names it.
    """
    keys = ["user_id", "session_id"]
    new = asked.join(stored.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min_by("question", "at").alias("q"), F.min("at").alias("updated_at"))
    return stored.unionByName(new.select(*keys, text.session_title(F.col("q")).alias("title"), "updated_at"))


def touched(stored: DataFrame, messages: DataFrame) -> DataFrame:
    """stored with updated_at not before the session's last message (user_id, session_id, at)."""
    last = messages.groupBy("user_id", "session_id").agg(F.max("at").alias("_last"))
    out = stored.join(last, ["user_id", "session_id"], "left")
    return out.withColumn("updated_at", F.greatest("updated_at", "_last")).select(*stored.columns)


def renamed(stored: DataFrame, titles: DataFrame) -> DataFrame:
    """stored with the non-blank titles of (user_id, session_id, title)."""
    new = titles.select("user_id", "session_id", F.nullif(text.strip(F.col("title")), F.lit("")).alias("_title"))
    out = stored.join(new, ["user_id", "session_id"], "left")
    return out.withColumn("title", F.coalesce("_title", "title")).select(*stored.columns)


def token_log(calls: DataFrame, prompt: str, divisor: float = 2.0) -> DataFrame:
    """(thread, n, line): the template's estimate at 0, then a line for each call (thread, seq, message) with its usage."""
    u = D.usage(F.col("message"))
    both = F.concat_ws("\t", F.concat(F.lit("prompt_tokens="), F.coalesce(u["prompt_tokens"].cast("string"), F.lit(""))), F.concat(F.lit("completion_tokens="), F.coalesce(u["completion_tokens"].cast("string"), F.lit(""))))
    n = F.row_number().over(by_seq("thread"))
    lines = calls.select("thread", n.alias("n"), both.alias("line"))
    lines = lines.withColumn("line", F.concat_ws("\t", F.concat(F.lit("call#"), F.col("n").cast("string")), "line"))
    head = calls.select("thread").distinct().select("thread", F.lit(0).alias("n"), F.lit(f"SYSTEM_PROMPT_TEMPLATE\tprompt_tokens={max(1, int(len(prompt) / divisor))}").alias("line"))
    return head.unionByName(lines)
