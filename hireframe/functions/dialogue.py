"""Expressions on messages and tool calls; recursive repairs are Arrow-batched functions."""

from __future__ import annotations

import json
import re
from unicodedata import normalize

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import preview, strip

# Prefixes of tool results and their kinds, first match wins.
RESULT_KINDS = [("【系统限制】", "system_cap"), ("【重复查询】", "duplicate"), ("【参数错误】", "param"), ("【语法预检】", "syntax"), ("【安全拒绝】", "security"), ("查询失败:", "neo4j_error"), ("[", "json"), ("{", "json")]
CUT_MARK = "[已截断"
PREFLIGHT_PREFIXES = ["【参数错误】", "【语法预检】", "【安全拒绝】"]
#: Names under which a query may be given, best first.
QUERY_KEYS = ["cypher_query", "cypher", "query", "statement", "q", "sql"]
# Words of a side panel's own lines; of lines on a recruiter (one of each row); its title.
PANEL_WORDS = ["举报", "微信扫码", "扫码分享", "去app", "前往app", "与boss", "今日活跃", "随时沟通", "招聘经理", "前往下载"]
PANEL_PERSON = [["先生", "女士"], ["活跃", "招聘经理", "沟通"]]
PANEL_TITLE = "职位描述"
# Headings of requirements and of duties, and what may follow the latter.
REQUIREMENT_HEADINGS = ["任职资格", "任职要求", "岗位要求"]
DUTY_HEADINGS = ["工作职责", "岗位职责", "工作内容", "职位描述"]
AFTER_HEADING = r"[：:\s\d、．.]*"
#: Where a text breaks into lines, and white space with the separators that count as such.
LINE_BREAK, BLANK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", r"[\s\x1C-\x1F]"


def result_kind(content: Column) -> Column:
    s = strip(F.coalesce(content, F.lit("")))
    out = F
    for prefix, kind in RESULT_KINDS:
        out = out.when(F.startswith(s, F.lit(prefix)), F.lit(kind))
    return out.when(F.contains(F.left(s, F.lit(400)), F.lit(CUT_MARK)), "json_truncated").otherwise("other")


def is_round_trip(content: Column) -> Column:
    """Whether a tool result came from the graph store."""
    s = strip(F.coalesce(content, F.lit("")))
    starts = lambda *p: F.substring(s, 1, 1).isin(*p)
    return (s != "") & ~starts("【") & (F.startswith(s, F.lit("查询失败:")) | F.contains(F.left(s, F.lit(400)), F.lit(CUT_MARK)) | starts("[", "{"))


def is_preflight_error(content: Column) -> Column:
    s = strip(F.coalesce(content, F.lit("")))
    return s.rlike("^(" + "|".join(PREFLIGHT_PREFIXES) + ")")


def plain_text(blocks: Column, separator: str = "") -> Column:
    """Text of a list of blocks (type, text): those of type text."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), separator)


def tool_call_name(call: Column) -> Column:
    """Name in a tool call's JSON: its own, or its function's."""
    get = lambda p: F.nullif(strip(F.get_json_object(call, p)), F.lit(""))
    return F.coalesce(get("$.name"), get("$.function.name"), F.lit(""))


def tool_call_id(call: Column) -> Column:
    return F.coalesce(F.get_json_object(call, "$.id"), F.get_json_object(call, "$.tool_call_id"))


def tool_call_args(call: Column) -> Column:
    return F.coalesce(F.get_json_object(call, "$.args"), F.get_json_object(call, "$.arguments"), F.get_json_object(call, "$.function.arguments"))


def usage(message: Column) -> Column:
    """Struct (prompt_tokens, completion_tokens) from either shape of a usage record."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(message, p) for p in paths]).try_cast("long")
    both = lambda *names: get(*[f"$.{k}.{n}" for k in ("token_usage", "usage") for n in names])
    return F.struct(both("prompt_tokens", "input_tokens").alias("prompt_tokens"), both("completion_tokens", "output_tokens").alias("completion_tokens"))


def output_preview(c: Column, most: int = 400) -> Column:
    return preview(strip(F.coalesce(c, F.lit(""))), most)


def cut_result(c: Column, most: int = 12_000) -> Column:
    """A result's text, cut with a note of its whole length."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("\n...[已截断，共 "), F.length(c).cast("string"), F.lit(" 字符]"))).otherwise(c)


# What has no built-in: normal forms, and repairs that run until nothing changes.


def trimmed_leak(s: str) -> str:
    """Without the JSON quotes and braces that leaked behind a query; at most 12 steps."""
    s = s.rstrip()
    # the longest ending first; a lone quote only after a digit or where quotes do not pair
    endings = ['\\"}"', '\\"}', '"}', '}"', "\\", "}"]
    for _ in range(12):
        cut = next((len(e) for e in endings if s.endswith(e)), 0)
        if not cut and s.endswith('"') and (s[-2:-1].isascii() and s[-2:-1].isdigit() or s.count('"') % 2):
            cut = 1
        if not cut:
            break
        s = s[:-cut].rstrip()
    return s


@F.pandas_udf(T.StringType())
def trim_json_leak(column: pd.Series) -> pd.Series:
    return column.map(lambda s: None if s is None else trimmed_leak(s))


def query_of(value, depth: int = 4) -> str:
    """The query in an argument: a known key, JSON in text, or the only text of a mapping."""
    if isinstance(value, str):
        s = value.strip()
        if depth and s[:1] in "{\"" and s:
            try:
                inner = json.loads(s)
            except ValueError:
                return s
            return query_of(inner, depth - 1) if isinstance(inner, dict | str) else s
        return s
    if isinstance(value, dict):
        for key in QUERY_KEYS:
            if isinstance(value.get(key), str | dict) and value[key]:
                return query_of(value[key], depth - 1) if depth else ""
        texts = [v for v in value.values() if isinstance(v, str) and v.strip()]
        return texts[0].strip() if len(texts) == 1 else ""
    return ""


@F.pandas_udf(T.StringType())
def normalized_argument(column: pd.Series) -> pd.Series:
    return column.map(lambda s: "" if s is None else query_of(s))


def query_in_prose(text: Column) -> Column:
    """A query in a message: a fenced block, else the paragraph from the first MATCH or CALL; only if it passes preflight."""
    from .guards import preflight

    s = strip(F.coalesce(text, F.lit("")))
    fenced = strip(F.regexp_extract(s, r"(?is)```(?:cypher)?\s*\r?\n(.*?)```", 1))
    chunk = F.coalesce(F.nullif(F.regexp_extract(s, r"(?is)((?:OPTIONAL\s+)?MATCH\b.+)", 1), F.lit("")), F.regexp_extract(s, r"(?is)(\bCALL\b.+)", 1))
    chunk = strip(F.split(F.split(chunk, r"\n\s*\n", 2)[0], "```", 2)[0])
    ok = lambda c: preflight(c) == "ok"
    return F.when(ok(fenced), fenced).when(ok(chunk), chunk).otherwise(F.lit(""))


#: Texts that are made Python texts at a time.
AT_ONCE = 100


@F.arrow_udf(T.StringType())
def compatible(column: pa.Array) -> pa.Array:
    """Texts in normal form KC, which Spark has no function for; null becomes empty. Few of a batch are Python texts at a time, the rest stays Arrow data."""
    made = (pa.array([normalize("NFKC", t or "") for t in column.slice(at, AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(column), AT_ONCE))
    return pa.concat_arrays([pa.array([], pa.string()), *made])


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{BLANK}+|{BLANK}+$", "")


def clean_side_panel(text: Column) -> Column:
    """A job's text line by line, without the panel's own lines."""
    any_of = lambda c, words: c.rlike("|".join(words))
    own = lambda t: any_of(F.lower(t), PANEL_WORDS) | (any_of(t, PANEL_PERSON[0]) & any_of(t, PANEL_PERSON[1])) | t.rlike(f"(?U)^(?:{BLANK}|[·•])*$")
    lines = F.filter(F.transform(F.split(compatible(text), LINE_BREAK), _stripped), lambda t: ~own(t))
    return _stripped(F.array_join(F.transform(lines, lambda t: F.when(t == PANEL_TITLE, "").otherwise(t)), "\n"))


def split_duty(text: Column) -> Column:
    """Struct (duty, requirement): the text before and after the first heading of requirements, the duty without headings of its own."""
    whole = compatible(_stripped(text))
    parts = F.split(whole, "|".join(REQUIREMENT_HEADINGS), 2)
    duty = F.regexp_replace(_stripped(parts[0]), f"(?mU)^(?:{'|'.join(DUTY_HEADINGS)}){AFTER_HEADING}", "")
    found = F.size(parts) == 2
    return F.struct(F.when(found, _stripped(duty)).otherwise(whole).alias("duty"), F.when(found, _stripped(F.get(parts, F.lit(1)))).otherwise(F.lit("")).alias("requirement"))


def repaired_json(s: str | None) -> str | None:
    """JSON text; with missing closing brackets and trailing commas mended; null if that is not enough."""
    if s is None:
        return None
    for mend in (str, _closed):  # what is JSON is not mended
        try:
            return json.dumps(json.loads(mend(s)), ensure_ascii=False)
        except ValueError:
            continue
    return None


#: Texts, the last one perhaps without its end, and brackets.
_JSON_TEXT = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_JSON_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', re.DOTALL)


def _closed(s: str) -> str:
    open_, text = [], False
    for token in _JSON_TOKENS.findall(s):
        c = token[0]
        if c == '"':  # only the last text can lack its end
            text = not _JSON_TEXT.fullmatch(token)
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif open_:
            open_.pop()
    s = s + '"' * text
    s = re.sub(r",\s*$", "", s)
    return re.sub(r",(\s*[}\]])", r"\1", s + "".join(reversed(open_)))


@F.pandas_udf(T.StringType())
def repair_json(column: pd.Series) -> pd.Series:
    return column.map(repaired_json)
