"""Text expressions: cleaning, comparison, coercion. All stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brand strings in the order they are removed, then what crawling leaves of them (pattern, replacement).
BRAND_STRINGS = ["BOSS直聘", "Boss直聘", "boss直聘", "BOSS 直聘", "【BOSS直聘】", "[BOSS直聘]"]
BRAND_REMAINS = [(r"(?i)上直聘|用直聘|下载\s*BOSS|打开\s*BOSS直聘", ""), (r"(?i)(?<![A-Za-z])BOSS(?![A-Za-z])", ""), (r"(^|[\s，,。.；;：:])直聘($|[\s，,。.；;：:])", "$1$2"), (r"(?m)^\s*直聘\s*$", "")]
# What every rule above needs in a text.
BRAND_HINT = "[Bb][Oo][Ss][Ss]|直聘"
# Characters of a url, and of a site's token before and after its word.
URL_REST, TOKEN_HEAD, TOKEN_TAIL = r"[^\s)\]\"']*", "[a-z0-9.-]", "[a-z0-9./?#&=%-]"
# Description keys of the list API, best first.
DESCRIPTION_KEYS = ["jobDesc", "postDescription", "jobDescription", "encryptJobDesc"]


#: White space of Unicode.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of Unicode at both ends; only the ends are read."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of blanks to one space, of line ends to two, ends stripped."""
    blanks = lambda t: F.when(t.rlike(r"[ \t\r\f\x0B]{2}"), F.regexp_replace(t, r"[ \t\r\f\x0B]{2,}", " ")).otherwise(t)
    ends = lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    return strip(bound(bound(c, blanks), ends))


def rewritten(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The text after each rule (pattern, replacement) in turn."""
    return reduce(lambda text, rule: F.regexp_replace(text, F.lit(rule[0]), F.lit(rule[1])), rules, c)


def strip_brand_noise(c: Column) -> Column:
    """Without the site's brand and what crawling left of it; null becomes empty. Texts without a hint of it are copied by no rule."""
    rules = [(re.escape(s), "") for s in BRAND_STRINGS] + BRAND_REMAINS
    return squeeze(bound(F.coalesce(c, F.lit("")), lambda t: F.when(t.rlike(BRAND_HINT), rewritten(t, rules)).otherwise(t)))


def strip_domain_noise(c: Column, word: str = "kanzhun") -> Column:
    """Removes urls, domain tokens and mentions of one site; null becomes empty."""
    url = rf"(?i)https?://{URL_REST}{word}{URL_REST}"
    # a token begins where its characters begin: what stands within one need not be tried again
    token = rf"(?i)(?<!{TOKEN_HEAD}){TOKEN_HEAD}*{word}{TOKEN_TAIL}*"
    return squeeze(bound(F.coalesce(c, F.lit("")), lambda t: F.when(t.rlike(f"(?i){word}"), rewritten(t, [(url, ""), (token, "")])).otherwise(t)))


def comparison_key(c: Column) -> Column:
    """All white space deleted."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it within lambdas."""
    return F.transform(F.array(value), body)[0]


def merge_description_duty(desc: Column, duty: Column) -> Column:
    """Struct (description, duty): one text where one repeats the other, else both."""
    pair = lambda a, b: F.struct(a.alias("description"), b.alias("duty"))

    def merged(x: Column) -> Column:
        d, r = x["d"], x["r"]
        one = (d == "") | (r == "") | F.contains(x["nd"], x["nr"]) | F.contains(x["nr"], x["nd"])
        return F.when(one, pair(F.when(F.length(d) >= F.length(r), d).otherwise(r), F.lit(""))).otherwise(pair(d, r))

    keyed = lambda x: bound(F.struct(x["d"].alias("d"), x["r"].alias("r"), comparison_key(x["d"]).alias("nd"), comparison_key(x["r"]).alias("nr")), merged)
    return bound(F.struct(strip_brand_noise(desc).alias("d"), strip_brand_noise(duty).alias("r")), keyed)


def drop_contained_blocks(blocks: Column) -> Column:
    """Blocks that are no part of another one (white space apart); of equal ones the first."""

    def outer(a: Column) -> Column:
        return F.filter(a, lambda x: ~F.exists(a, lambda y: (y["n"] != x["n"]) & F.contains(y["n"], x["n"])))

    def first(a: Column) -> Column:
        return F.transform(F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["n"] == x["n"])), lambda x: x["b"])

    named = F.filter(F.transform(blocks, lambda b: F.struct(b.alias("b"), comparison_key(b).alias("n"))), lambda x: x["n"] != "")
    return bound(bound(named, outer), first)


def merge_blocks(*parts: Column, word: str = "kanzhun") -> Column:
    """The parts, cleaned, without contained ones, separated by an empty line."""
    return F.array_join(drop_contained_blocks(F.array(*[strip_domain_noise(p, word) for p in parts])), "\n\n")


def append_unless_contained(existing: Column, more: Column, separator: str = "\n") -> Column:
    m = strip(more)
    return F.when(F.coalesce(existing, F.lit("")) == "", m).when(F.coalesce(m, F.lit("")) == "", existing).when(F.contains(existing, m), existing).otherwise(F.concat(existing, F.lit(separator), m))


def strip_css_rules(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"\.[a-zA-Z0-9_-]+\s*\{[^}]*\}", ""), r"\s+", " "))


def normalize_id(c: Column) -> Column:
    """Null to empty; stripped; a spreadsheet's trailing '.0' of a whole number dropped."""
    s = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(s.rlike(r"^\d+\.0$"), s.substr(F.lit(1), F.length(s) - 2)).otherwise(s)


def clipped(c: Column, most: int | None = None) -> Column:
    """Stripped; blank and 'nan' to null; cut to a length."""
    s = strip(c.cast("string"))
    s = F.when((s == "") | (F.lower(s) == "nan"), F.lit(None).cast("string")).otherwise(s)
    return s if most is None else F.left(s, F.lit(most))


def to_year(c: Column) -> Column:
    """Whole part of a number in text; null if it is none."""
    return c.try_cast("double").try_cast("int")


def year_or_date(year: Column, created: Column) -> Column:
    """year, or (if null or 0) the year of a yyyy-MM-dd prefix of created."""
    from_date = F.year(F.left(created.cast("string"), F.lit(10)).try_cast("date"))
    return F.coalesce(F.nullif(year.cast("int"), F.lit(0)), from_date)


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def work_location(city: Column, district: Column, business: Column, default: str = "全国") -> Column:
    c, d, b = (F.coalesce(x, F.lit("")) for x in (city, district, business))
    whole = F.when(c != "", c).otherwise(F.lit(default))
    return F.when((d != "") & (b != ""), F.concat_ws("-", c, d, b)).when(d != "", F.concat_ws("-", c, d)).otherwise(whole)


def surrogate_id(key: Column, title: Column, company: Column, city: Column, position: Column) -> Column:
    """The id, or title_company_city, or (all empty) job_position."""
    joined = F.concat_ws("_", *[F.coalesce(x, F.lit("")) for x in (title, company, city)])
    k = F.coalesce(key, F.lit(""))
    return F.when((k != "") & (k != "None"), k).when(joined != "__", joined).otherwise(F.concat(F.lit("job_"), position.cast("string")))


def list_text(c: Column) -> Column:
    """Text of a printed list of strings."""
    t = F.coalesce(c, F.lit(""))
    for old, new in (("[', '", ""), ("', '", " "), ("']", "")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return strip(t)


def supplement_header(company: Column, location: Column, title: Column, year: Column, body: Column) -> Column:
    """Known facts, one a line, before the text."""
    fact = lambda label, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}："), c.cast("string")))
    head = F.concat_ws("\n", fact("公司名称", company), fact("工作地点", location), fact("职位名称", title), fact("年份", F.nullif(year, F.lit(0))))
    return F.when(head != "", F.concat(head, F.lit("\n\n"), body)).otherwise(body)


def batch_piece(title: Column, company: Column, year: Column, body: Column) -> Column:
    """A document's part of a batch prompt."""
    head = F.concat(F.lit("=== 职位 "), title, F.lit(" (公司: "), company, F.lit(") ===\n"))
    line = F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit("年份: "), year.cast("string"), F.lit("\n")))
    return F.concat_ws("\n", head, line, body, F.lit("\n\n"))


def hashed_id(kind: str, name: Column, digits: int = 6) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.left(F.md5(name.cast("binary")), F.lit(digits)))


def fingerprint(c: Column, digits: int = 16) -> Column:
    return F.when(c == "", F.lit("")).otherwise(F.left(F.sha2(c.cast("binary"), 256), F.lit(digits)))


def session_title(question: Column, default: str = "新对话", most: int = 80) -> Column:
    line = strip(F.split(strip(F.coalesce(question, F.lit(""))), "\n", 2)[0])
    return F.when(line == "", F.lit(default)).when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))).otherwise(line)


def preview(c: Column, most: int, suffix: str = "…") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(suffix))).otherwise(c)


def token_estimate(c: Column, divisor: float = 3.0) -> Column:
    n = F.octet_length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(max(divisor, 0.5))).cast("int")))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")


def search_url(keyword: Column, base: str = "https://www.zhipin.com/web/geek/jobs?query=", city: str = "100010000") -> Column:
    return F.concat(F.lit(base), F.replace(F.url_encode(keyword), F.lit("+"), F.lit("%20")), F.lit(f"&city={city}"))


def id_from_url(url: Column) -> Column:
    """The job id of a detail url."""
    return F.nullif(F.regexp_extract(url, r"job_detail/([^./?#]+)", 1), F.lit(""))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def rank_tier(rank: Column) -> Column:
    """Tier of a rank from 1: 10, 30, 50, rest."""
    return F.when(rank <= 10, "danger").when(rank <= 30, "warning").when(rank <= 50, "success").otherwise("info")


def han_runs(c: Column, least: int = 2, most: int = 10) -> Column:
    """Maximal runs of Han characters, cut into pieces of least to most."""
    return F.regexp_extract_all(c, F.lit(f"[一-龥]{{{least},{most}}}"), F.lit(0))


# Words that are not counted.
STOP_WORDS = (
    "的 了 和 是 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 "
    "年 月 日 时 分 秒 个 条 项 种 类 等 及 或 与 为 以 在 有 能 可 会 需 要 应 "
    "具备 具有 拥有 掌握 熟悉 了解 负责 完成 参与 协助 支持 工作 经验 能力 技能 知识 学历 专业 "
    "优先 加分 要求 条件 以上 以下 左右 至少 相关 相关专业 相关经验"
).split()


# Where a page's section of requirements ends.
SECTION_ENDS = "工作地址|公司地址|联系方式"


def page_sections(c: Column) -> Column:
    """Struct (duty, requirement) of a page's whole text, by their headings; empty where a heading is missing."""
    duty = F.regexp_extract(c, rf"(?s)职责[：:]*(.*?)(?:要求|任职|地址|联系方式|\z)", 1)
    need = F.regexp_extract(c, rf"(?s)任职要求[：:]*(.*?)(?:{SECTION_ENDS}|\z)", 1)
    return F.struct(strip(duty).alias("duty"), strip(need).alias("requirement"))


def merged_maps(*maps: Column) -> Column:
    """Union of maps; of equal keys the last map's value."""

    def both(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)

    return reduce(both, maps)


def page_offset(page: Column, size: int) -> Column:
    return (F.greatest(page, F.lit(1)) - 1) * size


def stamp(c: Column) -> Column:
    """A time without fractions of a second, as text."""
    return F.date_format(F.date_trunc("second", c.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
