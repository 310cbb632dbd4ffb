"""Salary expressions: a parser of free-form ranges to a monthly amount, and its classes.

The parser tries ordered rules; the first that gives a value wins. A rule whose guard holds but whose
anchored pattern does not match gives none and the next is tried. ``compat`` keeps the sums of the bare
and yearly ranges; ``fixed`` takes their mean and reads the bounds of open amounts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

DAYS, HOURS = 21.75, 8
#: Upper ends of the classes (exclusive) and all labels in order.
CUTS = [3000, 5000, 8000, 10000, 15000, 20000, 30000, 50000]
LABELS = ["3千以下", "3-5千", "5-8千", "8千-1万", "1-1.5万", "1.5-2万", "2-3万", "3-5万", "5万以上"]
NUMBER = r"(\d+\.?\d*)"


def salary_class(amount: Column) -> Column:
    out = F
    for cut, label in zip(CUTS, LABELS, strict=False):
        out = out.when(amount < cut, F.lit(label))
    return out.otherwise(F.lit(LABELS[-1]))


def _group(s: Column, pattern: str, k: int) -> Column:
    """The k-th group of a pattern at the start of s as a number; null without a match."""
    return F.regexp_extract(s, f"^(?:{pattern})", k).try_cast("double")


def _unit(s: Column, pattern: str, k: int) -> Column:
    u = F.regexp_extract(s, f"^(?:{pattern})", k)
    return F.when(u == "万", 10000.0).when(u == "千", 1000.0)


def _rules(s: Column, mode: str) -> tuple[list[Column], list[Column]]:
    def one(pattern: str, factor: float | Column) -> Column:
        return _group(s, pattern, 1) * factor

    def span(pattern: str, factor: float | Column = 0.5) -> Column:
        return (_group(s, pattern, 1) + _group(s, pattern, 2)) * factor

    def when(guard: Column, value: Column) -> Column:
        return F.when(guard, value)

    has = lambda part: F.contains(s, F.lit(part))
    pair, whole = rf"{NUMBER}-{NUMBER}", r"(\d+)-(\d+)"
    dotted = r"([\d.]+)-([\d.]+)(万|千)"
    share = 1 / 12 if mode == "compat" else 1 / 24
    bare = 1 / 12 if mode == "compat" else 0.5
    ten_thousands = s.rlike(r"\d+万")
    bound = F.when(F.contains(s, F.lit("以下")), 0.8).when(F.contains(s, F.lit("以上")), 1.2)
    plain = [
        when(ten_thousands, one(r"(\d+)万", 10000.0)),
        when(~ten_thousands & s.rlike(r"\d+元"), one(r"(\d+)元", 1.0)),
    ]
    if mode == "fixed":
        open_amount = rf"{NUMBER}(万|千|元)(?:以下|以上)"
        unit = F.when(F.regexp_extract(s, f"^(?:{open_amount})", 2) == "元", 1.0).otherwise(_unit(s, open_amount, 2))
        yearly = rf"{NUMBER}(万|千)/年"
        plain = [one(open_amount, unit * bound), one(yearly, _unit(s, yearly, 2) / 12), *plain]
        plain[2] = when(ten_thousands & ~s.rlike(r"\d+-[\d.]+[万千]"), one(rf"{NUMBER}万", 10000.0))
    first = [
        when(has("元/小时"), one(rf"{NUMBER}元/小时", HOURS * DAYS)),
        when(has("元/时"), span(rf"{pair}元/时", HOURS * DAYS / 2)),
        when(has("元/时") & ~s.rlike(rf"{pair}元/时"), one(rf"{NUMBER}元/时", HOURS * DAYS)),
        when(has("元/天"), one(rf"{NUMBER}元/天", DAYS)),
        when(s.rlike(r"\d+-\d+元/天"), span(rf"{pair}元/天", DAYS / 2)),
        when(has("以上/月"), one(rf"{NUMBER}(万|千)以上/月", _unit(s, rf"{NUMBER}(万|千)以上/月", 2))),
        when(has("以上/年"), one(rf"{NUMBER}(万|千)以上/年", _unit(s, rf"{NUMBER}(万|千)以上/年", 2) / 12)),
    ]
    later = [
        span(rf"{dotted}/月", _unit(s, rf"{dotted}/月", 3) / 2),
        when(s.rlike(r"\d+-\d+元/月"), span(rf"{whole}元/月")),
        when(s.rlike(r"\d+-\d+元"), span(rf"{whole}元")),
        *plain,
        span(rf"{dotted}/年", _unit(s, rf"{dotted}/年", 3) * share),
        span(rf"{dotted}(?!/)", _unit(s, rf"{dotted}(?!/)", 3) * bare),
        span(r"([\d.]+)-([\d.]+)K$", 500.0),
        (_group(s, r"([\d.]+)千-([\d.]+)万$", 1) * 1000 + _group(s, r"([\d.]+)千-([\d.]+)万$", 2) * 10000) / 2,
        one(r"([\d.]+)(万|千)(?:以下|以上)/月", _unit(s, r"([\d.]+)(万|千)(?:以下|以上)/月", 2) * bound),
    ]
    return first, later


def _rounded(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def parse_salary(text: Column, mode: str = "compat") -> Column:
    """Monthly amount as an int; null if the text says none."""
    s = strip(text)
    known = s.isNotNull() & ~s.isin("", "nan", "面议")
    parts = F.split(s, "·")

    def values(x: Column) -> Column:
        first, later = _rules(x, mode)
        return F.struct(F.coalesce(*first).alias("first"), F.coalesce(*later).alias("later"))

    # the rules are the body of a lambda: evaluated once for the text and its part before the dot, outside the generated
    # method, which they would outgrow
    both = F.transform(F.array(s, parts[0]), values)

    def combined(v: Column) -> Column:
        months = F.regexp_extract(F.element_at(parts, -1), r"^(\d+)薪", 1).try_cast("double")
        base = F.when(~parts[0].isin("", "nan", "面议"), _rounded(F.coalesce(v[1]["first"], v[1]["later"])))
        extra = F.when((F.size(parts) == 2) & F.contains(F.element_at(parts, -1), F.lit("薪")), base * months / 12)
        return _rounded(F.coalesce(v[0]["first"], extra, v[0]["later"]))

    return F.when(known, F.transform(F.array(both), combined)[0])


def needs_salary(salary_range: Column, salary_avg: Column) -> Column:
    return salary_range.isNotNull() & (salary_avg.isNull() | (salary_avg == 0))
