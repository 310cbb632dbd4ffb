"""Place expressions: city of a location, canonical province names, location names of the graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed values.
MUNICIPALITIES = ["北京", "上海", "天津", "重庆"]
PROVINCES = {
    **{p: p + "省" for p in "河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 海南 四川 贵州 云南 陕西 甘肃 青海 台湾".split()},
    "内蒙古": "内蒙古自治区",
    "广西": "广西壮族自治区",
    "西藏": "西藏自治区",
    "宁夏": "宁夏回族自治区",
    "新疆": "新疆维吾尔自治区",
    "香港": "香港特别行政区",
    "澳门": "澳门特别行政区",
}
ADDRESS_WORDS = "栋 楼 室 号 路 街 巷 大厦 广场 小区".split()
GENERIC_PLACES = "工作地点 上班地址 办公地点 工作地址".split()
GENERIC_COMPANIES = "公司 本公司 我司 该公司 此公司".split()
UNKNOWN = "未知"


def city_name(location: Column) -> Column:
    """What stands before the first '-' and the first '市'."""
    return strip(F.split(F.split(strip(location), "-")[0], "市")[0])


def clean_full_name(name: Column) -> Column:
    """Canonical province name: quotes away, municipalities without 市, short names completed."""
    s = strip(name)
    for quote in ('"', "'", '"', "'"):
        s = F.regexp_replace(s, f"^{quote}+|{quote}+$", "")
    table = {**{m + "市": m for m in MUNICIPALITIES}, **PROVINCES}
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(name == "", name).otherwise(F.coalesce(F.element_at(known, s), s))


def place_key(name: Column) -> Column:
    """A location's name without its kind."""
    for part in ("市", "省", "自治区", "特别行政区"):
        name = F.replace(name, F.lit(part), F.lit(""))
    return strip(name)


def valid_place(name: Column) -> Column:
    n = strip(F.coalesce(name, F.lit("")))
    return (n != "") & ~n.isin(GENERIC_PLACES) & ~n.rlike("|".join(ADDRESS_WORDS))


def valid_company(name: Column) -> Column:
    n = strip(F.coalesce(name, F.lit("")))
    return (F.length(n) >= 2) & ~n.isin(GENERIC_COMPANIES)
