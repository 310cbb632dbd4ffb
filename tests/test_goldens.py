"""Golden vectors of the scalar operators."""

import pytest
from pyspark.sql import functions as F

from hireframe.functions import dialogue, geo, guards, salary, text


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


SALARIES = [
    (None, None), ("", None), ("nan", None), ("面议", None), ("21元/小时", 3654), ("10-25元/时", 3045), ("300元/时", 52200), ("200元/天", 4350), ("150-200元/天", 3806),
    ("10万以上/月", 100000), ("100万以上/年", 83333), ("20-30K·15薪", 31250), ("1.5-2.5万·13薪", 3611), ("8000-16000元·13薪", 13000), ("面议·13薪", None), ("1.1-1.8万/月", 14500),
    ("10000-15000元/月", 12500), ("6000-10000元", 8000), ("20-30元/小时", 25), ("1万", 10000), ("2万以下/月", 20000), ("20万/年", 200000), ("5000元", 5000), ("1000元以下", 1000),
    ("15-25万/年", 33333), ("1.5-3万", 3750), ("3-4K", 3500), ("8千-1.6万", 12000), ("1.5千以下/月", 1200), ("1.5万以下/月", 12000), ("1.5万", None), ("8千/月", None), ("5千-1万/月", None), ("3-4k", None),
    ("2-3元", 2), ("3-4元", 4), ("约10-25元/时", None), ("1..5-2万/月", None),
]


def test_salary_compat(spark):
    assert apply(spark, [s for s, _ in SALARIES], salary.parse_salary) == [v for _, v in SALARIES]


def test_salary_fixed(spark):
    got = apply(spark, ["15-25万/年", "1.5-3万", "1000元以下", "20万/年", "3-4K"], lambda c: salary.parse_salary(c, "fixed"))
    assert got == [16667, 22500, 800, 16667, 3500]


def test_salary_class(spark):
    cuts = {2999: "3千以下", 3000: "3-5千", 4999: "3-5千", 5000: "5-8千", 8000: "8千-1万", 10000: "1-1.5万", 15000: "1.5-2万", 20000: "2-3万", 30000: "3-5万", 50000: "5万以上"}
    assert apply(spark, list(cuts), salary.salary_class, "int") == list(cuts.values())


def test_province(spark):
    pairs = {'"北京市"': "北京", "'上海市'": "上海", '"湖北"': "湖北省", " 河北省 ": "河北省", "内蒙古": "内蒙古自治区", "广西": "广西壮族自治区", "香港": "香港特别行政区", "武汉市": "武汉市", "": "", None: None}
    assert apply(spark, list(pairs), geo.clean_full_name) == list(pairs.values())


def test_province_match(spark):
    from hireframe.operators.listings import match_provinces

    cities = spark.createDataFrame([("上海", "上海", 1), ("北京市", "北京", 2), ("武汉", "湖北省", 3)], "short_name string, full_name string, ord int")
    wanted = {"武汉-江夏区": "湖北省", "北京": "北京", "北京市": "北京", "湖北武汉": "湖北省", "市辖区": "上海", "火星": "未知"}
    rows = spark.createDataFrame([(k,) for k in wanted], "location string")
    assert {r["location"]: r["province"] for r in match_provinces(rows, cities).collect()} == wanted


def test_tokens(spark):
    said = "负责高性能分布式系统的设计开发与维护工作，熟悉Python、Java；了解大数据"
    got = apply(spark, [said], lambda c: F.filter(text.han_runs(c), lambda w: ~w.isin(text.STOP_WORDS)))
    assert got == [["负责高性能分布式系统", "的设计开发与维护工作", "了解大数据"]]


def test_ids_and_titles(spark):
    assert apply(spark, ["123.0", " A1 ", None, "1.50"], text.normalize_id) == ["123", "A1", "", "1.50"]
    assert apply(spark, ["", "a\nb", "x" * 80, "x" * 81], text.session_title) == ["新对话", "a", "x" * 80, "x" * 79 + "…"]
    assert apply(spark, ["", "a", "中文a"], text.token_estimate) == [0, 1, 2]
    assert apply(spark, ["2024.0", "2024.9", "x"], text.to_year) == [2024, 2024, None]
    assert apply(spark, ["武汉"], lambda c: text.hashed_id("Location", c)) == ["Location_ad9efa"]
    assert apply(spark, ["['a', 'b']"], text.list_text) == ["['a b"]


@pytest.mark.parametrize(("parts", "wanted"), [(("武汉", "江夏区", "光谷"), "武汉-江夏区-光谷"), (("武汉", "", "光谷"), "武汉"), (("", "", ""), "全国")])
def test_work_location(spark, parts, wanted):
    assert spark.range(1).select(text.work_location(*map(F.lit, parts))).first()[0] == wanted


def test_merges(spark):
    pair = lambda a, b: tuple(spark.range(1).select(text.merge_description_duty(F.lit(a), F.lit(b)).alias("x")).select("x.*").first())
    assert pair("负责后端", "负责后端 开发") == ("负责后端 开发", "")
    assert pair("", "x") == ("x", "") and pair("a", "b") == ("a", "b")
    blocks = lambda *b: spark.range(1).select(text.drop_contained_blocks(F.array(*map(F.lit, b)))).first()[0]
    assert blocks("A B", "AB", "ABC") == ["ABC"] and blocks("A B", "AB") == ["A B"] and blocks("x", "y") == ["x", "y"]
    assert apply(spark, ["【BOSS直聘】招聘", None], text.strip_brand_noise) == ["【】招聘", ""]


def test_dialogue(spark):
    said = ["岗位职责：1、写代码\n任职要求：本科", " ｗ工作内容 \n工作内容: 2. b\n岗位要求\n任职资格 c ", "no heading", None]
    assert [tuple(r) for r in apply(spark, said, dialogue.split_duty)] == [("写代码", ":本科"), ("w工作内容 \nb", "任职资格 c"), ("no heading", ""), ("", "")]
    said = ["职位描述\n写代码\n李女士 今日活跃\n· •\n举报", "a\u2028 职位描述 \r\n去APP看 \x0bＡ 先生\x85b\x1f", None, " \n"]
    assert apply(spark, said, dialogue.clean_side_panel) == ["写代码", "a\n\nA 先生\nb", "", ""]
    assert dialogue.trimmed_leak('MATCH (n) WHERE n.x = "a" RETURN n"}') == 'MATCH (n) WHERE n.x = "a" RETURN n'
    assert dialogue.query_of('{"query": "{\\"cypher\\": \\"RETURN 1\\"}"}') == "RETURN 1"
    assert dialogue.repaired_json('{"a": [1, 2,') == '{"a": [1, 2]}' and dialogue.repaired_json("nope{") is None


def test_guards(spark):
    assert apply(spark, ["MATCH (n) RETURN n", "match (n) set n.x=1", "MATCH (n) WHERE n.name='set' RETURN n"], guards.is_readonly) == [True, False, False]
    said = ["", "RETURN", "MATCH (n) DELETE n", "SHOW DATABASES", "RETURN 1; RETURN 2", "RETURN 1;  "]
    assert apply(spark, said, guards.preflight) == ["参数错误", "参数错误", "安全拒绝", "语法预检", "语法预检", "ok"]
