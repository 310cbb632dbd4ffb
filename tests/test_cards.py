"""Cards of result pages: selectors, the order of fallbacks, and odd pages."""

import pytest

from hireframe.plans import source_queries
from hireframe.sources import cards


def one(html):
    return [c[2:] for c in cards.cards_of(html)]


@pytest.mark.parametrize(
    ("card", "wanted"),
    [
        ('<span class="job-name">Dev &amp; Ops</span><a class="company-name">Co</a><b class="salary">1K</b><i class="job-area">X·Y</i><u class="job-limit">3年<em>本科</em></u>', ("Dev & Ops", "Co", "1K", "X·Y", "3年本科")),
        ('<span class="job-name">D</span><p class="job-title">Engineer</p><a ka="x_job_1">other</a>', ("Engineer", "", "", "", "")),
        ('<span class="job-name"> </span><a ka="x_job_1">Linked</a>', ("Linked", "", "", "", "")),
        ("<a>Plain link</a><a>second</a>", ("Plain link", "", "", "", "")),
        ('<a>x</a><div class="job-info">  Two words </div>', ("Two", "", "", "", "")),
        ('<div class="company-name"></div><div class="company-text"> </div><div class="brand-name">B</div><div class="area">A1</div><span class="job-name">Name</span>', ("Name", "B", "", "A1", "")),
        ('<div class="job-area"></div><div class="job-location">L</div><span class="job-name">Name</span><script>var x = "no text";</script>', ("Name", "", "", "L", "")),
        ('<div class="deep"><p class="company-name">one<br>two<span> three</span></p></div><a class="job-name"><b>Bold</b> name', ("Bold name", "one two three", "", "", "")),
    ],
)
def test_fields(card, wanted):
    for page in ('<ul class="rec-job-list"><li class="job-card-box">{}</li></ul>', '<div class="job-card-wrapper">{}</div>', '<div class="job-list-box"><ul><li>{}</li></ul></div>', '<p class="job-item">{}'):
        if page.startswith("<p") and ("<p" in card or "<div" in card):
            continue
        assert one(page.format(card)) == [wanted], page


def test_card_selectors_in_order():
    both = '<ul><li class="job-card-box"><a>outside</a></li></ul><ul class="a rec-job-list"><li class="job-card-box"><a>inside</a></li></ul><div class="job-primary"><a>later</a></div>'
    assert [c[0] for c in one(both)] == ["inside"]
    assert [c[0] for c in one(both.replace("rec-job-list", "list"))] == ["outside", "inside"]
    assert [c[0] for c in one(both.replace("rec-job-list", "list").replace("job-card-box", "box"))] == ["later"]
    assert [c[0] for c in one("<ul><li><a>one</a><li><a>two</a><ul><li><a>three</a></ul></ul>")] == ["one", "two", "three"]


def test_limits_and_places():
    many = "".join(f'<li class="job-card-box"><a>{"x" if i == 3 else f"job {i}"}</a></li>' for i in range(50))
    got = list(cards.cards_of(f"<ul>{many}</ul>"))
    assert [c[0] for c in got] == [i for i in range(30) if i != 3]  # the first thirty, a nameless one among them
    assert got[0][1] == "job 0__"


def test_odd_pages(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "no cards < here", "a"), (4, "<li><a>café</a></li><li></li>", "a"), (4, "<li><a>café</a></li><li></li>", "a")]
    df = spark.createDataFrame(rows, "page_id long, html string, name string")
    got = cards.page_cards(df).select("page_id", "name", "idx", "`岗位名称`").collect()
    assert sorted(tuple(r) for r in got) == [(4, "a", 0, "café")] * 2
    assert cards.page_cards(df.limit(0)).count() == 0
    deep = "<div>" * 5000 + '<div class="job-item"><a>deep one</a></div>'
    assert one(deep) == [("deep one", "", "", "", "")]


def test_all_cards_of_a_long_page(spark):
    """a card beyond the thirtieth is a row; the crawler's cut is only for callers who name it."""
    many = "".join(f'<li class="job-card-box"><a>job {i}</a></li>' for i in range(75))
    df = spark.createDataFrame([(1, f"<ul>{many}</ul>"), (2, "<li><a>one</a></li>")], "page_id long, html string")
    got = cards.page_cards(df).select("page_id", "idx", "`岗位名称`").collect()
    assert sorted(tuple(r) for r in got) == [*((1, i, f"job {i}") for i in range(75)), (2, 0, "one")]
    cut = cards.page_cards(df, most=cards.MOST_CARDS).select("page_id", "idx").collect()
    assert sorted(tuple(r) for r in cut) == [*((1, i) for i in range(30)), (2, 0)]


def test_result_cards_has_every_order(spark, tmp_path):
    """40 orders a page are 40 cards."""
    rows = [(k, 7, "O", 12.5, "1-URGENT") for k in range(120)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = source_queries.s10_cards(spark, str(tmp_path)).select("page", "idx").collect()
    short = {k for k in range(80, 120) if k % 7 == 0}  # the third layout's names of one letter
    assert sorted(tuple(r) for r in got) == [(k // 40, k % 40) for k in range(120) if k not in short]


def test_cards_within_cards():
    """A field is looked for below its card only, cards inside it among that; a page of many nested cards takes no square of time."""
    page = '<a>before</a><div class="job-item"><b class="salary">1K</b><div class="job-item"><a>inner</a><i class="area">X</i></div><a>last</a></div><a>after</a><div class="job-item"></div>'
    assert list(cards.cards_of(page)) == [(0, "inner__X", "inner", "", "1K", "X", ""), (1, "inner__X", "inner", "", "", "X", "")]
    deep = "".join(f'<div class="job-item"><a>job {i}</a>' for i in range(20000))
    assert [c[2] for c in cards.cards_of(deep, None)] == [f"job {i}" for i in range(20000)]
