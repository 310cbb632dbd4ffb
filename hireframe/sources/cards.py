"""Records of all cards of a result page: a selector matcher over a parsed tree, joined laterally, one row a card.

A page's cards are what the first selector with any match finds; a field is what the first of its selectors gives.
All of them count, however many, unless the caller asks for the first ones only, as the crawler does.
Pages are parsed each by itself, in the rows' own tasks; a null or empty page, and one without cards, gives no row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# Selectors in the order in which they are tried, and how many cards of a page the crawler takes.
CARDS = ["ul.rec-job-list li.job-card-box", "li.job-card-box", ".job-card-wrapper", ".job-list-box li", ".job-primary", ".job-item", "li"]
NAMES = [".job-name", ".job-title", 'a[ka*="job"]', "a"]
NAME_BLOCK = "div.job-info"
COMPANIES = [".company-name", ".company-text", ".brand-name"]
SALARIES = [".salary"]
PLACES = [".job-area", ".job-location", ".area"]
LIMITS = [".job-limit"]
MOST_CARDS, LEAST_NAME = 30, 2

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What a tag's start ends if it is open, and within which tags it stays open.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"div", "li", "td", "article", "section"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td"}, {"tr"})}


class Element:
    __slots__ = ("tag", "attributes", "classes", "parent", "content", "place")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, place: int):
        self.tag, self.attributes, self.parent, self.place = tag, attributes, parent, place
        self.classes = set(attributes.get("class", "").split())
        self.content: list[Element | str] = []

    def text(self) -> str:
        """All text below, white space collapsed; a line break parts words, scripts and styles have none."""
        out, waiting = [], [self]
        while waiting:
            one = waiting.pop()
            if isinstance(one, str):
                out.append(one)
            elif one.tag == "br":
                out.append(" ")
            elif one.tag not in ("script", "style"):
                waiting.extend(one.content[::-1])
        return " ".join("".join(out).split())


class Tree(HTMLParser):
    """Elements in page order; an element's place is its index there, the root has none."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.at = Element("", {}, None, -1)
        self.feed(html)
        self.close()

    def add(self, tag, attrs) -> Element:
        element = Element(tag, {k: v or "" for k, v in attrs}, self.at, len(self.elements))
        self.elements.append(element)
        self.at.content.append(element)
        return element

    def handle_starttag(self, tag, attrs):
        ends, inside = CLOSES.get(tag, ((), ()))
        one = self.at
        while ends and one.parent is not None and one.tag not in inside:
            if one.tag in ends:
                self.at = one.parent
                break
            one = one.parent
        element = self.add(tag, attrs)
        if tag not in VOID:
            self.at = element

    def handle_startendtag(self, tag, attrs):
        self.add(tag, attrs)

    def handle_endtag(self, tag):
        one = self.at
        while one.parent is not None:
            if one.tag == tag:
                self.at = one.parent
                return
            one = one.parent

    def handle_data(self, data):
        self.at.content.append(data)


class Selector:
    """Compounds of a tag, classes and attributes that contain a value, each below the one before."""

    def __init__(self, source: str):
        self.parts = []
        for part in source.split():
            tag = re.match(r"[\w-]*", part)[0]
            self.parts.append((tag, set(re.findall(r"\.([\w-]+)", part)), re.findall(r'\[([\w-]+)\*="([^"]*)"\]', part)))

    @staticmethod
    def fits(element: Element, part) -> bool:
        tag, classes, attributes = part
        return (not tag or element.tag == tag) and classes <= element.classes and all(v in element.attributes.get(k, "") for k, v in attributes)

    def matches(self, element: Element) -> bool:
        if not self.fits(element, self.parts[-1]):
            return False
        left, above = len(self.parts) - 1, element.parent
        while left and above is not None:
            left -= self.fits(above, self.parts[left - 1])
            above = above.parent
        return not left


class Page:
    """A page's elements by class and tag, and what each selector finds, looked up once for all cards of the page."""

    def __init__(self, html: str):
        self.elements = Tree(html).elements
        self.named, self.known = defaultdict(list), {}
        # those below an element stand right after it, up to its end
        self.ends = list(range(1, len(self.elements) + 1))
        for e in self.elements:
            self.named[e.tag].append(e)
            for c in e.classes:
                self.named["." + c].append(e)
        for e in reversed(self.elements):
            if e.parent.place >= 0:
                self.ends[e.parent.place] = max(self.ends[e.parent.place], self.ends[e.place])

    def places(self, selector: str) -> list[int]:
        """Places of the elements that match, in page order."""
        if selector not in self.known:
            one = _SELECTORS[selector]
            tag, classes, _ = one.parts[-1]
            name = "." + min(classes) if classes else tag
            likely: Iterable[Element] = self.named.get(name, ()) if name else self.elements
            self.known[selector] = [e.place for e in likely if one.matches(e)]
        return self.known[selector]

    def first(self, selector: str, card: int) -> Element | None:
        """The first match below the element at this place."""
        places = self.places(selector)
        k = bisect_right(places, card)
        return self.elements[places[k]] if k < len(places) and places[k] < self.ends[card] else None


_SELECTORS = {s: Selector(s) for s in [*CARDS, *NAMES, NAME_BLOCK, *COMPANIES, *SALARIES, *PLACES, *LIMITS]}


def first_text(page: Page, card: int, selectors: list[str], least: int) -> str:
    """Text of the first selector whose first match has at least ``least`` characters; else what was seen last."""
    seen = ""
    for s in selectors:
        found = page.first(s, card)
        if found is not None:
            seen = found.text()
            if len(seen) >= least:
                break
    return seen


def cards_of(html: str | None, most: int | None = MOST_CARDS) -> Iterator[tuple]:
    """(idx, id, name, company, salary, place, limit) of a page's first ``most`` cards, None: of all; a card without a name is left out."""
    if not html:
        return
    page = Page(html)
    found = next(filter(None, map(page.places, CARDS)), [])
    for idx, card in enumerate(found[:most]):
        name = first_text(page, card, NAMES, LEAST_NAME)
        if len(name) < LEAST_NAME:
            block = page.first(NAME_BLOCK, card)
            words = block.text().split() if block is not None else []
            name = words[0] if words else name
        if len(name) < LEAST_NAME:
            continue
        company, salary, place, limit = (first_text(page, card, s, 1) for s in (COMPANIES, SALARIES, PLACES, LIMITS))
        yield idx, f"{name}_{company}_{place}", name, company, salary, place, limit


@F.udtf(returnType="`idx` int, `职位ID` string, `岗位名称` string, `公司名称` string, `薪资范围` string, `工作地点` string, `工作经验` string")
class PageCards:
    def eval(self, html: str, most: int):
        yield from cards_of(html, most)


def page_cards(pages: DataFrame, html: str = "html", most: int | None = None) -> DataFrame:
    """pages with one row a card and its fields; of all cards, or of a page's first ``most``."""
    ship(pages.sparkSession)
    return pages.lateralJoin(PageCards(F.col(f"`{html}`").outer(), F.lit(most).cast("int")))
