"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged: a node of the style tree is a path of elements (tag and class
names, and whether the markup speaks against it). For each node the presentations (the tags of its children)
and the contents (its text outside links) are counted over the host's pages, pages of one text only once. The
importance of a node is the entropy of its contents and presentations, scaled to 0..1 by the number of pages
that have it: a branch that reads the same on nearly every page has an importance near 0, and so has a menu,
whose text is all links. Where the markup speaks against a branch (tags and names of menus, headers, footers,
sidebars, notices, adverts, forms or comments; or it stands beside the page's articles or main element) entropy
alone cannot tell an advert or a footer that differs from page to page from an article; how much of the pages'
text outside links the branch holds can. One that holds at least half of it, over the host's pages, is what the
pages are about, whatever its name: it keeps its importance. Of any other it is a tenth, and of comments, too,
which may be longer than what they comment on. Of a node that fewer than ``MIN_PAGES`` pages have, only the
markup tells. Branches of low importance are removed from each page of the host, those within articles too.
So the markup's word is overruled in both directions: an unnamed strap goes, a story in a box named like a
widget, or beside the teasers that are the page's only articles, stays.

Not removed for its entropy: a branch that holds over half of the page's body text (the text of paragraphs,
headings, lists and tables outside links, or where there is none all text outside links), as several pages may
carry copies of one text; paragraphs, headings, lists and tables themselves; what contains an article.

A host with fewer than ``MIN_PAGES`` different pages has no style tree: there the markup alone decides.
Scripts, styles, controls and hidden elements are never text.

The statistics are shuffled once by host and text of the page (a hot host is spread over all tasks, and copies
are combined before), then counted per (node, hash), summed before they are shuffled. The removed nodes reach
the pages as one sorted array of hashes, eight bytes each, broadcast while there are at most
``BROADCAST_NODES``; beyond, pages and the lists of their hosts are joined, hot hosts dealt over salts.

Defined results: null or empty html gives an empty text; broken, unclosed or cut markup is read as far
as it goes; a null url belongs to the empty host; repeated rows give repeated results; texts of any
length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import absent, add_by_block, columns, hot_keys, slices, spread_join, table, written
from .url_filter import url_host

#: A node is judged by entropy if so many pages of the host have it, and removed below this importance.
MIN_PAGES, MIN_IMPORTANCE, CONTENT_SHARE = 8, 0.15, 0.9
#: What the markup's word against a node leaves of its importance, unless it holds so many thousandths of the pages' text.
AGAINST, HELD = 0.1, 500
#: So many removed nodes at most are broadcast (eight bytes each).
BROADCAST_NODES = 2_000_000

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noframes noembed".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "thead": set(), "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = set("html body table td th ul ol dl button select article section div main aside nav footer header form blockquote".split())
BODY_TEXT = set("p h1 h2 h3 h4 h5 h6 li ul ol pre blockquote dl dt dd table thead tbody tr td th figure figcaption".split())

# Elements whose text a reader does not see, and elements and names that the markup speaks against.
UNSEEN_TAGS = set("head script style noscript template button select textarea iframe svg object embed input option audio video canvas".split())
DROP_TAGS = set("nav header footer aside form dialog menu".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_NAMES = set(
    "ad ads adv advert adverts advertisement advertising advertorial adbox adsense banner sponsor sponsored promo promotion promoted "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail widget widgets header masthead topbar footer colophon copyright "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond reply replies discussion related recommended recommendations share sharing social toolbar pagination pager".split()
)
COMMENT_NAMES = set("comment comments commentlist disqus respond reply replies discussion".split())
# Elements of an article that may hold its comments.
CONTAINERS = set("section ul ol dl table blockquote".split())
BESIDE = set("has with without no is".split())
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+)")
NAMES = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(100_000)
def step_hash(above: int, label: str) -> int:
    """Names the style tree's node under the node ``above``."""
    return _hash(f"{above}>{label}")


class Node:
    __slots__ = ("tag", "names", "parts", "classes", "within", "holds", "role", "unseen", "parent", "children", "label", "path", "against", "framing")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.parent, self.children = tag, parent, []
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        self.classes = set(found.get("class", "").split())
        self.names = set((found.get("class", "") + " " + found.get("id", "")).split())
        # "nav-bar" names a menu, "has-sidebar" something beside one
        self.parts = {p for n in self.names for k in [re.split("[_-]+", n)] if k[0] not in BESIDE for p in k}
        self.holds = False
        if tag in ("article", "main"):
            up = parent
            while up is not None and not up.holds:
                up.holds, up = True, up.parent
        self.role = found.get("role", "")
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main") or parent.role in ("article", "main"))
        hidden = bool(re.search(r"display\s*:\s*none", found.get("style", ""))) or bool(re.search(r"(?i)(?:^|\s)hidden(?:\s|=|/|$)", attributes))
        self.unseen = hidden or tag in UNSEEN_TAGS
        self.label = tag + "".join("." + x for x in sorted(set(NAMES.findall(found.get("class", "")))))
        self.path, self.against, self.framing = 0, False, False

    def named(self) -> bool:
        """Whether tag, role or names speak against the element."""
        if self.tag in ("html", "body", "main"):
            return False
        if self.tag in DROP_TAGS or self.role in DROP_ROLES:
            return True
        if self.within and (self.tag in BODY_TEXT or self.tag == "section"):
            # ids are made from titles here, "discussion" among them; a container of comments goes all the same
            told = COMMENT_NAMES - {"discussion"} if self.tag in CONTAINERS else set()
            parts = {p for n in self.classes for p in re.split("[_-]+", n)}
            return not DROP_NAMES.isdisjoint(self.classes) or not told.isdisjoint(self.names | parts)
        if not DROP_NAMES.isdisjoint(self.names):
            return True
        # a part of a name decides only where no article is at stake, but for comments
        told = COMMENT_NAMES if self.holds or self.tag == "article" else DROP_NAMES
        return not told.isdisjoint(self.parts)

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str) and not c.unseen]


def parse(source: str) -> Node:
    """The element tree; children are nodes and strings with their references decoded."""
    root = node = Node("#root")
    at, size = 0, len(source)
    while at < size:
        cut = source.find("<", at)
        cut = size if cut < 0 else cut
        if cut > at:
            node.children.append(entities.unescape(source[at:cut]))
        found = MARKUP.match(source, cut) if cut < size else None
        if not found:
            if cut < size:
                node.children.append("<")
            at = cut + 1
            continue
        at = found.end()
        cdata, slash, tag, attributes = found.groups()
        if cdata is not None:
            node.children.append(cdata)
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            up = node
            while up is not root and up.tag != tag:
                # an inline end tag does not close the block it stands in
                if tag in INLINE and up.tag not in INLINE:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in CLOSES_P:
            node = _close(root, node, {"p"})
        elif tag in CLOSES:
            node = _close(root, node, CLOSES[tag])
        made = Node(tag, attributes, node)
        node.children.append(made)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            body, at = source[at : end.start() if end else size], end.end() if end else size
            made.children.append(body)
        elif tag not in VOID:
            node = made
    return root


def _close(root: Node, node: Node, tags: set[str]) -> Node:
    """Closes the nearest open element of these tags, if it is in scope."""
    up = node
    while up is not root:
        if up.tag in tags:
            return up.parent
        if up.tag in SCOPE - tags:
            return node
        up = up.parent
    return node


def page_tree(source: str, host: int = 0) -> Node:
    """The element tree with its paths, which begin with the host, and what the markup speaks against.

    The outermost articles frame the page's text, or else its main elements: what stands beside them is spoken against.
    """
    root = parse(source)
    parts: list[Node] = []
    for wanted in ("article", "main"):
        todo = [root]
        while todo and not (wanted == "main" and parts):
            top = todo.pop()
            if top.tag == wanted or top.role == wanted:
                parts.append(top)
            else:
                todo += [c for c in top.elements() if not c.named()]
    for part in parts:
        up = part.parent
        while up is not None and not up.framing:
            up.framing, up = True, up.parent
    inside = {id(p) for p in parts}
    root.path = host
    todo = [(root, not parts)]
    while todo:
        top, within = todo.pop()
        for child in top.elements():
            framed = within or id(child) in inside
            child.against = id(child) not in inside and not child.framing and (not framed or child.named())
            child.path = step_hash(top.path, child.label + "!" * child.against)
            todo.append((child, framed))
    return root


def blocks(root: Node, removed: set[int] | None) -> list[str]:
    """Texts of the blocks of a page, in page order; removed: None to go by the markup alone."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = SPACES.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    stack = [(root, iter(root.children))]
    while stack:
        top, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                if not top.framing:
                    line.append(child)
                continue
            if child.tag == "br" or child.tag == "wbr":
                line.append(" " if child.tag == "br" else "")
                continue
            if child.unseen or (child.against if removed is None else child.path in removed):
                if child.tag not in INLINE:
                    end()
                continue
            if child.tag not in INLINE:
                end()
            stack.append((child, iter(child.children)))
            break
        else:
            if top.tag not in INLINE:
                end()
            stack.pop()
    end()
    return out


def judged(node: Node) -> bool:
    """Whether the style tree may remove the node."""
    return node.against or not (node.framing or node.tag in ("#root", "html", "body", "article", "main") or node.tag in BODY_TEXT or node.tag in INLINE)


def body_paths(root: Node, gone: set[int]) -> set[int]:
    """Paths of the branches that hold over half of the page's body text, outside those that are spoken against and gone."""
    # lengths of the text in BODY_TEXT elements and of all text, both outside links
    held: dict[int, list[int]] = {}
    stack = [(root, False, [0, 0], iter(root.children))]
    while True:
        top, told, sums, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                n = len("".join(child.split())) * (not top.framing)
                sums[0] += n * told
                sums[1] += n
            elif child.tag != "a" and not child.unseen and not (child.against and child.path in gone):
                stack.append((child, told or child.tag in BODY_TEXT, [0, 0], iter(child.children)))
                break
        else:
            stack.pop()
            if not stack:
                break
            for into in (stack[-1][2], held.setdefault(top.path, [0, 0])):
                into[0] += sums[0]
                into[1] += sums[1]
    kind = 0 if sums[0] else 1
    return {p for p, n in held.items() if 2 * n[kind] > sums[kind]}


class Removed:
    """The removed nodes of all hosts in one sorted array; a host with a style tree has a mark in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)

    def among(self, paths: list[int]) -> set[int]:
        found = np.array(paths, np.int64)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return set(found[self.keys[at] == found].tolist()) if len(self.keys) else set()


def tree_mark(host: int) -> int:
    return step_hash(host, "#tree")


def extract(source: str, removed: Removed | None = None, host: int = 0) -> str:
    """The main text of a page; removed: the nodes that the hosts' style trees remove (None: no host has one)."""
    if not source:
        return ""
    root = page_tree(source, host)
    gone = None
    if removed is not None and removed.among([tree_mark(host)]):
        paths, todo = [], [root]
        while todo:
            top = todo.pop()
            paths.append(top.path)
            todo += top.elements()
        gone = removed.among(paths)
        if gone:
            gone -= body_paths(root, gone)
    return "\n\n".join(blocks(root, gone))


#: Kinds of the style tree's entries: what the markup says nothing of, what it speaks against, and the mark that tells a host's tree.
PLAIN, SPOKEN, MARK = range(3)


def style_counts(source: str, host: int = 0) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Hash of the page's text, and (path, hash of its content, hash of its presentation, kind, share) of the nodes that may be removed and of the mark.

    share: thousandths of the page's text outside links that a node holds which is spoken against, but not as comments; else 0.
    """
    root = page_tree(source, host)
    said: list[str] = []  # text outside links, in page order
    spans: dict[int, list[tuple[int, int]]] = {}
    styles: dict[int, list[str]] = {}
    kinds: dict[int, int] = {}
    weighed: set[int] = set()
    stack = [(root, 0, iter(root.children))]
    while stack:
        top, start, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                if words := "".join(child.split()):
                    said.append(words)
            elif child.unseen:
                continue
            elif child.tag != "a" or child.against:
                stack.append((child, len(said), iter(child.children if child.tag != "a" else [])))
                break
        else:
            stack.pop()
            if judged(top):
                spans.setdefault(top.path, []).append((start, len(said)))
                styles.setdefault(top.path, []).append(",".join(c.tag for c in top.elements()))
                kinds[top.path] = SPOKEN if top.against else PLAIN
                if top.against and COMMENT_NAMES.isdisjoint(top.names | top.parts):
                    weighed.add(top.path)
    sizes = list(accumulate(map(len, said), initial=0))
    share = {k: 1000 * sum(sizes[b] - sizes[a] for a, b in spans[k]) // max(1, sizes[-1]) for k in weighed}
    content = {k: _hash("\n".join(x for a, b in v for x in said[a:b])) for k, v in spans.items()}
    # what tells pages apart: their text by the markup, and what it speaks against but holds most of the page
    large = [content[k] for k in sorted(share) if share[k] >= HELD]
    text = _hash("\n".join([*blocks(root, None), *map(str, large)]))
    return text, [(tree_mark(host), text, text, MARK, 0), *((k, content[k], _hash(";".join(styles[k])), kinds[k], share.get(k, 0)) for k in sorted(spans))]


def page_host(url: str) -> Column:
    """The number by which trees and pages know their host."""
    return F.xxhash64(F.coalesce(url_host(F.col(url)), F.lit("")))


def low_importance(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, node) of the style trees' nodes whose importance is below MIN_IMPORTANCE, and of the trees' marks."""
    parts = ("node", "content", "style", "kind", "share")
    entry = pa.list_(pa.struct([(c, pa.int64()) for c in parts]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                seen: dict = {}
                for host, source in zip(batch.column(0)[start:end].to_pylist(), batch.column(1)[start:end], strict=True):
                    said, nodes = style_counts(source.as_py() or "", host)
                    seen[host, said] = min(nodes, seen.get((host, said), nodes))
                host, said = zip(*seen, strict=True)
                nodes = pa.array([[dict(zip(parts, x, strict=True)) for x in v] for v in seen.values()], entry)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(said, pa.int64()), nodes], ["host", "said", "nodes"])

    taken = pages.select(page_host(url).alias("host"), F.col(f"`{html}`").alias("html"))
    # pages of one text count once, whatever their number
    texts = taken.mapInArrow(count, "host long, said long, nodes array<struct<node: long, content: long, style: long, kind: long, share: long>>").groupBy("host", "said").agg(F.min("nodes").alias("nodes"))
    nodes = texts.select("host", F.explode("nodes").alias("x"))
    values = F.explode(F.expr("array(struct(true AS content, x.content AS value), struct(false AS content, x.style AS value))"))
    counts = nodes.select("host", "x.node", "x.kind", "x.share", values.alias("y")).groupBy("host", "node", "kind", "y.content", "y.value").agg(F.count("*").alias("n"), F.sum("share").alias("share"))
    entropy = counts.groupBy("host", "node", "kind", "content").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("n_log"), F.sum("share").alias("share"))
    scaled = F.greatest(F.lit(0.0), (F.log("pages") - F.col("n_log") / F.col("pages")) / F.log(F.greatest("pages", F.lit(2))))
    share = F.when(F.col("content"), CONTENT_SHARE).otherwise(1 - CONTENT_SHARE)
    nodes = entropy.groupBy("host", "node", "kind").agg(F.max("pages").alias("pages"), F.sum(scaled * share).alias("importance"), F.max("share").alias("share"))
    told = F.when((F.col("kind") == SPOKEN) & ((F.col("pages") < MIN_PAGES) | (F.col("share") < HELD * F.col("pages"))), AGAINST).otherwise(1.0)
    importance = F.when(F.col("pages") >= MIN_PAGES, F.col("importance")).otherwise(1.0) * told
    nodes = written(nodes.select("host", "node", "kind", "pages", importance.alias("importance")), "style-nodes")
    # every page carries its host's mark, so the mark's pages are the host's
    trees = nodes.where((F.col("kind") == MARK) & (F.col("pages") >= MIN_PAGES)).select("host")
    return nodes.where((F.col("kind") == MARK) | (F.col("importance") < MIN_IMPORTANCE)).join(trees, "host", "left_semi").select("host", "node")


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", into: str = "main", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """pages with a struct column ``into`` (text, n_chars); all other columns stay, one that is already named ``into`` is replaced."""
    low = written(low_importance(pages, url, html), "style-tree")
    [page] = absent(pages, "_page")
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    if low.count() <= broadcast_nodes:
        shared = pages.sparkSession.sparkContext.broadcast(Removed(low.select("node").toPandas()["node"].to_numpy(np.int64)))
        # the host's number travels with the page in one string column, as the block operator takes one
        paired = pages.withColumn(page, F.concat(page_host(url).cast("string"), F.lit("\n"), body))
    else:
        shared = None
        lists = low.groupBy("host").agg(F.concat_ws(" ", F.collect_list(F.col("node").cast("string"))).alias("nodes"))
        rows = pages.select(F.struct(*columns(pages)).alias("row"), page_host(url).alias("host"), body.alias("body"))
        hot = hot_keys(rows.groupBy("host").agg(F.count("*").alias("n")), ["host"], "n", rows.count())
        paired = spread_join(rows, lists, ["host"], hot, F.xxhash64(F.col("body")), "left")
        paired = paired.select("row.*", F.concat_ws("\n", F.concat_ws(" ", F.col("host").cast("string"), "nodes"), "body").alias(page))

    def judge(sources: list[str]) -> list:
        texts, trees = [], {}
        for source in sources:
            head, _, body = source.partition("\n")
            host, *nodes = head.split(" ")
            if shared is None and head not in trees:
                trees[head] = Removed(np.array(nodes, np.int64))
            texts.append(extract(body, trees[head] if shared is None else shared.value, int(host)))
        return [texts, list(map(len, texts))]

    return add_by_block(paired, page, into, "text string, n_chars long", judge).drop(page)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "main.text", "main.n_chars")
