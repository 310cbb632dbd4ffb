"""Quality rules, toxicity, HTML text, BPE and licence scans on small cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hireframe.llm import bpe, html_text, license_model, license_scan, repetition, toxicity

DIR = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "a " * 3000, "é" * 5000]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, quality string")


def brute_repeats(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


def test_repeats_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        many = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        names: dict = {}
        first = np.array([names.setdefault((i, w), len(names)) for i, d in enumerate(many) for w in d], np.int64)
        assert list(repetition.repeats(first)) == [x for d in many for x in brute_repeats(d)]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    longest = brute_repeats(words)
    spans = {i + k for i, x in enumerate(longest) if x >= repetition.MIN_REPEAT for k in range(x)}
    most = max(longest, default=0)
    bad = len(spans) > repetition.MAX_COVERED * n or (most >= repetition.MIN_REPEAT and most > repetition.MAX_LONGEST * n)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed, not failed and not bad


def test_quality_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a"]
    for _ in range(40):
        part = " ".join(rng.choice(["ab", "c|d", "e", "ff%", "g"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 60)))
        texts.append("\n".join([part] * rng.randint(1, 3) + [" ".join(str(rng.random()) for _ in range(rng.randint(0, 80)))]))
    df = docs(spark, texts)
    got = {r["doc_id"]: tuple(r["q"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in repetition.judge_texts(df, into="q").collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_quality_keeps_columns_and_takes_odd_texts(spark):
    df = docs(spark, [*ODD, "same words here", "same words here"]).withColumn("nested", F.array(F.lit(1), F.lit(None)))
    out = repetition.judge_texts(df)
    assert out.columns == ["doc_id", "text", "nested", "quality"] and out.count() == 8
    assert not any(r[0] for r in out.select("quality.kept").collect())
    assert repetition.judge_texts(df.limit(0)).count() == 0


def labelled(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeghlmnoprt") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(300):
        said = [word() for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                said[rng.randrange(40)] = rng.choice(["vilescum", "nastyrat"])
        elif i % 4 == 1:
            said[5] = "vilescumbag"  # a clean word that begins like a toxic one
        rows.append((i, " ".join(said), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark):
    model = toxicity.train(labelled(spark))
    clean = "plain words about gardens and trees in the morning light of a quiet town"
    assert model.score(clean) < 0.3 < model.score(clean + " vilescum")
    assert model.score(clean + " v1l3ѕсum") > 0.3  # digits and homoglyphs
    assert model.score(clean + " vilescumbag") < 0.3  # an exception phrase
    out = toxicity.score_texts(docs(spark, [*ODD, clean, clean]), model)
    scores = [r["s"]["score"] for r in out.select(F.col("toxicity").alias("s")).collect()]
    assert len(scores) == 8 and all(0 <= s <= 1 for s in scores) and scores[-1] == scores[-2]
    assert "quality" in out.columns


def plain_score(model, text):
    """The score, word by word and entry by entry."""
    words = toxicity.fold(text).split()
    total, times = 0.0, {}
    phrases = [e.split() for e in model.entries if " " in e[1:-1]]
    entries = {e: w for e, w in model.entries.items() if " " not in e[1:-1]}
    for i, word in enumerate(words):
        fits = [e for e in entries if f" {word} ".startswith(e)]
        best = max(fits, key=len, default=None)
        covered = any(words[k : k + len(p)] == p for p in phrases for k in range(max(0, i - len(p) + 1), i + 1))
        if best is not None and entries[best] and not covered:
            times[best] = times.get(best, 0) + 1
    total = sum(entries[e] * (1 + np.log(n)) for e, n in times.items())
    x = model.curve[0] + model.curve[1] * np.log1p(total) + model.curve[2] * 100 * total / max(len(words), 100)
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def test_toxicity_exception_phrases(spark):
    """A word that marks label 1 but stands in a phrase that clean documents use."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeghlmnoprt") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(600):
        said = [word() for _ in range(40)]
        if i % 4 == 0:
            said[7], said[20] = "vilescum", rng.choice(["nastyrat", "vilescum"])
        elif i % 40 == 1:
            said[5:7] = ["garden", "vilescum"]
        elif i % 40 == 2:
            said[5:8] = ["old", "nastyrat", "hole"]
        rows.append((i, " ".join(said), int(i % 4 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    phrases = {e for e, w in model.entries.items() if " " in e[1:-1]}
    assert " garden vilescum " in phrases and all(model.entries[p] == 0 for p in phrases)
    clean = "plain words about trees in the morning light of a quiet town"
    assert model.score(f"{clean} garden vilescum") < 0.3 < model.score(f"{clean} vilescum")
    assert model.score(f"{clean} Garden v1lescum") < 0.3 < model.score(f"{clean} garden vilescum vilescum nastyrat")
    texts = [t for _, t, _ in rows[:200]] + [*filter(None, ODD), "garden vilescum garden", "vilescum vilescumbag", "old nastyrat hole vilescum", "nastyrat " * 9]
    for text in texts:
        assert model.score(text) == pytest.approx(plain_score(model, text), abs=1e-12)


def test_toxicity_without_both_labels(spark):
    one = labelled(spark).where("toxic = 0")
    assert toxicity.train(one).score("vilescum") == 0.0
    assert toxicity.train(one.limit(0)).score("x") == 0.0
    assert toxicity.score_texts(docs(spark, []), toxicity.train(one)).count() == 0


def test_toxicity_held_out(spark):
    """Accuracy on labelled rows that training did not see."""
    d = "/root/testdata/sf0.1"
    model = toxicity.trained_on(spark, d)
    rows = spark.read.parquet(f"{d}/labels.parquet").where(toxicity.held_out()).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")
    out = toxicity.score_texts(rows, model).select("toxic", "toxicity.predicted").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in out)
    assert hit / sum(r["toxic"] for r in out) > 0.9 and sum(r["predicted"] and not r["toxic"] for r in out) < 0.02 * len(out)


PAGES = [
    ("<body><div class='cookie-notice'>x</div><div id=content><h1>A &lt; B</h1><p>one<br>two <i>x</i>y<p>three</div><section class=comments><p>c</p></section>", "A < B\n\none two xy\n\nthree"),
    ("<p>a<div>b</div>c", "a\n\nb\n\nc"),
    ("", ""),
    (None, ""),
    ("<article><header><h1>T</h1></header><p>x &amp;amp; &nbsp; y</p><ul><li>1<li>2</ul><form>f</form></article><article class='comment'>no</article>", "x &amp; y\n\n1\n\n2"),
    ("<p>a < b</p><script>if(a<b){}</script>tail", "a < b\n\ntail"),
    ("<div>\n <pre>x\ny</pre></div><table><tr><td>1<td>2<tr><td>3</table>", "x y\n\n1\n\n2\n\n3"),
    ("<main><p>in</p><aside>side</aside></main><p>out</p>", "in"),
    ("<p>cut <b", "cut"),
    ("<body class='has-sidebar'><div class='content-sidebar'><article class='post-header'><p>kept</article></div><div class='post-comments'><article><p>no</article></div>", "kept"),
    ("<div class='sidebar'><article><p>no</article></div><div id='no-menu'><p>yes</div>", "yes"),
    ("<div role=navigation>menu</div><div hidden>h</div><div style='display: none'>n</div><p>text</p><div class=\"ad-slot\">buy</div>", "text"),
]


@pytest.mark.parametrize(("source", "wanted"), PAGES)
def test_extract(source, wanted):
    assert html_text.extract(source or "") == wanted


@pytest.mark.parametrize("part", ['<h2 id="related-work">kept</h2>', '<h2 id="discussion">kept</h2>', '<section id="discussion"><p>kept</p></section>', '<p id="share-prices">kept</p>', '<h3 class="promo-code">kept</h3>'])
def test_titles_of_an_article_stay(part):
    for tag in ("article", "main"):
        page = f"<{tag}>{part}<section id=comments><p>no</p></section><ol class='comment-list'><li>no</ol><div id=share-bar>no</div></{tag}>"
        assert html_text.extract(page) == "kept"


def test_style_tree_drops_what_a_site_repeats(spark):
    page = lambda i, host: f"<html><body><div class='strap'>All our shops are open</div><div class='text'><p>Story {i} about {'x' * i}</p></div></body></html>"
    rows = [(i, f"http://{h}/p{i}", page(i, h)) for h in ("big.org", "small.org") for i in range(20 if h == "big.org" else 3)] + [(99, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {(r["page_id"], r["url"]): r["main"]["text"] for r in html_text.extract_main_text(pages).collect()}
    assert out[3, "http://big.org/p3"] == "Story 3 about xxx"
    assert out[1, "http://small.org/p1"] == "All our shops are open\n\nStory 1 about x"  # too few pages to tell
    assert out[99, None] == "" and len(out) == 24
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


STORY = "Story {i} tells of {x} and of all that came of it, at some length, for a page is about something"
OVERRULED = {
    "widget.org": ("<div class='widget-content'><h1>Title {i}</h1><p>" + STORY + "</p></div><div class='ad-box'>Buy {i} now</div>", "Title {i}\n\n" + STORY),
    "teaser.org": ("<div class='story'><p>" + STORY + "</p></div><article class='teaser'>More {i}</article><div class=legal>Imprint</div>", STORY + "\n\nMore {i}"),
    "talk.org": ("<div class='post'><p>Post {i} on {x}</p></div><div id='comments'><p>" + STORY + "</p><p>" + STORY + " again</p></div>", "Post {i} on {x}"),
    "bare.org": ("<div class=u><a href=/>Home</a> <a href=/n>News</a></div><div class=v><div class=s>Open all day, every day</div><div class=t><p>" + STORY + "</p></div></div><div class=w>Open all day, every day</div>", STORY),
}


def test_evidence_overrules_the_markup(spark):
    """A story in a box that is named like a widget, or beside teasers, stays; comments go though they are longer; bare markup comes out clean."""
    fill = lambda t, i: t.format(i=i, x="x" * (i + 1))
    rows = [(i, f"http://{h}/{i}", "<body>" + fill(page, i) + "</body>") for h, (page, _) in OVERRULED.items() for i in range(20)]
    rows += [(i, f"http://few.org/{i}", fill(OVERRULED["widget.org"][0], i)) for i in range(3)]
    out = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in out:
        host = r["url"].split("/")[2]
        wanted = "" if host == "few.org" else fill(OVERRULED[host][1], r["page_id"])  # of few pages only the markup tells
        assert r["main"]["text"] == wanted, r["url"]
    by_markup = {r["url"].split("/")[2]: html_text.extract(r["html"]) == fill(OVERRULED[r["url"].split("/")[2]][1], r["page_id"]) for r in out if "few" not in r["url"]}
    assert by_markup == {"widget.org": False, "teaser.org": False, "talk.org": True, "bare.org": False}


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://c.org/x", "<nav>n</nav><article><h1>H</h1><p>Same text</p></article>") for i in range(30)]
    out = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["main"]["text"] for r in out.collect()} == {"H\n\nSame text"}


@pytest.mark.parametrize("shape", ["<div class=text>{}</div>", "<article><div class=text>{}</div></article>", "<main><section>{}</section></main>", "<div class=outer><p>Short strap</p><div class=text>{}</div></div>"])
def test_copies_in_a_div_stay(spark, shape):
    body = "<h1>Head</h1><p>One text that many pages of this host carry as a copy</p>"
    other = lambda i: f"<h1>Head {i}</h1><p>Another text, number {i}, which stands on this page alone</p>"
    # all copies; many copies and some pages of their own; copies told apart by a line beside the body
    hosts = {"all.org": [(body, "")] * 8, "some.org": [(body, "")] * 90 + [(other(i), "") for i in range(10)], "line.org": [(body, f"<div class=line>Visit {i}</div>") for i in range(90)] + [(other(i), "") for i in range(10)]}
    rows = [(k, f"http://{h}/{k}", f"<body>{shape.format(b)}{line}</body>", b) for h, v in hosts.items() for k, (b, line) in enumerate(v)]
    out = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, body string")).collect()
    assert len(out) == len(rows)
    for r in out:
        for piece in re.findall(r"<\w+>([^<]+)</", r["body"]):
            assert piece in r["main"]["text"], r["url"]


def test_repeated_rows_do_not_hide_a_strap(spark):
    strap = "<div class='strap'>All our shops are open</div>"
    rows = [(i, f"http://m.org/p{i}", f"<body>{strap}<div class=text><p>Story {i} about {'x' * i}</p></div></body>") for i in range(20) for _ in range(1 + 50 * (i == 3))]
    out = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["main"]["text"] for r in out} == {f"Story {i} about {'x' * i}".strip() for i in range(20)}


def plain_style_trees(rows):
    """(host, node) of low importance and of the marks, page by page."""
    pages: dict = {}
    for host, source in rows:
        said, nodes = html_text.style_counts(source or "", host)
        held = pages.setdefault(host, {})
        held[said] = min(held.get(said, nodes), nodes)
    out = set()
    for host, held in pages.items():
        if len(held) < html_text.MIN_PAGES:
            continue
        seen: dict = {}
        shares: dict = {}
        for nodes in held.values():
            for node, content, style, kind, share in nodes:
                seen.setdefault((node, kind), []).append((content, style))
                shares[node, kind] = shares.get((node, kind), 0) + share
        for (node, kind), many in seen.items():
            n, importance = len(many), 1.0
            if n >= html_text.MIN_PAGES:
                entropy = [sum(-c / n * np.log(c / n) for c in Counter(x).values()) / np.log(n) for x in zip(*many, strict=True)]
                importance = html_text.CONTENT_SHARE * entropy[0] + (1 - html_text.CONTENT_SHARE) * entropy[1]
            if kind == html_text.SPOKEN and (n < html_text.MIN_PAGES or shares[node, kind] < html_text.HELD * n):
                importance *= html_text.AGAINST
            if kind == html_text.MARK or importance < html_text.MIN_IMPORTANCE:
                out.add((host, node))
    return out


def site(rng, n):
    """Pages with menus, straps and articles, some of them copies."""
    out = []
    for i in range(n):
        words = lambda k: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(k))
        body = words(30) if i % 3 else "a copied body that many pages carry"
        frame = rng.choice(["<article><h1>{0}</h1><p>{1}</p><div>About us</div></article>", "<div class=text><p>{1}</p></div>", "<main><section>{1}</section></main>"])
        out.append((i, f"http://{rng.choice(['big.org', 'big.org', 'c.net', None])}/{i}", f"<body><nav><a href=x>{words(2)}</a></nav><div class=strap>All shops are open</div><div class=ad>{words(3)}</div>{frame.format(words(2), body)}<footer>{words(2)}</footer></body>"))
    return out


def test_style_trees_against_plain_version(spark):
    rows = site(random.Random(15), 160)
    rows += rows[:20] + [(900, None, None), (901, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hosts = pages.select(html_text.page_host("url").alias("h"), "html").collect()
    got = {tuple(r) for r in html_text.low_importance(pages).collect()}
    assert got == plain_style_trees([tuple(r) for r in hosts])
    # the joined lists and the broadcast array give the same texts
    texts = [sorted((r["page_id"], r["main"]["text"]) for r in html_text.extract_main_text(pages, broadcast_nodes=n).collect()) for n in (0, 10**6)]
    assert texts[0] == texts[1] and len(texts[0]) == len(rows)
    assert not any("All shops are open" in t or "About us" in t for i, t in texts[0] if i < 160 and rows[i][1].startswith("http://big.org"))


def test_style_trees_decide_on_whole_tables(spark):
    """Without the removals of the trees, the pages of hosts that have one keep their menus and footers."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("html", html_text.page_host("url").alias("h")).collect()
    low = html_text.low_importance(pages).collect()
    removed = html_text.Removed(np.array([r["node"] for r in low], np.int64))
    marks = html_text.Removed(np.array(sorted({html_text.tree_mark(r["host"]) for r in low}), np.int64))
    in_trees = [r for r in rows if marks.among([html_text.tree_mark(r["h"])])]
    assert len(in_trees) > 60
    for r in in_trees:
        whole, main = html_text.extract(r["html"], marks, r["h"]), html_text.extract(r["html"], removed, r["h"])
        assert len(main) < len(whole) and main in whole


def test_main_text_with_clashing_columns(spark):
    names = ["_page", "_host", "host", "row", "body", "nodes", "_salt", "_salts", "a.b", "main"]
    rows = [(i, "http://h.org/1", f"<nav>menu</nav><p>text {i % 5}</p>", *["x"] * len(names)) for i in range(12)]
    pages = spark.createDataFrame(rows, ["page_id", "url", "html", *names])
    for n in (0, 10**6):
        out = html_text.extract_main_text(pages, broadcast_nodes=n)
        assert out.columns == ["page_id", "url", "html", *names]
        assert sorted((r["page_id"], r["main"]["text"], r["a.b"]) for r in out.collect()) == [(i, f"text {i % 5}", "x") for i in range(12)]


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return bpe.WordBpe(open(bpe.vocabulary_path(), encoding="utf-8").read()), Tokenizer.from_file(bpe.vocabulary_path())


def same(pair, text):
    ids, names = pair[0].encode(text)
    wanted = pair[1].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == wanted
    assert names.decode() == pair[1].decode(wanted, skip_special_tokens=False)
    assert pair[0].encode_ids(text) == ids


LETTERS = "aabcdefghijklmnopqrstuvwxyz'ABCS  \n\t0123!?.,<>|ßéΣσİ日ñ́\u200b\x1c\x85"


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(LETTERS), max_size=60))
def test_bpe_equals_library(text):
    same(PAIR, text)


PAIR = None


@pytest.fixture(scope="module", autouse=True)
def _pair(pair):
    global PAIR
    PAIR = pair


@pytest.mark.parametrize("text", ["", "a<|endoftext|> b<|startoftext|>", "ΑΣ ΑΣΣ Σ", "it'S WE'LL don't", "a" * 5000, "hahaha" * 300, "日本語テキスト😀", "é é ﬁ Å ① ² ½", "___---!!!..."])
def test_bpe_cases(pair, text):
    same(pair, text)


def test_bpe_whole_texts(pair, spark):
    for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").limit(60).collect():
        same(pair, r[0] or "")


def test_encode_and_decode_rows(spark):
    out = bpe.encode_texts(docs(spark, [*ODD, "Hello there", "Hello there"])).orderBy("doc_id").collect()
    assert out[0]["bpe"]["n_tokens"] == out[1]["bpe"]["n_tokens"] == 0 and out[6]["bpe"]["ids"] == out[7]["bpe"]["ids"]
    back = bpe.decode_ids(spark.createDataFrame([(out[6]["bpe"]["ids"],), (None,)], "ids array<int>")).collect()
    assert [r["decoded"] for r in back] == ["hello</w> there</w>", None]
    with pytest.raises((ValueError, KeyError)):
        bpe.WordBpe('{"model": {"type": "BPE", "end_of_word_suffix": null}, "normalizer": {"normalizers": []}, "pre_tokenizer": {"pretokenizers": []}}')


LICENSES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
    "You need a licence to fish here.": None,
    "mit der Software und die Rechte": None,
}


def brute_license(model, line):
    words = license_model.words_of(line)
    z = np.array(model.bias)
    for g in license_model.ngrams(words):
        z = z + np.array(model.weights.get(g, np.zeros(len(z))))
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.classes[int(p.argmax())], float(p.max())


def test_licenses(spark):
    model = license_model.trained()
    lines = list(LICENSES)
    out = license_scan.scan_licenses(docs(spark, [*ODD, *lines, "\n".join(lines)])).orderBy("doc_id").collect()
    assert all(not r["licenses"] for r in out[: len(ODD)])
    for r, (line, family) in zip(out[len(ODD) :], LICENSES.items(), strict=False):
        assert [x["family"] for x in r["licenses"]] == ([family] if family else []), line
        for x in r["licenses"]:
            assert brute_license(model, line) == (x["family"], pytest.approx(x["probability"], rel=1e-5))
    assert [x["paragraph"] for x in out[-1]["licenses"]] == [i for i, f in enumerate(LICENSES.values()) if f]
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


def test_every_template_is_found(spark):
    """Each template in all its forms, alone, as a comment, and amid prose."""
    made = sorted({(t, name) for name, many in license_model.TEMPLATES.items() for x in many for t in license_model.expanded(x, 4000, random.Random(0))})
    prose = "A river ran by the mill and nobody could say who owned the boats.\n"
    texts = [f(t) for t, _ in made for f in (str, lambda t: f"// {t.capitalize()}.", lambda t: prose + t + "\n" + prose)]
    out = [r["licenses"] for r in license_scan.scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()]
    for k, (t, name) in enumerate(made):
        for j in range(3):
            assert [(x["family"], x["paragraph"]) for x in out[3 * k + j]] == [(name, j // 2)], texts[3 * k + j]
    known = ["SPDX-License-Identifier: MIT", "MIT License", "/* SPDX-License-Identifier: GPL-2.0-or-later */"]
    assert [[x["family"] for x in r["licenses"]] for r in license_scan.scan_licenses(docs(spark, known)).orderBy("doc_id").collect()] == [["MIT"], ["MIT"], ["GPL"]]


def test_calibration_of_unseen_wording():
    """Probabilities of templates that a model has not seen are neither far too high nor far too low."""
    model = license_model.trained()
    assert 0.25 < model.scale < 1.5
    for line in license_model.OTHER:
        for t in license_model.expanded(line, 4, random.Random(0)):
            assert brute_license(model, t)[0] == license_model.UNKNOWN, t


def altered(model, weights=None, bias=None):
    return license_model.LicenseModel(model.classes, weights or model.weights, bias or model.bias, model.references, model.longest, model.scale)


def test_the_classifier_decides(spark):
    """Texts in which every template confirms: nothing is found by a model that knows nothing, or takes all for unknown."""
    model = license_model.trained()
    texts = [*[t for t, f in LICENSES.items() if f], *WRAPPED.values(), "Released under the MIT License and licensed under the Apache License, Version 2.0."]
    found = lambda m: [{x["family"] for x in r["licenses"]} for r in license_scan.scan_licenses(docs(spark, texts), model=m).orderBy("doc_id").collect()]
    assert all(found(model))
    blind = altered(model, weights={g: [0.0] * len(model.classes) for g in model.weights})
    assert not any(found(blind))
    unknown = model.classes.index(license_model.UNKNOWN)
    assert not any(found(altered(model, bias=[b + 1e3 * (k == unknown) for k, b in enumerate(model.bias)])))
    # a model that takes MIT for ISC names neither: its families are not confirmed
    mit, isc = model.classes.index("MIT"), model.classes.index("ISC")
    turned = {g: [w[isc] if k == mit else w[mit] if k == isc else x for k, x in enumerate(w)] for g, w in model.weights.items()}
    assert all("MIT" not in f and "ISC" not in f for f in found(altered(model, weights=turned)))


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

 * Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
}


def test_wrapped_licenses(spark):
    prose = "A line of prose about the source of a river and the rights of its owners.\n"
    texts = [before + notice + after for notice in WRAPPED.values() for before, after in (("", ""), (prose, "\n" + prose), ("Title\n\n", ""))]
    texts += ["\n".join(notice.split()[i] for i in range(len(notice.split()))) for notice in WRAPPED.values()]  # a word a line
    texts += [WRAPPED["BSD"].split("\n")[0], "Released under the MIT License and licensed under the Apache License, Version 2.0.", prose * 40]
    out = [r["licenses"] for r in license_scan.scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()]
    wanted = [{f} for f in WRAPPED for _ in range(3)] + [{f} for f in WRAPPED] + [{"BSD"}, {"MIT", "Apache-2.0"}, set()]
    assert [{x["family"] for x in r} for r in out] == wanted
    for r, text in zip(out, texts, strict=True):
        assert all(prose.strip() != text.split("\n")[x["paragraph"]] and 0 <= x["probability"] <= 1 for x in r)
