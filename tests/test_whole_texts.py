"""The text operators on whole texts, against plain Python on a few long texts."""

import re

import pytest

from hireframe.plans import catalogue

SPACE = r"[ \t\n\r\f\v]+"


def story(i):
    return f"start{i} " + " ".join(f"w{i}x{k}" + (".\n" if k % 12 == 0 else "") for k in range(400 + i)) + f" kanzhun.com/p{i} end{i}"


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, story(i), "en", "web", len(story(i))) for i in range(1, 13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return lambda name: [r.asDict() for r in catalogue.queries()[name](spark, d).collect()], {r[0]: r[1] for r in rows}


def squeeze(t):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\r\f\v]{2,}", " ", t)).strip()


def undomain(t):
    t = re.sub(r"(?i)https?://[^\s)\]\"']*kanzhun[^\s)\]\"']*", "", t)
    return squeeze(re.sub(r"(?i)[a-z0-9.-]*kanzhun[a-z0-9./?#&=%-]*", "", t))


def key(t):
    return re.sub(SPACE, "", t)


def turned(t):
    return t[len(t) // 2 :] + " " + t[: len(t) // 2]


def test_cleaning_reads_whole_texts(whole):
    run, texts = whole
    brands = ["【】招聘", "", "xBOSSx  ok，。", "", "see https://m.kanzhun.com/a?b=1 and KANZHUN here", "www.kanzhun.com/x"]
    for r in run("t1_brand_noise"):
        i = r["doc_id"]
        assert key(r["cleaned"]) == key(brands[i % 6].join(["", texts[i][: len(texts[i]) // 2], texts[i][len(texts[i]) // 2 :], ""])), i
    for r in run("t2_domain_noise"):
        assert "kanzhun" not in r["cleaned"].lower() and f"end{r['doc_id']}" in r["cleaned"]
    assert {r["doc_id"]: r["k"] for r in run("t3_comparison_key")} == {i: key(t) for i, t in texts.items()}
    for r in run("t8_css_strip"):
        t = texts[r["doc_id"]]
        assert r["cleaned"] == re.sub(SPACE, " ", t[: len(t) // 2] + "\n" + t[len(t) // 2 :]).strip()


def test_merging_reads_whole_texts(whole):
    run, texts = whole
    for r in run("t4_merge_pair"):
        i, t = r["doc_id"], squeeze(texts[r["doc_id"]])
        if i % 3 == 1:
            assert key(r["description"]) == key(t) and r["duty"] == ""
        else:
            assert (r["description"], r["duty"]) == (t, "" if i % 3 == 0 else squeeze(turned(texts[i])))
    for r in run("t5_merge_blocks"):
        t = texts[r["doc_id"]]
        assert r["merged"] == (undomain(t) if r["doc_id"] % 2 == 0 else f"{undomain(t)}\n\n{undomain(turned(t))}")
    for r in run("t11_append_unless_contained"):
        t = texts[r["doc_id"]]
        assert r["merged"] == (t if r["doc_id"] % 2 == 0 else f"{t}\n{turned(t).strip()}")
    prompts = {r["batch"]: r["prompt"] for r in run("x14_batch_prompt")}
    assert prompts == {b: "\n".join(f"=== 职位 en (公司: web) ===\n\n{t}\n\n\n" for i, t in texts.items() if i // 10 == b) for b in (0, 1)}


def test_merge_by_id_reads_whole_texts(whole):
    run, texts = whole
    best = lambda ids, f=lambda t: t: max((squeeze(f(texts[i])) for i in ids), key=len)
    out = {r["jid"]: r for r in run("a11_dedupe_merge")}
    assert set(out) == {"0", "1", "2"}
    for jid, r in out.items():
        ids = [i for i in texts if i // 6 == int(jid)]
        described = best([i for i in ids if i % 5])
        if jid == "1":
            assert (r["description"], r["duty"]) == (described, best(ids, turned))
    # group 2 has one text, whose duty is the same but for white space
    assert key(out["2"]["description"]) == key(texts[12]) and out["2"]["duty"] == ""


def test_side_panel_and_duty_read_whole_texts(whole):
    run, texts = whole
    for r in run("t7_side_panel_clean"):
        t = texts[r["doc_id"]]
        assert r["cleaned"] == "\n".join([x.strip() for x in t.split("\n") if x.strip()] + ["ABC"]) and f"end{r['doc_id']}" in r["cleaned"]
    for r in run("x27_split_duty"):
        t = texts[r["doc_id"]]
        half = len(t) // 2
        assert (r["duty"], r["requirement"]) == (t[:half].strip(), f":{t[half:]}".strip())
