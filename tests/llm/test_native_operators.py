"""Mixing, URL filters, quality rules and components against brute force, with their edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lrforge.llm import mixing, quality, urls
from lrforge.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def targets_by_hand(sizes):
    """Sources in order with sizes; weights 5, 2, 1; shares above three times a size go to the others."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, capped = sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(3 * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 3 * sizes[i]}
        if not over:
            return [3 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, words(rng.randint(0, 60)), rng.choice(["b", "a", "é", "hot", "hot", "hot", None])) for i in range(400)] + [(900, None, "a"), (901, "  \n", "a"), (902, words(4000), "tiny"), (None, "x y", "b"), (5, "x y", "b"), (5, "x y", "b")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(df).toPandas()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len(WORD.findall(r[1] or "")) for r in rows if r[2] == s) for s in names]
    want = dict(zip(sizes, targets_by_hand(sizes), strict=True))
    for size, part in got.groupby("source_size"):
        assert part["target"].iloc[0] == pytest.approx(want[size])
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 2
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix_sources(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "source_size"]
    assert got.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()


def test_mix_order_is_by_hash(spark):
    """One source, less taken than there is: documents before the cut are those with the smallest keys."""
    rows = [(i, words(10), "a") for i in range(30)] + [(100 + i, words(10), "b") for i in range(30)]
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()}
    keys = sorted(range(100, 130), key=lambda i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16), str(i)))
    taken = [got[i] for i in keys]
    assert taken == sorted(taken, reverse=True) and sum(taken) == 171


def test_cut_slices_are_sliced_again(spark, monkeypatch):
    """With small bounds the cut is found over several levels, where it was; a hot null id is one row of the sort."""
    rng = random.Random(5)
    rows = [(i, words(rng.randint(0, 9)), rng.choice("aaab")) for i in range(3000)] + [(None, words(rng.randint(1, 5)), "a") for _ in range(500)]
    df = spark.createDataFrame(rows, DOCS)
    key = ["doc_id", "size", "source_size"]
    whole = mixing.mix_sources(df).toPandas().sort_values(key)
    monkeypatch.setattr(mixing, "CUT_ROWS", 20)
    monkeypatch.setattr(mixing, "SLICES", 7)
    assert mixing.mix_sources(df).toPandas().sort_values(key)["taken"].tolist() == whole["taken"].tolist()


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(spark.createDataFrame([(1, "", "a"), (2, None, None)], DOCS)).collect()] == [0, 0]


def test_mixed_documents_keep_their_columns(spark):
    rows = [(i, words(10), "ab"[i % 2], i, "x") for i in range(40)]
    df = spark.createDataFrame(rows, DOCS + ", size int, `row` string").withColumnRenamed("row", "src")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    counts = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["a"] - 40 * 5 / 7) <= 1 and abs(counts["b"] - 40 * 2 / 7) <= 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1064)] + [(5000, x) for x in range(5001, 5100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (7777, 7777)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in parent} | {7777: 7777}
    assert connected_components(df.where("a < 0")).count() == 0


PAGES = "page_id long, url string, html string"


def judged(spark, rows, **more):
    return {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, PAGES), **more).collect()}


def test_rules(spark):
    got = judged(spark, [
        (1, "http://A.Example.ORG/es/1?x", None), (2, "https://example.org/en/17", None), (3, "http://example.org/fr", None), (4, "http://x.com/de/#t", None), (5, "http://x.com/fr/", None),
        (6, "http://x.net/de/", None), (7, None, None), (8, "no scheme", None), (9, "http://notexample.org/es/", None), (10, "http://x.org", None), (10, "http://x.org", None),
    ])
    assert {k: (r["rule"], r["verdict"]) for k, r in got.items()} == {
        1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/de/", "block"), 5: ("com/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("org/", "allow"), 10: (None, "allow"),
    }
    assert (got[1]["host"], got[1]["path"], got[7]["host"], got[8]["path"]) == ("a.example.org", "/es/1", "", "")


def test_blocks_reach_aliases(spark):
    canonical = '<head><link rel="canonical" href="{}"></head>'.format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    got = judged(spark, [
        (1, "http://x.net/a", canonical("http://x.com/de/1")), (2, "http://y.net/b", refresh("http://x.net/a#top")), (3, "http://z.net/c", None),
        (4, "http://p.net/", canonical("/q")), (5, "http://p.net/q", refresh("http://h.com/de/9")), (6, "http://p.net/q2", canonical("//p.net/q")), (7, "http://h.com/fr/1", refresh("http://p.net/q2")),
        (8, "http://x.com/de/1", None), (9, "http://r.net/d/e", canonical("f")), (10, "http://r.net/d/f", None),
    ], redirects=spark.createDataFrame([("http://z.net/c", "http://y.net/b"), (None, "http://y.net/b")], "from_url string, to_url string"))
    assert [got[i]["verdict"] for i in (1, 2, 3, 8)] == ["block"] * 4
    assert [got[i]["verdict"] for i in (4, 5, 6, 7)] == ["allow"] * 4  # an explicit allow among the aliases comes first
    assert got[1]["component"] == got[3]["component"] and got[9]["component"] == got[10]["component"] == "http://r.net/d/e"


def test_all_links_of_a_page_count(spark):
    two = '<link rel=canonical href="http://a.net/x"><LINK REL="canonical" HREF="HTTP://Hub.COM/de/?q=1&amp;r=2#z"><meta content="1;URL=../up/./y" http-equiv=refresh>'
    got = judged(spark, [
        (1, "http://p.net/d/e?k", two), (2, "http://a.net/x", None), (3, "http://hub.com/de/?q=1&r=2", None), (4, "http://p.net/up/y", None), (5, "http://p.net/d/../up/y#f", None),
        (6, "http://q.net", '<link rel="canonical" href="?v=1">'), (7, "http://q.net/?v=1", None), (8, "http://q.net/", None), (9, "http://q.net/a/..", None),
    ])
    assert len({got[i]["component"] for i in (1, 2, 3, 4, 5)}) == 1 and {got[i]["verdict"] for i in (1, 2, 3, 4, 5)} == {"block"}
    assert len({got[i]["component"] for i in (6, 8, 9)}) == 1 and got[6]["verdict"] == "allow"


def linked(spark, html, url="http://p.net/d/e?k"):
    """Nodes that a page's links name, itself left out."""
    return sorted(r["b"] for r in urls.page_edges(spark.createDataFrame([(1, url, html)], PAGES)).collect())


CANON = "<link rel='canonical' {}>".format


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (CANON('href="http://b.net/it\'s"'), ["http://b.net/it's"]), (CANON("href='http://b.net/say \"x\" >'"), ['http://b.net/say%20"x"%20>']), (CANON("href=http://b.net/it's"), ["http://b.net/it's"]),
        (CANON('href="http://f.com/de/a b"'), ["http://f.com/de/a%20b"]), (CANON('href=" http://f.com/x\n"'), ["http://f.com/x"]), ("<!-- " + CANON("href=/x") + " -->", []), ("<!-- " + CANON("href=/x"), []),
        ("<script>var a = '" + CANON("href=/x") + "'</script>" + CANON("href=/y"), ["http://p.net/y"]), ("<STYLE>" + CANON("href=/x") + "</style >", []), (CANON('href="#"'), []), (CANON('href=""'), []), (CANON('href="#top"'), []),
        (CANON("href=mailto:x@y"), []), (CANON("href='javascript:void(0)'"), []), (CANON("href='HTTPS://B.net'"), ["https://b.net/"]), ('<base href="http://base.org/a/b"><base href="/no">' + CANON("href=c"), ["http://base.org/a/c"]),
        ('<base href="/f/">' + CANON("href=../g") + CANON('href="#"'), ["http://p.net/f/", "http://p.net/g"]), ('<base href="mailto:x">' + CANON("href=c"), ["http://p.net/d/c"]), ('<link title="href=/a rel=canonical" rel="stylesheet" href="/b">', []),
        ('<link data-href="/a" href="/b" href="/c" rel="Alternate CANONICAL">', ["http://p.net/b"]), ('<link rel=canonical/href=/b>', []), ("<links rel=canonical href=/b>", []), (CANON('href="/a?x=1&amp;y=&#39;&#x41;&#38;lt;&amp;#39;"'), ["http://p.net/a?x=1&y='A&lt;&"]),
        (CANON('href="/&#233;&#9999;&nope;"'), ["http://p.net/&"]), ("<meta http-equiv='Refresh' content='5; url=\"/r s\"'>", ["http://p.net/r%20s"]), ('<meta http-equiv=refresh content="0;URL=http://q.net/?a=b;c">', ["http://q.net/?a=b;c"]),
        ('<meta http-equiv=refresh content="30">', []), ("<link rel=canonical>", []), ("<link " + "a='>' " * 300 + "rel=canonical href=/z>", ["http://p.net/z"]), ("<link " + "a " * 50_000 + "rel=canonical href=/z>", []), (None, []), ("canonical <link", []),
    ],
)
def test_links_of_a_page(spark, html, want):
    assert linked(spark, html) == want


def test_apostrophe_and_space_reach_the_right_pages(spark):
    got = judged(spark, [(1, "http://h.com/de/1", CANON('href="http://b.net/it\'s"')), (2, "http://b.net/it", None), (3, "http://b.net/it's", None), (4, "http://g.net/", CANON('href="http://f.com/de/a b"')), (5, "http://f.com/de/a", None), (6, "http://f.com/de/a b", None)])
    assert [got[i]["verdict"] for i in range(1, 7)] == ["block", "allow", "block", "block", "block", "block"] and got[4]["component"] == got[6]["component"] != got[5]["component"]


@pytest.mark.parametrize(("path", "want"), [("", "/"), ("/", "/"), ("/a/./b/../c", "/a/c"), ("/..", "/"), ("/a/..", "/"), ("/a/.", "/a/"), ("/a/b/../../..", "/"), ("/.a/..b/c.", "/.a/..b/c.")])
def test_plain_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(urls.plain_path(F.col("p"))).first()[0] == want


def test_hub_of_many_aliases(spark):
    """1,000 pages that name one blocked hub, one of them explicitly allowed, and as many of a hub without one."""
    canonical = '<link rel="canonical" href="{}">'.format
    rows = [(i, f"http://s{i}.net/", canonical("http://h.com/de/" + "ab"[i % 2])) for i in range(2000)] + [(5000, "http://x.org/", canonical("http://h.com/de/a"))]
    got = judged(spark, [(*r[:2], r[2]) for r in rows])
    assert {got[i]["verdict"] for i in range(0, 2000, 2)} == {"allow"} and {got[i]["verdict"] for i in range(1, 2000, 2)} == {"block"}


def test_urls_of_nothing(spark):
    assert urls.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def measures(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    at = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(at)


TEXTS = [None, "", " \t\n", "a b c d e a b c d e", "a " * 40, "one\none\n\n\ntwo\none", "# * x|y <z> é b\x0b\x0cq", words(30) + " " + words(7), "x" * 5000, "\U0001f600 a", words(12) + "\n" + words(12)]


def test_quality_measures(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 7), (None, "a", 7)]
    got = quality.apply_policy(quality.rule_ledger(spark.createDataFrame(rows, "doc_id long, text string, n_words int"))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            want = measures(TEXTS[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["base_failed"] and r["kept"])
    assert quality.rule_ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, TEXTS[3], 7, "x", 9)], "doc_id long, text string, N_Words int, row string, _words int")
    got = quality.measure(clash)
    assert got.columns == ["doc_id", "text", "row", "_words", *quality.MEASURES] and (got.first()["n_words"], got.first()["row"], got.first()["_words"]) == (10, "x", 9)


def test_ablations(spark):
    rows = [(1, "a b"), (2, "# $ % " * 30), (3, words(50)), (4, "a b c d e " * 30)]
    ledger = quality.rule_ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["rule"]: (r["fails"], r["rejects_alone"]) for r in quality.ablations(ledger).collect()}
    assert got["few_words"] == (1, 1) and got["repeats"] == (2, 2) and got["symbols"][0] == 0


def test_very_long_text(spark):
    text = words(120_000) + "\n" + words(20)
    r = quality.rule_ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_repeat_words"]) == (120_020, 40)
