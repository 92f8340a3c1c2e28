import hashlib

import pytest
from pyspark.sql import functions as F

from cohortry.functions import text as X
from cohortry.operators import metrics as M
from cohortry.operators import web as B


def values(spark, items, build, kind="string"):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)]
    names = ["a", "b", "c", "d"][: len(rows[0]) - 1]
    frame = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} {kind}" for n in names))
    return [r[0] for r in frame.orderBy("i").select(build(*[F.col(n) for n in names])).collect()]


def test_canonical_urls(spark):
    urls = ["http://A.com/x/?utm_source=1&b=2#f", "https://a.com/", "ftp://a.com/x", "https://a.com/p?ref=1"]
    assert values(spark, urls, X.canonical_url) == ["https://A.com/x?b=2", "https://a.com/", None, "https://a.com/p"]
    assert values(spark, [" http://A.com/x/?utm_x=1&b=2#f"], X.canonical_url_kept_scheme) == ["http://a.com/x?b=2"]
    assert values(spark, ["http://a.com/x"], X.url_id) == [hashlib.sha256(b"http://a.com/x").hexdigest()[:16]]


def test_links_resolve_like_a_browser(spark):
    base = "https://a.com/d/e?q=1"
    links = ["/x", "y", "?z=1", "//b.org/w", "http://c.net/", "#top", "mailto:x@y", "", "javascript:void(0)"]
    want = ["https://a.com/x", "https://a.com/d/y", "https://a.com/d/e?z=1", "https://b.org/w", "http://c.net/", None, None, None, None]
    assert values(spark, [(base, x) for x in links], X.resolved) == want


def test_link_scores(spark):
    page = "https://news.example.com/list"
    pairs = [("https://www.example.com/article/2024/123456", page), ("https://www.example.com/", page), ("https://www.example.com/about/us", page), ("https://x.com/a/b/c", page), ("https://www.example.com/a/b.pdf", page), ("https://other.org/a/b/long-slug-of-words", page), (page, page)]
    assert values(spark, pairs, X.link_score) == [1 + 2 + 3 + 2, 1 - 5, -10, -10, -10, 2 + 1, -10]


def test_domains(spark):
    assert values(spark, ["https://www.a.com.cn/x", "https://b.news.example.com/", "https://localhost/"], X.registered_domain) == ["a.com.cn", "example.com", "localhost"]


def test_summaries(spark):
    words = "word " * 100
    cjk = "汉" * 400
    got = values(spark, ["  a \n b ", words, cjk, None], X.short_summary)
    assert got[0] == "a b" and got[1] == ("word " * 60).strip() + "…" and got[2] == "汉" * 300 + "…" and got[3] == ""


def test_times_and_dates(spark):
    got = values(spark, ["2024-01-02 03:04:05", "2024010203", "20240102", "1704164645", "1704164645000", "soon", None], lambda c: F.date_format(X.event_time(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:00:00", "2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-02 03:04:05", None, None]
    found = values(spark, ["on 2024年1月3日, 2023/12/30 and 2024-02-31"], lambda c: F.transform(X.dates_in(c), lambda d: d.cast("string")))
    assert found == [["2024-01-03", "2023-12-30"]]


def test_tags_and_titles(spark):
    m = values(spark, ["a:1#b:x:y#bad#a:2", ""], lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(X.tag_map(c))))))
    assert m == ['{"a":"2","b":"x:y"}', "{}"]
    assert values(spark, ["Ｈｅｌｌｏ， World!", None], X.normal_title) == ["helloworld", None]
    assert values(spark, ["汉字" * 9, "plain words", "123 456", ""], X.language_class) == ["zh", "en", "other", "other"]


def test_scorer_answers(spark):
    good = '{"insight_type": "trend", "thoughts": "t", "tags": ["a", " ", "b", "c"], "score": "7.26"}'
    e = values(spark, [good, good.replace("trend", "?"), good.replace('"t"', '" "'), good.replace('"c"', '""'), "no json"], lambda c: X.enriched(c, ["trend"])["error"])
    assert e == [None, "bad insight_type", "no thoughts", "fewer than 3 tags", "bad insight_type"]
    assert values(spark, [good, '{"score": 11}', "{}"], X.checked_score) == [7.3, None, None]


def test_stores(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, B.upsert(old, new.distinct(), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in B.insert_or_ignore(old, new, ["k"]).collect()] == [(3, "d")]
    with pytest.raises(ValueError, match="repeated"):
        B.resume(new, old, ["k"])


def test_scorer_errors_are_told(spark):
    calls = []

    def scorer(row):
        if row["k"] == 2:
            raise RuntimeError("down")
        return {"s": row["k"] * 1.5}

    rows = B.score_rows(spark.createDataFrame([(1,), (2,)], "k int"), scorer, "s double", attempts=2, model="m").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 1.5, "success", None, "m"), (2, None, "failed", "down", "m")] and not calls


def test_scenarios_and_names(spark):
    s = spark.createDataFrame([("No delivery", ["zero volume"]), ("High cost", ["expensive"])], "scenario string, names array<string>")
    t = spark.createDataFrame([(1, "no-delivery!"), (2, "Zero  Volume"), (3, "no deliveri"), (4, "qqqq"), (5, None)], "id int, text string")
    got = {r["id"]: (r["scenario"], r["match"]) for r in M.scenario_tags(t, s).collect()}
    assert got == {1: ("No delivery", "exact"), 2: ("No delivery", "alias"), 3: ("No delivery", "fuzzy"), 4: (None, "none"), 5: (None, "none")}
    c = spark.createDataFrame([("ctr", "Click rate", "rate"), ("cost", "Cost", "spend")], "code string, name string, alias string")
    v = spark.createDataFrame([("CTR",), ("spend",), ("total cost",), ("zzz",), (None,)], "value string")
    assert {r["value"]: r["code"] for r in M.resolve_names(v, c).collect()} == {"CTR": "ctr", "spend": "cost", "total cost": "cost", "zzz": None}


def test_feed_entries_by_cutoff(spark):
    from cohortry.operators import web as B

    meta = '<meta property="article:published_time" content="{}">'
    rows = [
        (1, "https://x.example/a", meta.format("2024-01-02") + "<p>new</p><img src='i.png'><img class=\"c\" src=\"j.png\">"),
        (2, "https://x.example/2023/3/4/b", "<p>old</p>"),
        (3, "https://x.example/c", "<p>" + "word " * 200 + "</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in B.feed_entries(pages, F.lit("2024-01-01").cast("date")).collect()}
    assert sorted(got) == [1, 3] and got[1]["images"] == ["i.png", "j.png"] and str(got[1]["date"]) == "2024-01-02"
    assert got[3]["date"] is None and len(got[3]["summary"]) == 500 and got[3]["n_content"] == 999


def test_links_equal_those_of_the_standard_library(spark):
    from itertools import product
    from urllib.parse import urljoin

    bases = ["https://a.com", "https://a.com/", "https://a.com/b/c", "https://a.com/b//c/", "https://a.com/b/c/d/e?q=1"]
    heads = ["", "/", "../", "./", "../../../", "/../", "x/../"]
    tails = ["y", "y/", "y//z", "y/..", ".", "..", "y/./z/../w", "a..b/...", "y?p=../q", "y/../z#../f", "é/y z"]
    pairs = [(b, h + t) for b, h, t in product(bases, heads, tails)]
    assert values(spark, pairs, X.resolved) == [urljoin(b, h) for b, h in pairs]


def test_entities(spark):
    given = ["a&amp;b", "&amp;amp;", "&#47;&#x2F;x", "&lt;&gt;&quot;&apos;", "a&b&copy;", "&#128512;&#0;&#xD800;", "plain", None, "&", "&#38;amp;"]
    want = ["a&b", "&amp;", "//x", "<>\"'", "a&b&copy;", "😀&#0;&#xD800;", "plain", None, "&", "&amp;"]
    assert values(spark, [(g, "") for g in given], lambda a, b: X.unescaped(a)) == want


def test_links_of_a_page_by_selector_and_pattern(spark):
    html = """<a data-href="/no" href="/one/a">1</a><A class="more x" HREF = '../two/b?x=1&amp;utm_source=n'>2</A><a class=more href=/three/c/>3</a>
    <abbr href="/no">x</abbr><a name="top">4</a><a class='more' href="/one/a">5</a><a href="mailto:x@y.z">6</a>"""
    pages = spark.createDataFrame([(1, "http://s.org/l/i", html), (2, "http://s.org/", None), (3, "http://s.org/", "")], "page_id long, url string, html string")
    links = lambda **k: [r["link"] for r in B.page_links(pages, **k).orderBy("page_id", "place").collect()]
    assert links() == ["https://s.org/one/a", "https://s.org/two/b?x=1", "https://s.org/three/c", "https://s.org/one/a"]
    assert links(selector=r"\bclass\s*=\s*['\"]?more\b") == ["https://s.org/two/b?x=1", "https://s.org/three/c", "https://s.org/one/a"]
    assert [r["link"] for r in B.article_links(pages, least=-5, pattern="/t[a-z]+/").orderBy("rank").collect()] == ["https://s.org/two/b?x=1", "https://s.org/three/c"]
