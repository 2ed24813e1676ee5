from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from chromill.functions import html as h
from chromill.functions.urls import join_url
from chromill.operators import scrape as s


def test_join_url_equals_the_library(spark):
    bases = ["http://h.org/a/b/c.html?x=1#f", "https://h.org", "https://h.org/", "http://h.org/a/"]
    urls = ["i.jpg", "/i.jpg", "//c.org/i.jpg", "https://o.org/i", "?q=2", "../i.jpg", "../../../i.jpg", "./i.jpg", "d/./e/../i.jpg", "data:x", "#top"]
    df = spark.createDataFrame([(b, u) for b in bases for u in urls], "b string, u string").withColumn("j", join_url(F.col("b"), F.col("u")))
    for r in df.collect():
        if (r.b, r.u[0]) != ("https://h.org", "?"):
            assert r.j == urljoin(r.b, r.u), r
    assert spark.createDataFrame([("http://h", "")], "b string, u string").select(join_url(F.col("b"), F.col("u"))).first()[0] == ""


CASES = [
    ('<meta property="og:image" content="/o.jpg"><meta name="twitter:image" content="t.jpg">', "http://h/o.jpg", "og:image"),
    ('<meta property="og:image" content=""><meta property="og:image" content="late.jpg"><meta content="t.jpg" name="twitter:image">', "http://h/p/t.jpg", "twitter:image"),
    ('<script type="application/ld+json">{"z":{"image":"z.jpg"},"a":{"image":["f.jpg","s.jpg"]}}</script>', "http://h/p/z.jpg", "jsonld"),
    ('<script type="application/ld+json">not json</script><script type="application/ld+json">[{"image":{"url":"u.jpg"}}]</script>', "http://h/p/u.jpg", "jsonld"),
    ('<img src="s.jpg" width="10" height="10"><img data-src="b.jpg" width="200px" height=100><img src="c.jpg" width="200" height="100">', "http://h/p/b.jpg", "fallback:img"),
    ('<img src="s.jpg" width="10" height="10"><img src="n.jpg">', "http://h/p/n.jpg", "fallback:img"),
    ('<script type="application/ld+json"></script><img src="s.jpg" width="10" height="10">', None, "none_found"),
    (None, None, "none_found"),
    ('<meta property="og:image" content="https://x.org/i?a=1&amp;b=2&copy=3&#x2F;z">', "https://x.org/i?a=1&b=2&copy=3/z", "og:image"),
    ('<img alt="x"><img src="a.jpg">', "http://h/p/a.jpg", "fallback:img"),
    ('<img width="900" height="900"><img src="" data-src=""><img src="a.jpg?x&lt;1" width="200" height="100">', "http://h/p/a.jpg?x<1", "fallback:img"),
    ('<!-- <img src="c.jpg"> --><img src="d.jpg">', "http://h/p/d.jpg", "fallback:img"),
    ('<!-- <script type="application/ld+json">{"image":"c.jpg"}</script> --><script type=application/ld+json>{"image":"<!-- x -->d.jpg"}</script>', "http://h/p/<!-- x -->d.jpg", "jsonld"),
    ('<script>"<meta property=og:image content=x.jpg>"</script><img src="d.jpg">', "http://h/p/d.jpg", "fallback:img"),
    ('<script type="application/ld+json">{"image":"","part":{"image":"p.jpg"}}</script><img src="d.jpg">', "http://h/p/d.jpg", "fallback:img"),
    ('<!-- never closed <img src="c.jpg">', None, "none_found"),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, "http://h/p/x", c[0]) for i, c in enumerate(CASES)], "i int, page string, html string")
    found = {r.i: (r.image_url, r.source) for r in s.extract_images(df).collect()}
    assert found == {i: c[1:] for i, c in enumerate(CASES)}


def test_largest_image(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id int, html string")
    assert {r.page_id: (r.src, r.area) for r in s.largest_image(s.image_tags(df)).collect()} == {4: ("b.jpg", 20000), 5: ("n.jpg", 0), 9: ("a.jpg", 0), 10: ("a.jpg?x<1", 20000), 11: ("d.jpg", 0), 13: ("d.jpg", 0), 14: ("d.jpg", 0)}


def test_status(spark):
    rows = [
        ("a", " ", None, "u", "s", 200, None, None, "error", "empty_page_url", ""), ("b", "p", "HTTP 500", None, None, None, None, None, "error", "page_fetch_failed: HTTP 500", ""),
        ("c", "p", None, None, "none_found", None, None, None, "error", "no_image_found", ""), ("d", "p", None, "u", "og:image", 405, 200, None, "ok", "", "u"),
        ("e", "p", None, "u", "og:image", 405, 404, None, "error", "HTTP 404", "u"), ("f", "p", None, "u", "og:image", 403, None, None, "ok", "HEAD returned 403 but image likely valid", "u"),
        ("g", "p", None, "u", "og:image", 429, None, None, "error", "HTTP 429", "u"), ("h", "p", None, "u", "og:image", 200, None, "timeout", "error", "verify_failed: timeout", "u"),
    ]
    df = spark.createDataFrame([r[:8] for r in rows], "filename string, page string, fetch_error string, image_url string, source string, head int, get int, verify_error string")
    got = {r.filename: (r.status, r.notes, r.image_url) for r in s.row_status(df).collect()}
    assert got == {r[0]: r[8:] for r in rows}
    assert {r.filename: r.status for r in s.row_status(df, robust=True).collect()}["g"] == "ok"


def test_resume_positions_and_batches(spark):
    rows = spark.createDataFrame([(i, f"{i}.jpg") for i in range(10)], "pos int, filename string")
    prior = spark.createDataFrame([("1.jpg", "ok"), ("2.jpg", "error")], "filename string, status string")
    assert s.remaining(rows, prior).count() == 8 and s.remaining(rows, prior, retry_errors=True).count() == 9 and s.remaining(rows, None).count() == 10
    assert s.from_key(rows, "filename", "4.jpg").count() == 6 and s.from_key(rows, "filename", "none").count() == 10
    assert s.until_key(rows, "filename", "4.jpg").count() == 4 and s.until_key(rows, "filename", "none").count() == 10
    assert sorted(r.batch for r in s.batch_numbers(rows, [F.col("pos")], 4, existing=1).collect()) == [2] * 4 + [3] * 4 + [4] * 2
    assert [s.batch_size(n) for n in (1, 50, 100, 101, 3841, 16311)] == [2, 2, 1, 2, 39, 164]
    assert [r.pos for r in s.first_wins(rows.withColumn("k", F.col("pos") % 2), ["k"], [F.col("pos")]).orderBy("pos").collect()] == [0, 1]


def test_fetch_and_rates(spark):
    def fetcher(url):
        if "bad" in url:
            raise OSError("refused")
        return f"<p>{url}</p>", None

    got = {r.page: (r.html, r.fetch_error) for r in s.fetch(spark.createDataFrame([("u",), ("bad",), (" ",)], "page string"), fetcher).collect()}
    assert got == {"u": ("<p>u</p>", None), "bad": (None, "refused"), " ": (None, None)}
    empty = spark.createDataFrame([], "status string")
    assert tuple(s.success_rate(empty).first()) == (0, 0, None)


def test_details_and_cleaning(spark):
    m = spark.createDataFrame([(["a: x:y", "b:1", "a: z"],)], "items array<string>").select(h.detail_map(F.col("items"))).first()[0]
    assert m == {"a": " z", "b": "1"}
    assert h.list_items("<ul><li>a: <b>b</b></li><li> c </li></ul>") == ["a: b", "c"]
    raw = spark.createDataFrame([(0, 'url("x")'), (1, "none"), (2, None), (3, "plain")], "pos int, image string")
    assert [(r["index"], r.image, r.filename) for r in s.clean_crawl(raw).orderBy("pos").collect()] == [(0, "x", "0.jpg"), (2, None, "2.jpg"), (3, None, "3.jpg")]


@pytest.mark.parametrize(("text", "want"), [("12.5px", 125), ("100%", 100), ("auto", None), (None, None)])
def test_dimension(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(h.dimension(F.col("t"))).first()[0] == want


def test_nothing_is_cut_off(spark):
    deep = "/".join(f"s{i}" for i in range(10_050))
    df = spark.createDataFrame([(f"http://h/{deep}/x.html", "../i.jpg", "k:" + ":".join(map(str, range(1200))))], "b string, u string, item string")
    r = df.select(join_url(F.col("b"), F.col("u")).alias("j"), h.detail_map(F.array("item")).alias("m")).first()
    assert r.j == urljoin(f"http://h/{deep}/x.html", "../i.jpg") and r.m == {"k": "".join(map(str, range(1200)))}


def test_backoff_equals_a_fold(spark):
    rows = [(i % 3, i, (200, 429, 403, 429, 429, 200, 429)[(i * i) % 7]) for i in range(400)]
    got = {r.host: (r.n_attempts, r.backoff) for r in s.backoff(spark.createDataFrame(rows, "host int, ts int, status int").repartition(7), order=("ts",)).collect()}
    for host in range(3):
        value, own = 1.0, [x for x in rows if x[0] == host]
        for _, _, status in own:
            value = max(value * 0.9, 0.5) if status == 200 else min(value * 1.5, 5.0) if status == 429 else value
        assert got[host] == (len(own), pytest.approx(value))
