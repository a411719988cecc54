import datetime as dt
from urllib.parse import parse_qsl, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions import text as X
from newsloom.functions import urls as U

URLS = [
    "https://www.Example.com/a/b/?utm_source=x&b=2&a=1#frag",
    "http://example.com:80/a/b?a=1&b=2",
    "https://example.com:443/",
    "http://example.com:443/x/",
    "https://e.com/p?q=a+b&r=%7Eu*&empty=&Ref=z",
    "https://e.com/seg;params?x=%C3%A9",
    "HTTP://WWW.e.com",
    "https://e.com/a b/c",
    "not a url",
]


def expected_key(url):
    p = urlparse(url)
    host = p.netloc.lower().removeprefix("www.")
    if host.endswith(":80") and p.scheme == "http":
        host = host[:-3]
    elif host.endswith(":443") and p.scheme == "https":
        host = host[:-4]
    query = urlencode(sorted((k, v) for k, v in parse_qsl(p.query) if k.lower() not in U.TRACKING))
    return f"{host}{p.path.rstrip('/') or '/'}{'?' + query if query else ''}".lstrip("/")


def column(spark, values, fn):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "u string").select(fn(F.col("u")).alias("x")).collect()]


def test_normalised_urls(spark):
    assert column(spark, URLS, U.normalize_url) == [expected_key(u) for u in URLS]
    assert column(spark, [None, ""], U.normalize_url) == [None, ""]


@pytest.mark.parametrize(
    ("url", "hub"),
    [("https://e.com", True), ("https://e.com/", True), ("https://e.com/?p=12", False), ("https://e.com/?x=1", True), ("https://apnews.com/hub/x", True), ("https://apnews.com/article/x", False), ("https://www.msn.com/en-us/news", True), ("", False)],
)
def test_hubs(spark, url, hub):
    assert column(spark, [url], U.is_hub_url) == [hub]


def test_crawl_predicates(spark):
    assert column(spark, ["https://e.com/tag/x", "https://e.com/x/tag/y", "https://e.com/a.PNG", "ftp://e.com/a", "https://e.com/news/page/3/", "https://e.com/ok"], U.crawlable) == [False, True, False, False, False, True]
    assert column(spark, ["https://e.com/2024/01/02/x", "https://e.com/a-b-c-d-e", "https://e.com/a-b", "https://e.com/123456/"], U.looks_like_article) == [True, True, False, True]


def test_names_and_wrapped_links(spark):
    assert column(spark, ["https://www.reuters.com/x", "https://e.com"], U.aggregator_name) == ["Reuters", None]
    assert column(spark, ["hello-wORLD o'neil"], X.title_case) == ["Hello-World O'Neil"]
    wrapped = ["https://r.y.com/RU=https%3a%2f%2fa.com%2fx/RK=2", "//d.com/l/?uddg=https%3A%2F%2Fb.com&x=1", "https://c.com"]
    assert column(spark, wrapped, U.unwrapped_result) == ["https://a.com/x", "https://b.com", "https://c.com"]


def test_redirects(spark):
    rows = spark.createDataFrame([(0, "https://news.google.com/r/1"), (1, "https://x.com/1")], "_ord long, url string")
    table = spark.createDataFrame([("https://news.google.com/r/1", "https://a.com/1"), ("https://x.com/1", "https://no.com")], "url string, target string")
    assert [r["url"] for r in U.resolve(rows, table).orderBy("_ord").collect()] == ["https://a.com/1", "https://x.com/1"]


def test_dates(spark):
    got = column(spark, ["2024-01-02T03:04:05Z", "2024-01-02", "Tue, 02 Jan 2024 03:04:05 EST", "2 Jan 2024 03:04 +0530", "soon", None, ""], lambda c: D.date_text(D.parse_ts(c)))
    assert got == ["2024-01-02T03:04:05+00:00", "2024-01-02T00:00:00+00:00", "2024-01-02T08:04:05+00:00", "2024-01-01T21:34:00+00:00", None, None, None]
    as_of = F.lit("2024-03-01 00:00:00").cast("timestamp")
    assert column(spark, ["2 hours ago", "1 Month ago", "yesterday"], lambda c: D.relative_date(c, as_of)) == ["2024-02-29T22:00:00+00:00", "2024-01-31T00:00:00+00:00", "yesterday"]
    fresh = column(spark, ["2024-02-28 00:00:00", "2024-04-01 00:00:00", None], lambda c: D.freshness(D.parse_iso(c), as_of))
    assert fresh == [pytest.approx(0.36787944), 1.0, 0.0]
    free = column(spark, ["January 5, 2024 3pm EST"], lambda c: D.date_text(D.parse_any(c)))
    assert free == ["2024-01-05T20:00:00+00:00"]


def test_request_dates():
    assert D.day_of(dt.datetime(2024, 1, 2, 3), "d") == "2024-01-02"
    assert D.day_of(" 2024-01-02T00:00:00Z ", "d") == "2024-01-02"
    assert D.day_of("", "d") is None
    with pytest.raises(ValueError, match="start"):
        D.day_of("tomorrow", "start")


def test_nfc(spark):
    assert column(spark, ["é", "abc", None], X.nfc) == ["é", "abc", None]
