import csv
import datetime as dt
import io
import json

import pytest
from pyspark.sql import functions as F

from newsloom import cli, export
from newsloom.api import Newsroom, frame_of, tools
from newsloom.functions.dom import links, parse
from newsloom.functions.extract import clean_author, extract_article, extract_articles, is_junk_image, syndicated
from newsloom.operators import feed as P
from newsloom.operators import summarize as S
from newsloom.operators.cache import CacheKeyError, EncryptedCache, InvalidUserProfile, UserProfile, load_user_profile, store_user_profile
from newsloom.operators.cluster import cluster_articles, cluster_to_article
from newsloom.plans.requests import FetchRequest, SearchRequest, locale, provider_query
from newsloom.sources import feeds
from newsloom.sources.crawl import crawl_site
from newsloom.streaming.unseen import emit_batch, only_unseen, read_seen, stream_unseen



def AS_OF():  # noqa: N802
    return F.lit("2024-02-01 00:00:00").cast("timestamp")

COLUMNS = "_ord long, title string, url string, source string, published string, description string, text string"
BODY = "<p>" + "The council said that the plan for the bridge was not in the budget and that this was from the past. " * 4 + "</p>"


def test_extraction_by_structured_data():
    page = """<?xml version="1.0"?><html lang="en-GB"><head><script type="application/ld+json">{"@graph":[{"@type":"WebPage","headline":"no"},
    {"@type":"NewsArticle","headline":" Bridge plan ","author":[{"name":"By Jane Roe, Reporter"},"X"],"datePublished":"2024-01-02T03:04:05+02:00","image":{"url":"/a.jpg"},
    "publisher":{"name":"Daily"},"articleSection":["Local"]}]}</script><meta property="og:description" content="From tags"></head><body><h1>Other</h1>%s</body></html>""" % BODY
    a = extract_article(page, "https://d.com/2024/01/02/x")
    assert (a["title"], a["authors"], a["publish_date"], a["category"]) == ("Bridge plan", ["Jane Roe"], "2024-01-02T01:04:05+00:00", "Local")
    assert (a["description"], a["source"], a["top_image"], a["meta"]["language"]) == ("From tags", "Daily", "https://d.com/a.jpg", "en")
    assert a["text"].startswith("The council said") and a["_field_sources"]["title"] == "json_ld" and a["_field_sources"]["text"] == "heuristic"


def test_extraction_by_page():
    page = f"<html><head><title>Long headline of the day | Site</title></head><body><nav><a href='/x'>menu</a></nav><article>{BODY}<footer>foot</footer></article><time datetime='2024-03-04'></time></body></html>"
    a = extract_article(page, "https://site.org/city-news/1")
    assert (a["title"], a["category"], a["source"], a["publish_date"]) == ("Long headline of the day", "City News", "Site", "2024-03-04T00:00:00")
    assert "menu" not in a["text"] and "foot" not in a["text"]
    assert clean_author("By SPORTS DEPARTMENT NEWS") is None and is_junk_image("https://e.com/logo-1.png")


def test_unclosed_tags_and_links(spark):
    doc = parse("<ul><li>a<li>b</ul><p>one<p>two <b>x<div>d</div>")
    assert [n.text() for n in doc.below("li")] == ["a", "b"] and [n.text().strip() for n in doc.below("p")] == ["one", "two x"]
    assert links("<a href='/a'>x</a><a href='#t'>y</a><a href='mailto:q'>z</a><a href='b.html'>w</a>", "https://e.com/d/") == ["https://e.com/a", "https://e.com/d/b.html"]
    df = spark.createDataFrame([("https://e.com/a", None), ("https://e.com/b", f"<article>{BODY}</article>")], "url string, html string")
    assert [bool(r["text"]) for r in extract_articles(df).orderBy("url").collect()] == [False, True]


def test_syndicated_source():
    page = f"<html><head><link rel='canonical' href='https://www.the-herald.com/x'></head><body>{BODY}</body></html>"
    meta = extract_article(page, "https://www.msn.com/en-us/x")["meta"]
    assert extract_article(page, "https://www.msn.com/en-us/x")["source"] == "The Herald" and meta["source_is_aggregator"] and meta["source_resolved"]


def test_syndicator_column(spark):
    df = spark.createDataFrame([("https://www.msn.com/x",), ("https://de.yahoo.com/y",), ("https://notmsn.com/",)], "u string")
    assert [r[0] for r in df.select(syndicated(F.col("u"))).collect()] == [True, True, False]


def test_crawl(spark):
    site = "https://s.com"
    pages = spark.createDataFrame(
        [
            (site + "/", "<a href='/a'>1</a><a href='/b'>2</a><a href='/tag/x'>t</a><a href='https://o.com/z'>o</a>"),
            (site + "/a", f"<h1>A</h1><article>{BODY}</article><a href='/c'>3</a>"),
            (site + "/b", "<p>short</p>"),
            (site + "/c", f"<h1>C</h1><article>{BODY}</article><a href='/d'>4</a>"),
            (site + "/d", f"<h1>D</h1><article>{BODY}</article>"),
        ],
        "url string, html string",
    )
    assert sorted(r["title"] for r in crawl_site(pages, site + "/").collect()) == ["A", "C"]
    robots = spark.createDataFrame([(site, "User-agent: *\nDisallow: /c")], "origin string, body string")
    assert [r["title"] for r in crawl_site(pages, site + "/", robots=robots).collect()] == ["A"]


CARDS = "<div class='newsitem x' data-title='T1' data-author='Reuters' url='https://a.com/x'><span aria-label='3 hours ago'></span><div class='snippet'>snip</div></div><div class='newsitem' data-title='Hub' url='https://a.com/'></div>"
LIST = "<div id='web'><ul><li><h4><a href='https://r.y.com/RU=https%3a%2f%2fb.com%2fx/RK=1'>T 2</a></h4><p>desc</p><span class='time'>2 days ago</span><span class='source'>Src ·  via Yahoo News</span></li></ul></div>"
RSS = "<rss><channel><title>Feed</title><item><title>H - Paper</title><link>https://p.com/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><description>&lt;b&gt;x&lt;/b&gt; &amp;amp; y</description></item><item><title>no link</title></item></channel></rss>"


def test_parsers():
    now = dt.datetime(2024, 1, 10, tzinfo=dt.UTC)
    assert feeds.parse_card_page(CARDS, now)[0] == {"title": "T1", "url": "https://a.com/x", "source": "Reuters", "published": "2024-01-09T21:00:00+00:00", "description": "snip"}
    assert feeds.parse_list_page(LIST, now)[0] == {"title": "T 2", "url": "https://b.com/x", "source": "Src", "published": "2024-01-08T00:00:00+00:00", "description": "desc"}
    assert feeds.parse_search_feed(RSS, now)[0]["source"] == "Paper"
    assert feeds.parse_plain_feed(RSS, now) == [{"title": "H - Paper", "url": "https://p.com/1", "source": "Feed", "published": "Tue, 02 Jan 2024 03:04:05 GMT", "description": "x & y"}]
    assert feeds.parse_news_feed(RSS, now)[0]["published"] == "2024-01-02T03:04:05+00:00"
    assert feeds.discover_feed("<link type='application/rss+xml' href='/f.xml'>", "https://e.com/") == "https://e.com/f.xml"


def test_tiers_fall_through(spark):
    r = FetchRequest(category="tech", location="in")
    urls = {t.name: t.request(r) for t in feeds.TIERS}
    store = spark.createDataFrame([(urls["bing"], CARDS), (urls["yahoo"], LIST)], "url string, payload string")
    for fetch in (feeds.fetch_raw, feeds.fetch_lazy):
        rows = fetch(spark, r, feeds.from_store(store)).collect()
        assert [(x["title"], x["_tier"], x["_aggregator_source"]) for x in rows] == [("T1", "bing", True)]
    assert [x["title"] for x in feeds.fetch_raw(spark, r, feeds.from_store(store), enabled=("yahoo",)).collect()] == ["T 2"]


def test_fetch_asks_one_tier_at_a_time_and_once(spark):
    r = FetchRequest(category="tech", location="in")
    urls = {t.name: t.request(r) for t in feeds.TIERS}
    store = feeds.from_store(spark.createDataFrame([(urls["yahoo"], LIST)], "url string, payload string"))
    asked = []
    room = Newsroom(spark, transport=lambda s, u: (asked.extend(u), store(s, u))[1])
    assert [x["title"] for x in room.fetch(category="tech", location="in").collect()] == ["T 2"]
    names = [t.name for t in feeds.TIERS]
    assert asked == [urls[n] for n in names[: names.index("yahoo") + 1]]
    asked.clear()
    Newsroom(spark, transport=room.transport, tiers=("yahoo",)).fetch(category="tech", location="in")
    assert asked == [urls["yahoo"]]


def test_tier_switches(monkeypatch):
    monkeypatch.setenv("NEWSLOOM_TIER_BING", "off")
    assert "bing" not in [t.name for t in feeds.enabled_tiers()] and [t.name for t in feeds.enabled_tiers(("bing",))] == ["bing"]


def test_http_source_retries_and_posts():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            seen.append((self.command, self.path, body.decode(), self.headers["User-Agent"]))
            self.send_response(503 if len([x for x in seen if x[1] == self.path]) < 3 else 200)
            self.end_headers()
            self.wfile.write(b"payload")

        do_GET = do_POST = answer

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = [f"{base}/a?q=1", f"POST {base}/b?q=x+y&kl=us"]
    reader = feeds._HttpReader({"urls": "\n".join(urls), "pause": "0.01"})
    assert [x for p in reader.partitions() for x in reader.read(p)] == [(u, "payload") for u in urls]
    assert [x[:3] for x in seen] == [("GET", "/a?q=1", "")] * 3 + [("POST", "/b", "q=x+y&kl=us")] * 3 and len({x[3] for x in seen}) > 1
    seen.clear()
    reader.tries = 2
    assert [x for p in reader.partitions()[:1] for x in reader.read(p)] == [(urls[0], None)] and len(seen) == 2
    server.shutdown()


def test_requests():
    assert provider_query(SearchRequest(query='ai "big bank"', exclude_terms=["x y"], start_date="2024-01-01", end_date="2024-01-31")) == '(ai OR "big bank") -"x y" after:2024-01-01 before:2024-02-01'
    assert provider_query(SearchRequest(query="a b", query_mode="all", time_limit="w")) == "a b when:7d"
    assert locale("in", "hi") == "hl=hi-IN&gl=IN&ceid=IN%3Ahi"
    for bad in ({"query": " "}, {"query": "a", "time_limit": "y"}, {"query": "a", "sort_by": "popularity"}, {"query": "a", "start_date": "2024-02-01", "end_date": "2024-01-01"}, {"query": "a", "search_in": ["x"]}, {"query": "a", "refresh_interval": 2}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)


TEXT = "Rates rose. " + "The central bank raised interest rates again today. " * 3 + "Cats sleep. Interest rates matter for banks and interest grows."


def test_summaries(spark):
    df = spark.createDataFrame([(0, TEXT), (1, "short"), (2, None), (3, "")], "_ord long, text string")
    rows = {r["_ord"]: r for r in S.summarize_with_keywords(df, sentence_count=2).collect()}
    assert rows[0]["summary"] == "The central bank raised interest rates again today. The central bank raised interest rates again today."
    assert rows[0]["keywords"] == ["rates", "interest", "central", "raised", "again"]
    assert (rows[1]["summary"], rows[2]["summary"], rows[3]["coverage"]) == ("short", None, 0.0)
    pages = spark.createDataFrame([("https://a.com/1", TEXT, "T")], "url string, text string, title string")
    urls = spark.createDataFrame([(0, "https://a.com/1"), (1, "http://www.a.com/1/"), (2, "https://b.com")], "_ord long, url string")
    assert [(r["status"], r["error"]) for r in S.batch_summarize(urls, pages).orderBy("_ord").collect()] == [("success", None), ("failed", "Empty text")]


class Memory(dict):
    def get(self, ns, key=None, default=None):
        return dict.get(self, (ns, key), default)

    def set(self, ns, key, value, ttl=None):
        self[ns, key] = value


@pytest.fixture
def stories(spark):
    df = spark.createDataFrame(
        [(0, "bridge plan", "https://a.com/1", "A", "2024-01-31T00:00:00Z", "city bridge", None), (1, "Bridge plan", "https://b.com/1", "Bad", "2024-01-31T12:00:00Z", "x", None), (2, "cup final", "https://c.com/1", "Bad", "2024-01-01T00:00:00Z", "y", None)], COLUMNS
    )
    return cluster_to_article(cluster_articles(df, sort_by="date", as_of=AS_OF()))


def test_personal_feed(stories):
    profile = UserProfile("u", interests=("bridge", "zzz"), preferred_sources=("a",), blocked_sources=("bad",))
    rows = P.rank_personal(stories, profile, P.WEIGHTS, AS_OF()).collect()
    assert len(rows) == 1 and rows[0]["title"] == "bridge plan" and rows[0]["cluster_size"] is None and rows[0]["sources"] is None
    import math

    assert rows[0]["_feed_score"] == round(0.55 / 2 + 0.10 + 0.10 * math.exp(-12 / 48), 6)
    generic = P.rank_generic(stories, AS_OF()).collect()
    assert generic[0]["_feed_score"] == pytest.approx(math.exp(-0.25))


def test_feed_engine(spark):
    cache = Memory()
    engine = P.FeedEngine(cache)
    df = spark.createDataFrame([(0, "t", "https://a.com/1", "A", None, None, None)], COLUMNS)
    with pytest.raises(P.FeedProfileRequiredError):
        engine.build(df, user_id="u", personalized=True)
    store_user_profile(cache, UserProfile("u"))
    assert engine.build(df, user_id="u", personalized=True, as_of=AS_OF()).count() == 1
    assert engine.get_cached_feed("u")["items"][0]["title"] == "t" and engine.get_cached_feed("u", max_age=-1) is None
    assert engine.clear_cached_feed("u") is False and engine.build(df, limit=-3, as_of=AS_OF()).count() == 0
    with pytest.raises(ValueError):
        P.FeedConfig(weights={"nope": 1})


def test_profiles():
    assert UserProfile.from_dict(UserProfile("u", ("a",)).to_dict()) == UserProfile("u", ("a",))
    for bad in ({}, {"user_id": " "}, {"user_id": "x" * 300}, {"user_id": "u", "interests": [""]}, {"user_id": "u", "schema_version": 9}):
        with pytest.raises(InvalidUserProfile):
            UserProfile.from_dict(bad)
    assert load_user_profile(Memory({("user_profile", "u"): {"user_id": "v"}}), "u") is None


def test_encrypted_cache(spark, tmp_path):
    c = EncryptedCache(spark, str(tmp_path / "c"), b"k" * 32)
    assert c.get("n", "a", 7) == 7
    c.set("n", "a", {"x": [1]})
    c.set("n", "a", {"x": [2]})
    c.set("m", "b", 1, ttl=-1)
    assert c.get("n", "a") == {"x": [2]} and c.stats() == {"entries": 2, "expired": 1, "namespaces": ["m", "n"]}
    assert c.exists("m", "b") is False and c.delete("n", "a") is True and c.exists("n", "a") is False
    c.set("n", "z", 1)
    assert EncryptedCache(spark, str(tmp_path / "c"), b"q" * 32).get("n", "z") is None and c.clear_namespace("n") == 1
    with pytest.raises(CacheKeyError):
        EncryptedCache(spark, "x", "")


ITEMS = [{"title": "A, \"q\"", "url": "https://a.com/1", "source": "S", "authors": ["J"], "text": "body", "description": "d", "published": "2024-01-02T03:04:05Z", "_tier": "t"}, {"title": None, "url": None}]


def test_exports(spark, tmp_path):
    df = frame_of(spark, ITEMS)
    rows = list(csv.DictReader(io.StringIO(export.to_csv(df))))
    assert rows[0]["title"] == 'A, "q"' and json.loads(rows[0]["authors"]) == ["J"] and "_tier" not in rows[0] and tuple(rows[0]) == export.CSV_COLUMNS
    found = json.loads(export.to_json(df, str(tmp_path / "a/b.json"), generated_at=dt.datetime(2024, 1, 1, tzinfo=dt.UTC), extra_meta={"q": 1}))
    assert found["count"] == 2 and found["kind"] == "articles" and found["q"] == 1 and "_tier" not in found["articles"][0]
    assert export.read_json_export(spark, str(tmp_path / "a/b.json")).count() == 2
    ld = json.loads(export.to_jsonld(df))["itemListElement"]
    assert ld[0]["item"]["headline"] == 'A, "q"' and ld[0]["item"]["datePublished"] == "2024-01-02T03:04:05Z" and "headline" not in ld[1]["item"]
    md = export.to_markdown(df, max_text_chars=2, generated_at=dt.datetime(2024, 1, 1))
    assert '1. [A, "q"](#1-a-q)' in md and "**Source:** S — **Published:** 2024-01-02 03:04 UTC — **Authors:** J" in md and "bo […]" in md and "## 2. Untitled" in md
    text = export.to_text(df)
    assert text.startswith('Article 1\nTitle: A, "q"\nURL: https://a.com/1\nPublished: 2024-01-02T03:04:05Z') and "\n\n---\n\nArticle 2\nTitle: Untitled" in text
    with pytest.raises(ValueError):
        export.to_text(df, max_text_chars=-1)


def test_cluster_exports(spark):
    clusters = cluster_articles(frame_of(spark, [{"title": "same", "url": "https://a.com/1", "source": "A"}, {"title": "same", "url": "https://b.com/1", "source": "B"}]), as_of=AS_OF())
    assert export.is_clusters(clusters)
    assert "_Cluster of 2 article(s)._" in export.to_markdown(clusters, include_all_members=True) and "Cluster size: 2" in export.to_text(clusters)
    props = {p["name"]: p["value"] for p in json.loads(export.to_jsonld(clusters))["itemListElement"][0]["item"]["additionalProperty"]}
    assert props["clusterSize"] == 2 and props["sources"] == ["A", "B"]
    assert next(csv.DictReader(io.StringIO(export.to_csv(clusters))))["cluster_size"] == "2"


def test_unseen(spark, tmp_path):
    df = spark.createDataFrame([(0, "t", "https://a.com/1"), (1, "u", "http://www.a.com/1/"), (2, "no url", None), (3, "No URL!", ""), (4, None, None)], "_ord long, title string, url string")
    seen, out = str(tmp_path / "seen"), []
    assert [r["_ord"] for r in only_unseen(df, read_seen(spark, seen)).collect()] == [0, 2]
    sink = lambda d, b: out.append((b, [r["_ord"] for r in d.collect()]))
    emit_batch(df, 0, seen, sink)
    emit_batch(df, 0, seen, sink)  # a repeated batch is the same batch
    emit_batch(df, 1, seen, sink)
    assert out == [(0, [0, 2]), (0, [0, 2])]


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "_ord long, title string, url string"
    out = []
    for poll in ([(0, "a", "https://a.com/1")], [(0, "a", "https://a.com/1"), (1, "b", "https://b.com/1")]):
        spark.createDataFrame(poll, schema).coalesce(1).write.mode("append").json(source)
        q = stream_unseen(spark.readStream.schema(schema).json(source), lambda d: d, str(tmp_path / "seen"), str(tmp_path / "cp"), lambda d, b: out.append(sorted(r["title"] for r in d.collect())))
        q.awaitTermination()
    assert out == [["a"], ["b"]]


def test_newsroom_cli_and_tools(spark, tmp_path, capsys):
    url = feeds.search_url(SearchRequest(query="paper"))
    spark.createDataFrame([(url, RSS)], "url string, payload string").write.parquet(str(tmp_path / "p"))
    assert cli.run(cli.build_parser({}).parse_args(["--payloads", str(tmp_path / "p"), "search", "paper", "--json"]), spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["source"] == "Paper"
    assert len(tools(Newsroom(spark))) == 11
    named = tools(Newsroom(spark, as_of=AS_OF()))
    assert [x.get("title") for x in named["filter_news"](ITEMS, query="body", search_in=["body"])] == ['A, "q"', None]
    assert named["cluster_news"]([{"title": "x", "url": "https://a.com/1"}])[0]["size"] == 1
    with pytest.raises(ValueError):
        Newsroom(spark).fetch(refresh_interval=10, async_=True)


def test_latent_term_summaries(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}{c}word" for a in "abcd" for b in "efgh" for c in "ijk"]
    parts = [" ".join(rng.choice(vocabulary, rng.integers(4, 15))).capitalize() + "." for _ in range(12)]
    terms = sorted({w for p in parts for w in p[:-1].lower().split()})
    matrix = np.zeros((len(terms), len(parts)))
    for j, p in enumerate(parts):
        ws = p[:-1].lower().split()
        top = max(map(ws.count, ws))
        for w in ws:
            matrix[terms.index(w), j] = 0.4 + 0.6 * ws.count(w) / top
    _, s, v = np.linalg.svd(matrix, full_matrices=False)
    rank = np.sqrt(((s[:, None] * v) ** 2).sum(axis=0))
    best = sorted(sorted(range(12), key=lambda i: (-round(rank[i], 9), i))[:3])
    df = spark.createDataFrame([(0, " ".join(parts))], "_ord long, text string")
    assert S.summarize(df, method="lsa").first()["summary"] == " ".join(parts[i] for i in best)
    with pytest.raises(ValueError):
        S.summarize(df, method="other")


def test_tool_server(spark):
    from newsloom import server

    room = tools(Newsroom(spark))
    assert set(server.TOOLS) == set(room) and len(room) == 11
    ask = lambda n, method, **params: json.dumps({"jsonrpc": "2.0", "id": n, "method": method, "params": params})
    lines = [
        ask(1, "initialize"),
        json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}),
        ask(2, "tools/list"),
        ask(3, "tools/call", name="summarize_text_content", arguments={"text": TEXT, "sentence_count": 1}),
        ask(4, "tools/call", name="filter_news", arguments={"items": ITEMS, "query": "nothing of the kind"}),
        ask(5, "tools/call", name="export_news", arguments={"items": ITEMS, "format": "no such"}),
        ask(6, "tools/call", name="unknown"),
        ask(7, "other"),
        "{not json",
        "[]",
        "",
    ]
    out = io.StringIO()
    server.serve(room, lines, out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert got[1]["result"]["capabilities"] == {"tools": {}}
    assert {t["name"]: t["inputSchema"]["required"] for t in got[2]["result"]["tools"]}["rank_news"] == ["items", "query"]
    assert got[3]["result"] == {"content": [{"type": "text", "text": "The central bank raised interest rates again today."}], "isError": False}
    assert isinstance(json.loads(got[4]["result"]["content"][0]["text"]), list)
    assert got[5]["result"]["isError"] and got[6]["error"]["code"] == -32602 and got[7]["error"]["code"] == -32601
    assert len(out.getvalue().splitlines()) == 9


def test_cache_compacts(spark, tmp_path):
    cache = EncryptedCache(spark, f"{tmp_path}/c", b"k" * 16)
    for i in range(3):
        cache.set("a", "x", i)
    cache.set("b", "y", "z", ttl=1000)
    cache.set("a", "gone", 1)
    cache.delete("a", "gone")
    cache.compact()
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2
    assert (cache.get("a", "x"), cache.get("b", "y"), cache.get("a", "gone")) == (2, "z", None)
    cache.set("a", "x", 9)
    assert cache.get("a", "x") == 9 and cache.clear_namespace("a") == 1 and cache.get("b", "y") == "z"


def test_poll_plans_stay_small(spark, tmp_path):
    """Polls repeat stories; only unseen ones come, and a plan never holds earlier polls."""
    polls = iter([[1, 2], [2, 3], [3], [1, 4]])
    frame = lambda ids: spark.createDataFrame([(i, f"T{i}", f"https://a.com/{i}") for i in ids], "_ord long, title string, url string")
    room = Newsroom(spark)
    fresh = room._poll(lambda: frame(next(polls)), 5, sleep=lambda s: None)
    got, sizes = [], []
    for _ in range(3):
        df = next(fresh)
        got.append([r["_ord"] for r in df.collect()])
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
    assert got == [[1, 2], [3], [4]] and max(sizes) < 2 * min(sizes)


def test_folder_writers(spark, tmp_path):
    df = frame_of(spark, ITEMS)
    export.write_json(df, f"{tmp_path}/j")
    export.write_jsonld(df, f"{tmp_path}/l")
    assert sorted(str(r["url"]) for r in spark.read.json(f"{tmp_path}/j").collect()) == ["None", "https://a.com/1"]
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/l").collect()]
    assert sorted(x.get("headline", "") for x in lines) == ["", 'A, "q"'] and {x["@type"] for x in lines} == {"NewsArticle"}
