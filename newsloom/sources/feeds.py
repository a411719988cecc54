"""News sources: requests to providers, payloads, and parsers from payloads to rows.

A source is a lazy frame of (tier, rank, url, payload).  Payloads come from a store table
(offline, tests, replays) or over HTTP through a Python data source with one partition
per request.  Parsing is an Arrow function over the payload column, so it runs where the
payload is; the URL finaliser and fallback order are column expressions.
"""

from __future__ import annotations

import datetime as dt
import html as _html
import os
import re
import time
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import parse_qs, quote_plus, unquote, unquote_plus, urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type

from newsloom.functions import urls as U
from newsloom.functions.dates import _UNIT_SECONDS
from newsloom.functions.dom import parse
from newsloom.functions.extract import host_of
from newsloom.operators.graph import work_dir, written
from newsloom.plans.requests import FetchRequest, SearchRequest, country_language, locale, provider_query, region_code, region_name, subject_query
from newsloom.schema import RAW, conform

CUT = 500
SEARCH_FEED = "https://news.google.com/rss"
ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "url", "source", "published", "description")])
USER_AGENTS = ("newsloom/0.1 (+batch)", "newsloom/0.1 (+stream)")


def plain(text: str) -> str:
    return _html.unescape(re.sub(r"<[^>]+>", "", text)).strip() if text else ""


def ago(text: str, now: dt.datetime) -> str:
    m = re.search(rf"\b([0-9]+)\s*({'|'.join(_UNIT_SECONDS)})s?\b", text, re.I)
    if m is None:
        return text
    return (now - dt.timedelta(seconds=int(m[1]) * _UNIT_SECONDS[m[2].lower()])).replace(microsecond=0).isoformat()


def rfc822(text: str) -> str:
    from email.utils import parsedate_to_datetime

    try:
        when = parsedate_to_datetime(text)
        return (when.replace(tzinfo=dt.UTC) if when.tzinfo is None else when.astimezone(dt.UTC)).isoformat()
    except (TypeError, ValueError, IndexError):
        return text or ""


def host(url: str) -> str:
    return host_of(url)


def rss_items(xml: str, limit: int | None = None) -> list[dict[str, str]]:
    """title, link, published, summary, source of RSS items or Atom entries."""
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out = []
    for node in root.iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        row: dict[str, str] = {}
        for child in node:
            name = child.tag.rpartition("}")[2]
            text = (child.text or "").strip() or (child.get("href", "") if name == "link" else "")
            row.setdefault(name.lower(), text)
            if name == "source" and not text:
                title = next((x for x in child if x.tag.endswith("title")), None)
                row["source"] = (title.text or "").strip() if title is not None else ""
        out.append(
            {
                "title": row.get("title", ""), "link": row.get("link", ""),
                "published": row.get("pubdate") or row.get("published") or row.get("updated", ""),
                "summary": row.get("description") or row.get("summary", ""), "source": row.get("source", "")
            }
        )
        if limit and len(out) >= limit:
            break
    return out


def parse_search_feed(xml: str, now: dt.datetime) -> list[dict[str, str]]:
    """Search feed: source from the entry, else the title's last part, else the link."""
    rows = []
    for e in rss_items(xml, 200):
        if not e["link"]:
            continue
        tail = e["title"].rpartition(" - ")
        source = e["source"] or (tail[2] if tail[1] else "") or host(e["link"]).partition(".")[0].title()
        rows.append(
            {"title": e["title"] or "No title", "url": e["link"], "source": source, "published": e["published"], "description": e["summary"][:CUT]}
        )
    return rows


def parse_plain_feed(xml: str, now: dt.datetime) -> list[dict[str, str]]:
    """Any RSS or Atom feed: the feed's own title names the source."""
    m = re.search(r"<(?:channel|feed)[^>]*>.*?<title[^>]*>(.*?)</title>", xml, re.S)
    title = plain(re.sub(r"<!\[CDATA\[|\]\]>", "", m[1])) if m else ""
    return [
        {
            "title": e["title"] or "No title", "url": e["link"], "source": title or "Unknown RSS",
            "published": e["published"], "description": plain(e["summary"])[:CUT]
        } for e in rss_items(xml) if e["link"]
    ]


def parse_news_feed(xml: str, now: dt.datetime) -> list[dict[str, str]]:
    return [
        {
            "title": e["title"], "url": e["link"], "source": e["source"] or host(e["link"]),
            "published": rfc822(e["published"]), "description": plain(e["summary"])[:CUT]
        } for e in rss_items(xml) if e["title"] and e["link"]
    ]


def _said(node, *tags: str, has: str = "") -> str:
    found = node.below(*tags, where=lambda n: has in n.get("class"))
    return " ".join(t.strip() for n in found for t in n.texts() if t.strip())


def parse_card_page(html: str, now: dt.datetime) -> list[dict[str, str]]:
    """Result page of cards that hold title, URL and author as attributes."""
    rows = []
    for card in parse(html).below("div", where=lambda n: "newsitem" in n.get("class")):
        title, url = card.get("data-title").strip(), card.get("url").strip()
        if title and url:
            label = next((s.get("aria-label") for s in card.below("span") if "aria-label" in s.attrs), "")
            snippet = " ".join(t.strip() for n in card.below("div", where=lambda n: n.get("class") == "snippet") for t in n.texts() if t.strip())
            rows.append(
                {"title": title, "url": url, "source": card.get("data-author").strip(), "published": ago(label, now), "description": snippet[:CUT]}
            )
    return rows


def parse_list_page(html: str, now: dt.datetime) -> list[dict[str, str]]:
    """Result page of list items with a linked heading; links are wrapped."""
    rows = []
    for item in (li for web in parse(html).below("div", where=lambda n: n.get("id") == "web") for li in web.below("li")):
        anchors = [a for h in item.below("h4") for a in h.children if getattr(a, "tag", "") == "a"]
        title = " ".join(t.strip() for h in item.below("h4") for t in h.texts() if t.strip())
        if not anchors or not title:
            continue
        link = anchors[0].get("href")
        if "/RU=" in link:
            link = unquote_plus(re.search(r"/RU=(.*?)(?:/RK=|[?]|$)", link)[1])
        when = next((t for n in item.below("span", where=lambda n: "time" in n.get("class")) for t in n.texts()), "")
        source = next((t.strip() for n in item.below("span", where=lambda n: "source" in n.get("class")) for t in n.texts()), "")
        rows.append(
            {
                "title": title, "url": link, "source": re.sub(r"\s·  via Yahoo.*", "", source).strip(),
                "published": ago(when, now), "description": _said(item, "p")[:CUT]
            }
        )
    return rows


def parse_plain_page(html: str, now: dt.datetime) -> list[dict[str, str]]:
    """Script-free result page; links carry their target in ``uddg``."""
    rows = []
    for node in parse(html).below("div", where=lambda n: "result" in n.get("class")):
        a = next((x for x in node.below("a") if "result__a" in x.get("class")), None)
        title = a.text().strip() if a else ""
        link = a.get("href") if a else ""
        link = "https:" + link if link.startswith("//") else link
        target = parse_qs(urlparse(link).query).get("uddg")
        link = unquote(target[0]) if target else link
        if title and link:
            snippet = next((x.text().strip() for tag in ("a", "div", "span") for x in node.below(tag) if "result__snippet" in x.get("class")), "")
            rows.append({"title": title, "url": link, "source": "", "published": "", "description": snippet[:CUT]})
    return rows


def parse_api(payload: str, now: dt.datetime) -> list[dict[str, str]]:
    """JSON list of search results with title, url, source, date, body."""
    import json

    try:
        found = json.loads(payload)
    except ValueError:
        return []
    return [
        {
            "title": str(x.get("title") or ""), "url": str(x.get("url") or ""), "source": str(x.get("source") or ""),
            "published": str(x.get("date") or ""), "description": str(x.get("body") or "")[:CUT]
        } for x in found if isinstance(x, dict) and x.get("url")
    ]


@dataclass(frozen=True)
class Tier:
    """A provider: how to ask, how to read the answer, whether hub pages are dropped."""

    name: str
    rank: int
    request: Callable[[FetchRequest], str]
    parser: Callable[[str, dt.datetime], list[dict[str, str]]]
    finalise: bool = True


def _topic_feed(r: FetchRequest) -> str:
    topics = {"general": "", "tech": "TECHNOLOGY"}
    topic = topics.get(r.category, r.category.upper())
    where = region_name(r.location)
    country, language = country_language(r.location)
    tail = locale(country, language) if r.location else locale()
    if topic and not where:
        return f"{SEARCH_FEED}/headlines/section/topic/{topic}?{tail}"
    if where:
        return f"{SEARCH_FEED}/search?q={quote_plus((where + ' ' + (r.category if topic else 'news')).strip())}&{tail}"
    return f"{SEARCH_FEED}?{tail}"


def _span(limit: str) -> str:
    return quote_plus('interval="' + {"d": "7", "w": "8"}.get(limit, "9") + '"')


TIERS = (
    Tier(
        "ddgs", 1,
        lambda r: f"ddgs://news?q={quote_plus(subject_query(r.category, r.location))}&region={region_code(r.location)}&t={r.time_limit}",
        parse_api
    ),
    Tier("google_news", 2, _topic_feed, parse_search_feed, finalise=False),
    Tier(
        "bing", 3,
        lambda r: f"https://www.bing.com/news/infinitescrollajax?q={quote_plus(subject_query(r.category, r.location))}&qft={_span(r.time_limit)}&cc={country_language(r.location)[0]}",
        parse_card_page
    ),
    Tier(
        "bing_rss", 3,
        lambda r: f"https://www.bing.com/news/search?format=RSS&q={quote_plus(subject_query(r.category, r.location))}&qft={_span(r.time_limit)}",
        parse_news_feed
    ),
    Tier("yahoo", 4, lambda r: f"https://news.search.yahoo.com/search?p={quote_plus(subject_query(r.category, r.location))}", parse_list_page),
    Tier(
        "ddg_html", 5,
        lambda r: f"POST https://html.duckduckgo.com/html/?q={quote_plus(subject_query(r.category, r.location))}&kl={region_code(r.location)}",
        parse_plain_page
    ),
)


def request_of(url: str, attempt: int = 0) -> urllib.request.Request:
    """A URL as a request; ``POST url?query`` sends the query as a form."""
    agent = USER_AGENTS[(zlib.crc32(url.encode()) + attempt) % len(USER_AGENTS)]
    if not url.startswith("POST "):
        return urllib.request.Request(url, headers={"User-Agent": agent})
    where, _, form = url.removeprefix("POST ").partition("?")
    return urllib.request.Request(
        where, data=form.encode(), method="POST",
        headers={"User-Agent": agent, "Content-Type": "application/x-www-form-urlencoded"}
    )


@dataclass
class _Ask(InputPartition):
    url: str


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options["urls"].split("\n")
        self.tries, self.timeout, self.pause = int(options.get("tries", 3)), float(options.get("timeout", 15)), float(options.get("pause", 0.5))

    def partitions(self) -> list[_Ask]:
        return [_Ask(u) for u in self.urls]

    def read(self, partition: _Ask) -> Iterator[tuple[str, str | None]]:
        for i in range(self.tries):
            try:
                ask = request_of(partition.url, i)
                with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                    if r.status == 202:
                        time.sleep(min(2**i, 8))
                        continue
                    yield partition.url, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                    return
            except OSError:  # an HTTP error too: the next try has another user agent
                if i + 1 < self.tries:
                    time.sleep(self.pause * 2**i)
        yield partition.url, None


class HttpSource(DataSource):
    """``format("newsloom_http").option("urls", "\\n".join(...))``: (url, payload), one task
    per URL; a failed request has a null payload."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_http"

    def schema(self) -> str:
        return "url string, payload string"

    def reader(self, schema: T.StructType) -> _HttpReader:
        return _HttpReader(dict(self.options))


def from_http(spark: SparkSession, urls: list[str]) -> DataFrame:
    spark.dataSource.register(HttpSource)
    return spark.read.format("newsloom_http").option("urls", "\n".join(urls)).load()


def from_store(store: DataFrame) -> Callable[[SparkSession, list[str]], DataFrame]:
    """A transport that looks payloads up in a table (url, payload)."""
    return lambda spark, urls: store.where(F.col("url").isin(*urls)).select("url", "payload")


Transport = Callable[[SparkSession, list[str]], DataFrame]


def parsed(payloads: DataFrame, parser: Callable[[str, dt.datetime], list[dict[str, str]]], now: dt.datetime | None = None) -> DataFrame:
    """Payload rows as article rows (``_pos``, title, url, source, published, description)."""
    when = now or dt.datetime.now(dt.UTC)
    kind = to_arrow_type(T.ArrayType(ROW))

    def run(column: pa.Array) -> pa.Array:
        out = []
        for p in column.to_pylist():
            try:
                out.append(parser(p, when) if p else [])
            except Exception:  # an unreadable answer is an empty one
                out.append([])
        return pa.array(out, kind)

    rows = payloads.withColumn("_rows", F.arrow_udf(run, T.ArrayType(ROW))("payload")).select(
        *[c for c in payloads.columns if c not in ("payload", "url")], F.posexplode("_rows").alias("_pos", "_r")
    )
    return rows.select(*[c for c in rows.columns if c != "_r"], "_r.*")


def finalised(rows: DataFrame, redirects: DataFrame | None = None, drop_hubs: bool = True) -> DataFrame:
    """Redirects resolved, hub pages dropped, missing sources named after the domain."""
    rows = U.resolve(rows, redirects)
    if drop_hubs:
        rows = rows.where((F.col("url") != "") & ~U.is_hub_url(F.col("url")))
    source = F.when(F.col("source") != "", F.col("source")).otherwise(F.coalesce(U.aggregator_name(F.col("url")), U.domain(F.col("url"))))
    rows = rows.withColumn("source", source)
    return rows.withColumn("_aggregator_source", F.when(U.is_aggregator_source(F.col("source")), F.lit(True)))


def _of_tier(spark: SparkSession, r: FetchRequest, t: Tier, transport: Transport, redirects: DataFrame | None, now: dt.datetime | None) -> DataFrame:
    rows = finalised(parsed(transport(spark, [t.request(r)]), t.parser, now), redirects, t.finalise)
    return rows.select(
        "_pos", F.lit(TIERS.index(t)).alias("_tier_rank"), F.lit(t.name).alias("_tier"), "title", "url", "source",
        "published", "description", "_aggregator_source"
    )


def _first(rows: DataFrame, r: FetchRequest) -> DataFrame:
    return conform(rows.orderBy("_pos").limit(2 * r.max_results).withColumn("_ord", F.col("_pos").cast("long")).drop("_pos", "_tier_rank"), RAW)


def enabled_tiers(enabled: tuple[str, ...] | None = None) -> list[Tier]:
    """The tiers to ask, in order.  Without a list the environment decides: a tier is off
    where ``NEWSLOOM_TIER_<NAME>`` is 0, false, no or off."""
    if enabled is not None:
        return [t for t in TIERS if t.name in enabled]
    off = {"0", "false", "no", "off"}
    return [t for t in TIERS if os.environ.get(f"NEWSLOOM_TIER_{t.name.upper()}", "1").strip().lower() not in off]


def fetch_raw(
    spark: SparkSession,
    r: FetchRequest,
    transport: Transport,
    redirects: DataFrame | None = None,
    enabled: tuple[str, ...] | None = None,
    now: dt.datetime | None = None
) -> DataFrame:
    """Rows of the first tier that has any, at most twice ``max_results``, as one plan
    over a payload table: all tiers' rows carry their rank and only the least is kept.
    A live transport is asked tier by tier instead, see ``fetch_lazy``."""
    union = None
    for t in enabled_tiers(enabled):
        rows = _of_tier(spark, r, t, transport, redirects, now)
        union = rows if union is None else union.unionByName(rows)
    if union is None:
        return spark.createDataFrame([], RAW)
    best = union.agg(F.min("_tier_rank").alias("_best"))
    kept = union.join(F.broadcast(best), F.col("_tier_rank") == F.col("_best"), "left_semi")  # one row
    return _first(kept, r)


def fetch_lazy(
    spark: SparkSession,
    r: FetchRequest,
    transport: Transport,
    redirects: DataFrame | None = None,
    enabled: tuple[str, ...] | None = None,
    now: dt.datetime | None = None
) -> DataFrame:
    """The same result, asking a tier only when those before it gave nothing, and once:
    an answer (one page) is written before it is looked at."""
    for t in enabled_tiers(enabled):
        rows = written(_of_tier(spark, r, t, transport, redirects, now), work_dir(spark, f"tier-{t.name}"))
        if not rows.isEmpty():
            return _first(rows, r)
    return spark.createDataFrame([], RAW)


def search_url(r: SearchRequest, site: str | None = None) -> str:
    query = provider_query(r) + (f" site:{site}" if site else "")
    return f"{SEARCH_FEED}/search?q={quote_plus(query)}&{locale(r.country, r.language)}"


def search_raw(spark: SparkSession, r: SearchRequest, transport: Transport, redirects: DataFrame | None = None, site: str | None = None) -> DataFrame:
    rows = finalised(parsed(transport(spark, [search_url(r, site)]), parse_search_feed), redirects, drop_hubs=False)
    rows = rows.withColumn("_ord", F.col("_pos").cast("long")).withColumn("_tier", F.lit("google_news")).drop("_pos")
    if site:
        rows = rows.where(F.contains(F.lower(U.part(F.col("url"), "netloc")), F.lit(site.lower())))
    return conform(rows.orderBy("_ord").limit(2 * r.max_results), RAW)


def from_rss(spark: SparkSession, feed_url: str, transport: Transport, limit: int = 20, redirects: DataFrame | None = None) -> DataFrame:
    rows = U.resolve(parsed(transport(spark, [feed_url]), parse_plain_feed), redirects)
    return conform(rows.withColumn("_ord", F.col("_pos").cast("long")).drop("_pos").orderBy("_ord").limit(limit), RAW)


def discover_feed(html: str | None, base: str) -> str | None:
    """The page's feed: an alternate link, else an anchor that looks like one."""
    doc = parse(html or "")
    for n in doc.below("link"):
        if n.get("type") in ("application/atom+xml", "application/rss+xml") and n.get("href"):
            return urljoin(base, n.get("href"))
    marks = "/feed /rss /atom .rss .atom".split()
    for a in doc.below("a"):
        if a.get("href") and any(m in urlparse(a.get("href")).path.lower() for m in [*marks, "feed.xml", "rss.xml"]):
            return urljoin(base, a.get("href"))
    return None


def discover_feeds(pages: DataFrame) -> DataFrame:
    """(url, feed) for a page table (url, html)."""

    def run(h: pa.Array, u: pa.Array) -> pa.Array:
        return pa.array([discover_feed(a, b) if a else None for a, b in zip(h.to_pylist(), u.to_pylist(), strict=True)], pa.string())

    return pages.select("url", F.arrow_udf(run, T.StringType())("html", "url").alias("feed"))


def rss_table(spark: SparkSession, path: str) -> DataFrame:
    """RSS files through the built-in XML reader: splittable, one row per item."""
    fields = "title string, link string, pubDate string, description string"
    return spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(fields).load(path)


__all__ = [
    "TIERS", "HttpSource", "discover_feeds", "fetch_lazy", "fetch_raw", "finalised", "from_http", "from_rss",
    "from_store", "parsed", "search_raw"
]
