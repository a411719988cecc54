"""The toolkit's entry points, bound to a session and its stores."""

from __future__ import annotations

import asyncio
import json
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import export
from newsloom.functions.extract import extract_article
from newsloom.operators import summarize as S
from newsloom.operators.cluster import cluster_articles
from newsloom.operators.filters import filter_articles
from newsloom.operators.graph import work_dir, written
from newsloom.operators.rank import rank_articles
from newsloom.plans.pipeline import run_pipeline
from newsloom.plans.requests import FetchRequest, SearchRequest
from newsloom.schema import ARTICLE, conform
from newsloom.sources import feeds
from newsloom.sources.crawl import crawl_site
from newsloom.sources.tables import page_store
from newsloom.streaming.unseen import emit_batch


@dataclass
class Newsroom:
    """``transport`` gives payloads for URLs (default: live HTTP); ``pages`` (url, html) is
    the page store for extraction and crawls; ``redirects`` (url, target) resolves links;
    ``tiers`` names the providers to ask (default: all that the environment leaves on)."""

    spark: SparkSession
    transport: feeds.Transport = feeds.from_http
    pages: DataFrame | None = None
    redirects: DataFrame | None = None
    robots: DataFrame | None = None
    tiers: tuple[str, ...] | None = None
    as_of: Column | None = None

    @property
    def _store(self) -> DataFrame | None:
        return None if self.pages is None else page_store(self.pages)

    def _run(self, rows: DataFrame, r: Any, **more: Any) -> DataFrame:
        return run_pipeline(
            rows, r.max_results, r.language, search_in=r.search_in, whitelist=r.whitelist, blacklist=r.blacklist,
            sort_by=r.sort_by, full_content=r.full_content, store=self._store, as_of=self.as_of,
            redirects=self.redirects, **more
        )

    def fetch(self, *, async_: bool = False, **request: Any) -> Any:
        """Stories of a category or location; with ``refresh_interval`` an iterator of the
        unseen ones of each poll; with ``async_`` an awaitable."""
        r = FetchRequest(**request)
        return self._dispatch(r, lambda: self._run(feeds.fetch_lazy(self.spark, r, self.transport, self.redirects, self.tiers), r), async_)

    def search(self, query: str, *, async_: bool = False, **request: Any) -> Any:
        r = SearchRequest(query=query, **request)
        plan = lambda: self._run(
            feeds.search_raw(self.spark, r, self.transport, self.redirects), r, query=r.query,
            query_mode=r.query_mode, exclude_terms=r.exclude_terms
        )
        return self._dispatch(r, plan, async_)

    def _dispatch(self, r: Any, plan: Callable[[], DataFrame], async_: bool) -> Any:
        if r.refresh_interval is not None:
            if async_:
                raise ValueError("a stream can't be asynchronous")
            return self._poll(plan, r.refresh_interval)
        return asyncio.to_thread(plan) if async_ else plan()

    def _poll(self, plan: Callable[[], DataFrame], seconds: int, sleep: Callable[[float], None] | None = None) -> Iterator[DataFrame]:
        """Each poll's fresh stories are written, and their keys go to a table: neither
        the plan nor the session's memory grows with the number of polls."""
        import time

        folder = work_dir(self.spark, "polls")
        for number in range(1 << 62):
            fresh: list[DataFrame] = []
            emit_batch(plan(), number, f"{folder}/seen", lambda df, n, to=fresh: to.append(written(df, f"{folder}/fresh-{n}")))
            if fresh:
                yield fresh[0].orderBy("_ord")
            (sleep or time.sleep)(max(5, seconds))

    stream_fetch = fetch
    stream_search = search

    def search_site(
        self,
        keyword: str,
        domain: str,
        limit: int = 10,
        query_mode: str = "any",
        language: str | None = None,
        full_content: bool = False
    ) -> DataFrame:
        wide = SearchRequest(query=keyword, max_results=limit * 2, query_mode=query_mode, language=language)
        rows = feeds.search_raw(self.spark, wide, self.transport, self.redirects, site=domain)
        return run_pipeline(
            rows, limit, language, query=keyword, query_mode=query_mode, full_content=full_content, store=self._store,
            as_of=self.as_of
        )

    def from_rss(self, feed_url: str, limit: int = 20) -> DataFrame:
        return feeds.from_rss(self.spark, feed_url, self.transport, limit, self.redirects)

    def discover_rss_feed(self, url: str) -> str | None:
        page = self.transport(self.spark, [url]).where(F.col("payload").isNotNull()).first()
        return feeds.discover_feed(page["payload"], url) if page else None

    def crawl_site(self, start_url: str, **how: Any) -> DataFrame:
        if self.pages is None:
            raise ValueError("a crawl needs a page store")
        return crawl_site(self.pages, start_url, robots=self.robots, **how)

    def discover_and_get(
        self,
        website_url: str,
        limit: int = 10,
        js: bool = False,
        max_pages: int | None = None,
        max_depth: int | None = None,
        prefer_rss: bool = True,
        full_content: bool = False
    ) -> DataFrame:
        """The site's feed if it has one with entries, else a crawl."""
        if prefer_rss and (feed := self.discover_rss_feed(website_url)):
            rows = self.from_rss(feed, limit * 3)
            if not rows.isEmpty():
                return run_pipeline(rows, limit, full_content=full_content, store=self._store, as_of=self.as_of)
        found = conform(self.crawl_site(website_url, max_pages=max_pages, max_depth=max_depth, js=js), ARTICLE)
        return run_pipeline(found, limit, as_of=self.as_of)

    def get_article(self, url: str) -> dict[str, Any]:
        page = self.transport(self.spark, [url]).first()
        out = extract_article(page["payload"], url) if page and page["payload"] else extract_article("", None) | {"source": feeds.host(url)}
        return out | {"url": url, "source": out["source"] or feeds.host(url)}

    def batch_summarize(self, urls: list[str], **how: Any) -> DataFrame:
        if self.pages is None:
            raise ValueError("summaries need a page store")
        frame = self.spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "_ord long, url string")
        return S.batch_summarize(frame, self._store, **how)

    def search_and_summarize(self, query: str, limit: int = 10, **how: Any) -> DataFrame:
        return S.search_and_summarize(self.search(query, max_results=limit), self._store, **how)

    # older names
    def fetch_article(self, url: str) -> dict[str, Any]:
        warnings.warn("use get_article", DeprecationWarning, stacklevel=2)
        return self.get_article(url)

    def get_articles_from_website_rss(self, url: str, limit: int = 20) -> DataFrame:
        warnings.warn("use from_rss", DeprecationWarning, stacklevel=2)
        return self.from_rss(url, limit)

    fetch_and_summarize_batch = batch_summarize
    fetch_and_summarize_search_results = search_and_summarize


EXPORTERS = {"csv": export.to_csv, "json": export.to_json, "jsonld": export.to_jsonld, "markdown": export.to_markdown, "text": export.to_text}


def frame_of(spark: SparkSession, items: list[dict[str, Any]]) -> DataFrame:
    """Article dicts as a frame in their order."""
    rows = [json.dumps({"_ord": i} | {k: v for k, v in x.items() if k in ARTICLE.names and k != "_ord"}) for i, x in enumerate(items)]
    return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", ARTICLE).alias("r")).select("r.*")


def rows_of(df: DataFrame, key: str = "_ord") -> list[dict[str, Any]]:
    """A bounded result as dicts, in order."""
    return [json.loads(x) for x in df.orderBy(key).drop("_ord" if key == "_ord" else "").toJSON().collect()]


def tools(room: Newsroom) -> dict[str, Callable[..., Any]]:
    """The functions a tool server offers, by name; results are plain data."""
    spark = room.spark
    return {
        "search_news": lambda query, country="US", **how: rows_of(room.search(query, country=country, **{"max_results": 10, **how})),
        "fetch_news": lambda **how: rows_of(room.fetch(**{"max_results": 10, **how})),
        "get_article": room.get_article,
        "search_site_news": lambda keyword, domain, **how: rows_of(room.search_site(keyword, domain, **how)),
        "discover_site_news": lambda url, **how: rows_of(room.discover_and_get(url, **how)),
        "summarize_articles": lambda urls, **how: rows_of(room.batch_summarize(urls, **how)),
        "summarize_text_content": lambda text, sentence_count=3: S.summarize(
            spark.createDataFrame([(0, text)], "_ord long, text string"), sentence_count=sentence_count
        ).first()["summary"],
        "filter_news": lambda items, **how: rows_of(filter_articles(frame_of(spark, items), **how)),
        "rank_news": lambda items, query, **how: [r.asDict(True) for r in rank_articles(frame_of(spark, items), query, **how).collect()],
        "cluster_news": lambda items, threshold=0.72, **how: rows_of(
            cluster_articles(frame_of(spark, items), threshold, as_of=room.as_of, **how), "id"
        ),
        "export_news": lambda items, format="json", **how: EXPORTERS[format](frame_of(spark, items), **how),
    }
