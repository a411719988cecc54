"""Site crawl over a page store, level by level.

A round takes the best ``concurrency`` of the frontier, joins them with the pages, and adds
the unseen links of pages that are not too deep.  Frontier and seen keys are small tables
bounded by the page budget; each round is written to the shared folder.
"""

from __future__ import annotations

from urllib import robotparser
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import urls as U
from newsloom.functions.dom import links
from newsloom.functions.extract import extracted
from newsloom.operators.graph import work_dir, written

AGENT = "newsloom"


def page_links(html: F.Column, url: F.Column) -> F.Column:
    def run(h: pa.Array, u: pa.Array) -> pa.Array:
        return pa.array([links(a, b) if a else [] for a, b in zip(h.to_pylist(), u.to_pylist(), strict=True)], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(html, url)


def allowed(urls: DataFrame, robots: DataFrame | None) -> DataFrame:
    """Rows whose origin's robots.txt (origin, body) admits them; no rules admit all."""
    if robots is None:
        return urls
    origin = F.concat(F.lower(U.part(F.col("url"), "scheme")), F.lit("://"), F.lower(U.part(F.col("url"), "netloc")))

    def run(u: pa.Array, body: pa.Array) -> pa.Array:
        rules: dict[str, robotparser.RobotFileParser] = {}
        out = []
        for url, text in zip(u.to_pylist(), body.to_pylist(), strict=True):
            if not text:
                out.append(True)
                continue
            if text not in rules:
                rules[text] = robotparser.RobotFileParser()
                rules[text].parse(text.splitlines())
            out.append(rules[text].can_fetch(AGENT, url))
        return pa.array(out)

    joined = urls.withColumn("_origin", origin).join(robots.select(F.col("origin").alias("_origin"), F.col("body").alias("_body")), "_origin", "left")
    return joined.where(F.arrow_udf(run, T.BooleanType())("url", "_body")).drop("_origin", "_body")


def crawl(
    pages: DataFrame,
    start_url: str,
    max_pages: int = 40,
    max_depth: int = 2,
    concurrency: int = 10,
    min_text_length: int = 200,
    same_domain_only: bool = True,
    robots: DataFrame | None = None
) -> DataFrame:
    """Articles of a site: (_ord, url, depth and the article fields).  The budget counts
    fetched pages and is tested per round, so a round can overshoot it."""
    spark = pages.sparkSession
    folder = work_dir(spark, "crawl")
    site = urlparse(start_url).netloc
    store = pages.select(F.col("url").alias("_u"), "html", U.normalize_url(F.col("url")).alias("_key")).dropDuplicates(["_key"])
    frontier = spark.createDataFrame([(start_url, 0, 0)], "url string, depth int, n long").withColumn("_key", U.normalize_url(F.col("url")))
    seen = frontier.select("_key")
    found, fetched, step = None, 0, 0
    while fetched < max_pages:
        order = Window.orderBy((~U.looks_like_article(F.col("url"))).cast("int"), "n") if step else Window.orderBy("n")
        ranked = written(frontier.withColumn("_rn", F.row_number().over(order)), f"{folder}/{step}-frontier")
        batch = ranked.where(F.col("_rn") <= concurrency)
        if batch.isEmpty():
            break
        able = allowed(batch.where(U.crawlable(F.col("url"))), robots)
        got = able.join(store, "_key").select(
            "_key", "url", "depth", "_rn", page_links(F.col("html"), F.col("url")).alias("links"),
            extracted(F.col("html"), F.col("url")).alias("a")
        )
        got = written(got, f"{folder}/{step}-pages")
        fetched += got.count()
        articles = got.where(F.length("a.text") >= min_text_length).select(
            (F.lit(step) * (1 << 20) + F.col("_rn")).cast("long").alias("_ord"), "url", "depth", "a.*"
        )
        found = articles if found is None else found.unionByName(articles)
        out = got.where(F.col("depth") < max_depth).select("depth", "_rn", F.posexplode("links").alias("_p", "url"))
        if same_domain_only:
            out = out.where(U.part(F.col("url"), "netloc") == site)
        new = out.withColumn("_key", U.normalize_url(F.col("url"))).groupBy("_key").agg(
            F.min(F.struct("_rn", "_p", "url", "depth")).alias("r")
        ).join(seen, "_key", "left_anti")
        new = written(
            new.select(
                "_key", "r.url", (F.col("r.depth") + 1).alias("depth"),
                (F.lit(step + 1) * (1 << 40) + F.col("r._rn") * (1 << 20) + F.col("r._p")).alias("n")
            ),
            f"{folder}/{step}-new"
        )
        seen = written(seen.union(new.select("_key")), f"{folder}/{step}-seen")
        rest = ranked.where(F.col("_rn") > concurrency).select("url", "depth", "n", "_key")
        frontier, step = rest.unionByName(new.select("url", "depth", "n", "_key")), step + 1
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField("_ord", T.LongType()), T.StructField("url", T.StringType())]))
    return found


def crawl_site(pages: DataFrame, start_url: str, max_pages: int | None = None, max_depth: int | None = None, js: bool = False, **how) -> DataFrame:
    """The budgets of the plain and the rendering mode, where none is given."""
    pages_, depth = (15, 1) if js else (40, 2)
    how = how | ({"concurrency": 1} if js else {})
    return crawl(pages, start_url, pages_ if max_pages is None else max_pages, depth if max_depth is None else max_depth, **how)
