"""URL columns.  All are built-in expressions over an RFC 3986 split; nothing throws on
a malformed URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import title_case

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Query parameters that say where a click came from, not which page it is.
TRACKING = frozenset(
    ("ref ref_src ito smid igshid gclid fbclid " + " ".join(f"utm_{x}" for x in ("content", "term", "campaign", "medium", "source"))).split()
)
_ID_KEYS = "aid nid newsid story article page_id p".split()
AGGREGATOR_NAMES = frozenset(
    x.strip() for x in "smartnews|newsbreak|news break|flipboard|msn news|msn|yahoo news|reuters|associated press|ap news|google news".split("|")
)
AGGREGATOR_HOSTS = dict(
    x.split("=") for x in "smartnews.com=SmartNews|newsbreak.com=NewsBreak|flipboard.com=Flipboard|msn.com=MSN|news.yahoo.com=Yahoo News|reuters.com=Reuters|apnews.com=AP News|news.google.com=Google News".split("|")
)
_HUBS = {
    "flipboard.com": r"/topic/",
    "apnews.com": r"/(?:tag|hub)/",
    "reuters.com": r"/(?:section|topic)/",
    "news.google.com": r"/topics/|/rss/?$",
    "news.yahoo.com": r"/topic/|/rss/?$",
    "msn.com": r"/en-us/news(?:/other)?/?$",
    "abplive.com": r"/(?:live|tv)",
    "zeenews.india.com": r"/(?:live|tv)",
}
_REDIRECT_HOST = "news.google.com"


def part(url: Column, which: str) -> Column:
    """scheme, netloc, path or query of a URL, '' where missing."""
    n = ("scheme", "netloc", "path", "query").index(which) + 1
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, n)
    return F.regexp_replace(found, ";[^/]*$", "") if which == "path" else found


def decoded(c: Column) -> Column:
    """Percent and plus decoding; text that is not decodable stays."""
    return F.coalesce(F.try_url_decode(c), F.regexp_replace(c, r"\+", " "))


def encoded(c: Column) -> Column:
    """Form encoding with ~ as it is and * escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_params(query: Column) -> Column:
    """Array of (k, v), decoded; parameters without a value are left out."""
    pieces = F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 0)
    pairs = F.transform(
        pieces,
        lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.substr(p, F.instr(p, "=") + 1)).alias("v"))
    )
    return F.filter(pairs, lambda p: p["v"] != "")


def normalize_url(url: Column) -> Column:
    """Key under which equivalent URLs meet: no scheme, leading www., default port,
    trailing slash, fragment, or tracking; parameters sorted and re-encoded."""
    scheme, host = F.lower(part(url, "scheme")), F.lower(part(url, "netloc"))
    host = F.regexp_replace(host, r"^www\.", "")
    host = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")).when(
        (scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")
    ).otherwise(host)
    path = F.regexp_replace(part(url, "path"), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    path = F.when(path.startswith("/") | (host == ""), path).otherwise(F.concat(F.lit("/"), path))
    kept = F.filter(query_params(part(url, "query")), lambda p: ~F.lower(p["k"]).isin(*TRACKING))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.isNull() | (url == ""), url).otherwise(F.regexp_replace(whole, "^/+", ""))


def domain(url: Column) -> Column:
    """Host (with port) in lower case, every ``www.`` removed."""
    return F.replace(F.lower(part(url, "netloc")), F.lit("www."), F.lit(""))


def listed_domain(name: str) -> str:
    """A listed domain, given bare or as a URL."""
    name = name.strip().lower()
    if "://" in name:
        name = name.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0]
    return name.replace("www.", "").strip("/")


def under_domain(host: Column, listed: str) -> Column:
    return (host == listed) | host.endswith("." + listed)


def is_redirect(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, "netloc")) == _REDIRECT_HOST, F.lit(False))


def resolve(df: DataFrame, redirects: DataFrame | None, url: str = "url") -> DataFrame:
    """Replace redirect URLs by their targets in ``redirects`` (url, target); the lookup is
    a left join, unknown ones stay."""
    if redirects is None:
        return df
    table = redirects.select(F.col("url").alias("_from"), F.col("target").alias("_to")).dropDuplicates(["_from"])
    out = df.join(table, is_redirect(df[url]) & (df[url] == table["_from"]), "left")
    return out.withColumn(url, F.coalesce(F.when(F.col("_to") != "", F.col("_to")), F.col(url))).drop("_from", "_to")


def is_hub_url(url: Column) -> Column:
    """A home page without an article id in its query, or a known listing path."""
    path, host = part(url, "path"), domain(url)
    keys = F.transform(query_params(part(url, "query")), lambda p: p["k"])
    bare = path.isin("", "/")
    listing = F.lit(False)
    for name, pattern in _HUBS.items():
        listing = listing | ((host == name) & path.rlike(f"^(?:{pattern})"))
    home = bare & ~F.arrays_overlap(keys, F.array(*map(F.lit, _ID_KEYS)))
    return F.when(url.isNull() | (url == ""), False).otherwise(home | (~bare & listing))


_SECTIONS = "about account author authors cart categories category checkout contact feed login privacy register rss search signin signup sitemap subscribe tag tags terms"
_ASSETS = "css gif ico jpeg jpg js json mp3 mp4 pdf png svg webp xml zip"
_SKIP = "(?i)^/(?:" + "|".join(_SECTIONS.split()) + r")(?:/|$)|/page/[0-9]+/?$|\.(?:" + "|".join(_ASSETS.split()) + ")$"


def crawlable(url: Column) -> Column:
    """http(s) and neither a section, a numbered listing page nor an asset."""
    return F.coalesce(F.lower(part(url, "scheme")).isin("http", "https") & ~part(url, "path").rlike(_SKIP), F.lit(False))


_DATED = r"/[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}/|/[0-9]{4}-[0-9]{2}-[0-9]{2}-"
_SLUG, _LONG_ID = r"(?:-[a-z0-9]+){4}", r"/[0-9]{5,}(?:[/-]|$)"


def looks_like_article(url: Column) -> Column:
    """Dated path, dated slug, a slug of five words or a long id: a crawl priority."""
    return F.coalesce(part(url, "path").rlike(f"(?i){_DATED}|{_SLUG}|{_LONG_ID}"), F.lit(False))


def is_aggregator_source(source: Column) -> Column:
    return F.coalesce(F.lower(F.trim(source)).isin(*AGGREGATOR_NAMES), F.lit(False))


def aggregator_name(url: Column) -> Column:
    """Display name of a known aggregator's domain, else null."""
    table = F.create_map(*[F.lit(x) for pair in AGGREGATOR_HOSTS.items() for x in pair])
    return F.try_element_at(table, domain(url))


def domain_label(url: Column) -> Column:
    """Title-cased first label of the domain."""
    return title_case(F.replace(F.substring_index(domain(url), ".", 1), F.lit("-"), F.lit(" ")))


def unwrapped_result(url: Column) -> Column:
    """The target inside a wrapped result link (``/RU=.../RK=`` or ``uddg=``)."""
    ru, uddg = F.regexp_extract(url, r"/RU=(.*?)/R[KS]=", 1), F.regexp_extract(url, r"[?&]uddg=([^&]+)", 1)
    return F.when(ru != "", decoded(ru)).when(uddg != "", decoded(uddg)).otherwise(url)
