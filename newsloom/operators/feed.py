"""Feeds: generic by freshness, personal by a weighted score, without blocked outlets."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import dates as D
from newsloom.operators.cache import _LISTS, FeedCache, UserProfile, load_user_profile
from newsloom.operators.cluster import THRESHOLD, cluster_articles, cluster_to_article
from newsloom.schema import nullif_blank

WEIGHTS = {"freshness": 0.10, "source": 0.10, "language": 0.10, "category": 0.15, "interest": 0.55}
NAMESPACE = "calculated_feed"
Weights = Mapping[str, float]


class FeedError(Exception):
    """A feed can't be made or read."""


class FeedProfileRequiredError(FeedError):
    """A personal feed needs a stored profile."""


@dataclass(frozen=True)
class FeedConfig:
    cache_ttl: int = 300
    max_items: int = 50
    cluster_threshold: float = THRESHOLD
    drop_singletons: bool = False
    weights: Weights = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("cache_ttl", "max_items"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must be non-negative")
        if not 0 <= self.cluster_threshold <= 1:
            raise ValueError("cluster_threshold must lie between 0 and 1")
        given = {k: float(v) for k, v in dict(self.weights or {}).items()}
        if extra := sorted(set(given) - set(WEIGHTS)):
            raise ValueError(f"unknown feed weights: {extra}")
        if any(v < 0 for v in given.values()):
            raise ValueError("no feed weight may be below 0")
        object.__setattr__(self, "weights", WEIGHTS | given)


def normal(c: Column) -> Column:
    """Lower-cased stripped non-blank distinct values of an array column."""
    low = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(low, lambda x: x != ""))


def language_code(c: Column) -> Column:
    return F.get(F.split(F.lower(F.trim(c)), "[-_]"), F.lit(0))


def overlap(values: Column, wanted: list[str]) -> Column:
    """Share of the wanted terms found."""
    return F.least(F.size(F.array_intersect(values, F.array(*map(F.lit, wanted)))) / F.lit(float(len(wanted))), F.lit(1.0)) if wanted else F.lit(0.0)


def rounded(c: Column, digits: int) -> Column:
    """``c`` in units of the last digit, rounded half away from 0, and back: as SQL engines
    do, in the last binary digit too, which ``round`` of the JVM keeps for large values."""
    unit = F.lit(10.0**digits)
    units = c * unit
    whole = F.when(F.abs(units) < 2.0**52, F.signum(units) * F.floor(F.abs(units) + 0.5)).otherwise(units) / unit
    return F.when(F.abs(whole) == math.inf, c).otherwise(whole)


def story_ts(df: DataFrame) -> Column:
    return D.parse_iso(_story_date(df))


def _story_date(df: DataFrame) -> Column:
    parts = [nullif_blank(F.col(c)) for c in ("last_seen", "published_at", "published") if c in df.columns]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def rank_generic(stories: DataFrame, as_of: Column, signed_age: bool = False) -> DataFrame:
    scored = stories.withColumn("_feed_score", D.freshness(story_ts(stories), as_of, signed=signed_age))
    return scored.orderBy(F.col("_feed_score").desc(), "_ord")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[\s\p{Z}]+")


class _Coverage:
    """Expressions over a story and its related articles."""

    def __init__(self, df: DataFrame):
        self.df, self.names = df, df.columns
        self.related = df.schema["similar_articles"].dataType.elementType.names if "similar_articles" in df.columns else []

    def _members(self, name: str) -> list[Column]:
        """Arrays whose flattening has the field of every member."""
        out = [F.array(F.col(name))] if name in self.names else []
        if name in self.related:
            out.append(F.coalesce(F.transform("similar_articles", lambda m: m[name]), F.array()))
        return out

    def scalars(self, name: str, inner: str | None = None) -> Column:
        arrays = self._members(name)
        if not arrays:
            return F.array().cast("array<string>")
        found = F.flatten(F.array(*arrays)) if len(arrays) > 1 else arrays[0]
        return F.transform(found, lambda x: x[inner]) if inner else found

    def lists(self, name: str) -> Column:
        arrays = self._members(name)
        if not arrays:
            return F.array().cast("array<string>")
        found = F.flatten(F.array(*arrays)) if len(arrays) > 1 else arrays[0]
        return F.flatten(F.filter(found, lambda x: x.isNotNull()))

    def _meta(self, inner: str) -> Column:
        kind = self.df.schema["meta"].dataType if "meta" in self.names else None
        return self.scalars("meta", inner) if isinstance(kind, T.StructType) and inner in kind.names else F.array().cast("array<string>")

    def sources(self) -> Column:
        return normal(F.filter(F.concat(self.scalars("source"), self._meta("site_name"), self.lists("sources")), lambda x: x.isNotNull()))

    def languages(self) -> Column:
        codes = F.concat(self.scalars("language"), self._meta("language"), self._meta("inLanguage"))
        return normal(F.transform(F.filter(codes, lambda x: x.isNotNull()), language_code))

    def categories(self) -> Column:
        return normal(F.filter(F.concat(self.scalars("category"), self.lists("categories")), lambda x: x.isNotNull()))

    def tokens(self) -> Column:
        parts = F.concat(*[self.scalars(c) for c in ("title", "description", "summary")])
        return F.array_distinct(F.filter(_words(F.array_join(parts, " ")), lambda x: x != ""))


def _blocked(get, names: list[str], blocked: list[str]) -> Column:
    """Whether a member's own outlet, or for want of one all its sources, are blocked."""
    out = F.array(*map(F.lit, blocked))
    primary = F.lower(F.trim(get("source"))) if "source" in names else F.lit("")
    site = F.lower(F.trim(get("meta")["site_name"])) if "meta" in names else F.lit("")
    own = F.coalesce(nullif_blank(primary), nullif_blank(site))
    listed = normal(get("sources")) if "sources" in names else F.array().cast("array<string>")
    return F.when(own.isNotNull(), F.array_contains(out, own)).otherwise((F.size(listed) > 0) & (F.size(F.array_except(listed, out)) == 0))


def strip_blocked(stories: DataFrame, blocked: list[str]) -> DataFrame:
    """Drop blocked coverage; a blocked story goes on under its first allowed related
    article, with the story's id, score and dates, or not at all."""
    if not blocked:
        return stories
    related = stories.schema["similar_articles"].dataType.elementType.names if "similar_articles" in stories.columns else []
    own = _blocked(F.col, stories.columns, blocked)
    empty = F.lit(None).cast(stories.schema["similar_articles"].dataType) if related else None
    if not related:
        kept = stories.where(~own)
        return _without_blocked_sources(kept, blocked)
    allowed = F.filter(F.coalesce("similar_articles", empty), lambda m: ~_blocked(lambda c: m[c], related, blocked))
    rows = stories.withColumns(
        {"_own": own, "_kept": F.coalesce(allowed, F.array().cast(stories.schema["similar_articles"].dataType))}
    ).where(~F.col("_own") | (F.size("_kept") > 0))
    new = {}
    inherits = frozenset("_ord cluster_id cluster_score first_seen last_seen".split())
    for f in stories.schema.fields:
        c = f.name
        if c == "similar_articles":
            rest = F.when(F.col("_own"), F.slice("_kept", 2, F.size("_kept"))).otherwise(F.col("_kept"))
            new[c] = F.when(F.size(rest) > 0, rest)
        elif c == "cluster_size":
            n = F.size("_kept") - F.when(F.col("_own"), 1).otherwise(0)
            new[c] = F.when(~F.col("_own") | (n > 0), (n + 1).cast(f.dataType))
        elif c not in inherits:
            new[c] = F.when(F.col("_own"), (F.get("_kept", F.lit(0))[c] if c in related else F.lit(None)).cast(f.dataType)).otherwise(F.col(c))
    return _without_blocked_sources(rows.withColumns(new).drop("_own", "_kept"), blocked)


def _without_blocked_sources(df: DataFrame, blocked: list[str]) -> DataFrame:
    if "sources" not in df.columns:
        return df
    left = F.filter("sources", lambda s: ~F.coalesce(F.lower(F.trim(s)).isin(*blocked), F.lit(False)))
    return df.withColumn("sources", F.when(F.size(left) > 0, left))


def interest_words(text: Column, interests: Iterable[str]) -> Column:
    """The interests among a text's words, each once: all that a personal score sees of
    it.  Gathered in place of the texts, a story's coverage stays small."""
    wanted = sorted({x.strip().lower() for x in interests if x.strip()})
    return F.array_join(F.array_intersect(_words(text), F.array(*map(F.lit, wanted)).cast("array<string>")), " ")


def rank_personal(
    stories: DataFrame,
    profile: UserProfile,
    weights: Mapping[str, float],
    as_of: Column,
    signed_age: bool = False
) -> DataFrame:
    wanted = {k: sorted({x.strip().lower() for x in getattr(profile, k) if x.strip()}) for k in _LISTS}
    rows = strip_blocked(stories, wanted["blocked_sources"])
    c = _Coverage(rows)
    hit = lambda values, terms: F.when(
        F.arrays_overlap(values, F.array(*map(F.lit, terms))), 1.0
    ).otherwise(0.0) if terms else F.lit(0.0)
    score = (
        overlap(c.tokens(), wanted["interests"]) * weights["interest"]
        + overlap(c.categories(), wanted["categories"]) * weights["category"]
        + hit(c.languages(), wanted["languages"]) * weights["language"]
        + hit(c.sources(), wanted["preferred_sources"]) * weights["source"]
        + D.freshness(story_ts(rows), as_of, signed=signed_age) * weights["freshness"]
    )
    scored = rows.withColumn("_feed_score", rounded(score, 6))
    return scored.orderBy(F.col("_feed_score").desc(), F.coalesce(_story_date(rows), F.lit("")).desc(), "_ord")


class FeedEngine:
    """Builds feeds and keeps personal ones in a cache."""

    def __init__(self, cache: FeedCache | None = None, config: FeedConfig = FeedConfig()):  # noqa: B008
        self.cache, self.config = cache, config

    def build(
        self,
        articles: DataFrame,
        *,
        as_of: Column | None = None,
        limit: int | None = None,
        personalized: bool = False,
        user_id: str | None = None
    ) -> DataFrame:
        as_of = F.current_timestamp() if as_of is None else as_of
        profile = None
        if personalized:
            if not user_id:
                raise FeedProfileRequiredError("a personal feed needs a user_id")
            if self.cache is None:
                raise FeedProfileRequiredError("a personal feed needs a cache")
            profile = load_user_profile(self.cache, user_id)
            if profile is None:
                raise FeedProfileRequiredError(f"there is no valid profile of {user_id!r}")
        stories = cluster_to_article(
            cluster_articles(articles, self.config.cluster_threshold, sort_by="date", as_of=as_of, drop_singletons=self.config.drop_singletons)
        )
        ranked = rank_generic(stories, as_of) if profile is None else rank_personal(stories, profile, self.config.weights, as_of)
        result = ranked.limit(max(self.config.max_items if limit is None else limit, 0))
        if profile is not None:
            import json
            import time

            items = [json.loads(x) for x in result.toJSON().collect()]  # at most ``limit`` stories
            entry = {"items": items, "generated_at": time.time()}
            self.cache.set(NAMESPACE, user_id, entry, ttl=self.config.cache_ttl)
        return result

    def get_cached_feed(self, user_id: str, *, max_age: float | None = None, validate: bool = True) -> dict | None:
        import time

        if self.cache is None:
            raise FeedError("reading a cached feed needs a cache")
        found = self.cache.get(NAMESPACE, user_id)
        if not validate or not isinstance(found, dict):
            return found
        made = found.get("generated_at")
        limit = self.config.cache_ttl if max_age is None else max_age
        return found if isinstance(made, int | float) and time.time() - made <= limit else None

    def clear_cached_feed(self, user_id: str) -> bool:
        if self.cache is None:
            raise FeedError("clearing a cached feed needs a cache")
        remove = getattr(self.cache, "delete", None)
        if callable(remove):
            remove(NAMESPACE, user_id)
        return callable(remove)
