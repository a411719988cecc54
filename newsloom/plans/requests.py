"""Validated requests, and what they compile to: provider queries and column predicates."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.dates import day_of

CATEGORIES = frozenset("business entertainment general health science sports tech".split())
WINDOWS = {"d": 1, "w": 7, "m": 30}
MODES = frozenset(("all", "any", "exact_phrase"))
FETCH_SORTS = frozenset(("date", "popularity", "relevance"))
SEARCH_SORTS = frozenset(("date", "relevance"))
MIN_INTERVAL = 5
REGIONS = dict(
    x.split("=") for x in "au=Australia|bd=Bangladesh|ca=Canada|gb=UK|uk=UK|in=India|lk=Sri Lanka|nz=New Zealand|pk=Pakistan|us=US".split("|")
)
_SUBJECT = {"general": "breaking", "tech": "technology"}


Terms = list[str] | None
Day = str | dt.date | dt.datetime | None


def _one_of(value: str, allowed, name: str) -> None:
    if value not in allowed:
        raise ValueError(f"{name}={value!r} is not one of {sorted(allowed)}")


@dataclass
class Request:
    time_limit: str = "d"
    max_results: int = 20
    language: str | None = None
    whitelist: Terms = None
    blacklist: Terms = None
    full_content: bool = False
    search_in: list[str] = field(default_factory=lambda: "title description".split())
    sort_by: str = "date"
    refresh_interval: int | None = None

    def __post_init__(self) -> None:
        _one_of(self.time_limit, WINDOWS, "time_limit")
        if not self.max_results >= 1:
            raise ValueError("at least one result has to be asked for")
        if bad := sorted(set(self.search_in) - {"body", "description", "title"}):
            raise ValueError(f"search_in has unknown fields: {bad}")
        if self.refresh_interval is not None and self.refresh_interval < MIN_INTERVAL:
            raise ValueError(f"refresh_interval must be at least {MIN_INTERVAL} seconds")


@dataclass
class FetchRequest(Request):
    category: str = "general"
    location: str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        _one_of(self.category, CATEGORIES, "category")
        _one_of(self.sort_by, FETCH_SORTS, "sort_by")


@dataclass
class SearchRequest(Request):
    query: str = ""
    query_mode: str = "any"
    exclude_terms: Terms = None
    start_date: Day = None
    end_date: Day = None
    country: str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.query.isspace() or not self.query:
            raise ValueError("a search needs a query")
        _one_of(self.query_mode, MODES, "query_mode")
        _one_of(self.sort_by, SEARCH_SORTS, "sort_by")
        self.start_date, self.end_date = day_of(self.start_date, "start_date"), day_of(self.end_date, "end_date")
        first, last = self.start_date, self.end_date
        if first and last and last < first:
            raise ValueError(f"the range ends on {last}, before it starts on {first}")


def unquoted(text: str) -> str:
    return text.replace('"', "").strip()


def provider_query(r: SearchRequest) -> str:
    """The query text a news search understands; ``before:`` excludes its day, so the end
    moves by one."""
    words = re.findall(r'"[^"]+"|\S+', r.query)
    if r.query_mode == "exact_phrase":
        parts = [f'"{unquoted(r.query)}"']
    elif r.query_mode == "any" and len(words) > 1:
        parts = [f"({' OR '.join(words)})"]
    else:
        parts = words
    for t in r.exclude_terms or []:
        if t and t.strip():
            bare = unquoted(t)
            parts.append(f'-"{bare}"' if re.search(r"\s", bare) else f"-{bare}")
    if r.start_date:
        parts.append(f"after:{r.start_date}")
    if r.end_date:
        parts.append(f"before:{dt.date.fromisoformat(r.end_date) + dt.timedelta(days=1)}")
    if not (r.start_date or r.end_date):
        parts.append(f"when:{WINDOWS[r.time_limit]}d")
    return " ".join(parts)


def published_within(r: Request, published: Column, as_of: Column) -> Column:
    """The same window as a predicate on a timestamp column."""
    start, end = getattr(r, "start_date", None), getattr(r, "end_date", None)
    if not (start or end):
        return published >= as_of - F.expr(f"INTERVAL {WINDOWS[r.time_limit]} DAYS")
    keep = F.lit(True)
    if start:
        keep = keep & (published >= F.lit(start).cast("timestamp"))
    if end:
        keep = keep & (published < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return keep


WORLD = "wt-wt"


def anywhere(location: str | None) -> bool:
    return location in (None, "", WORLD)


def country_language(location: str | None) -> tuple[str, str]:
    if anywhere(location):
        return "us", "en"
    country, _, language = location.lower().partition("-")
    return country, language or "en"


def locale(country: str | None = None, language: str | None = None) -> str:
    gl, hl = (country or "US").upper(), (language or "en").lower()
    return f"hl={hl}-{gl}&gl={gl}&ceid={quote(f'{gl}:{hl}', safe='')}"


def region_name(location: str | None) -> str:
    if anywhere(location):
        return ""
    code = location.lower().partition("-")[0]
    return REGIONS[code] if code in REGIONS else location.upper()


def subject_query(category: str, location: str | None) -> str:
    """Query text of a category, led by the region."""
    base = f"{_SUBJECT.get(category, category)} news today" if category in CATEGORIES else "news today"
    return f"{region_name((location or '').strip())} {base}".strip()


def region_code(location: str | None) -> str:
    if anywhere(location):
        return WORLD
    return location + ("" if "-" in location else "-en")
