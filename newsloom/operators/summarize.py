"""Extractive summaries and keywords."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import urls as U

_KEYWORD_STOP = "a an and are as at be been but by for from he if in is it not of on or she that the they this to was we were with you"
_NOT_FOR_KEYWORDS = set("as by from he if it not she they we you".split())
STOP = tuple(_KEYWORD_STOP.split())
_STOPPED = frozenset(STOP)
KEYWORD_STOP = tuple(w for w in STOP if w not in _NOT_FOR_KEYWORDS)
_KEYWORD_STOPPED = frozenset(KEYWORD_STOP)
_BLANK = " \t\n\x0b\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDS = re.compile(f"^[{_BLANK}]+|[{_BLANK}]+$")
_BETWEEN = re.compile(f"(?<=[.!?])[{_BLANK}]+")
_RUN = re.compile(r"\w+")


def _plain_words(text: str) -> list[str]:
    return [w for w in _RUN.findall(text.lower()) if len(w) > 1 and w.isascii() and w.isalpha()]


def _by_frequency(text: str, tokens: list[list[str]]) -> list[float]:
    """A sentence's score: the frequencies of its words in the text."""
    counts = Counter(w for w in _plain_words(text) if len(w) > 3 and w not in _STOPPED)
    top = max(counts.values(), default=1)
    scores = []
    for ws in tokens:
        score = 0.0
        for w in ws:  # added up in text order, without the compensation of sum()
            score += counts[w] / top if w in counts else 0.0
        scores.append(score)
    return scores if counts else []


def _by_latent_terms(text: str, tokens: list[list[str]]) -> list[float]:
    """Latent semantic analysis (Steinberger and Jezek 2004) with all its dimensions.  The
    score sqrt(sum over k of (s_k v_kj)^2) is then the length of the sentence's own column
    of term weights, as U is orthonormal: no decomposition is needed."""
    scores = []
    for ws in tokens:
        counts = Counter(w for w in ws if w not in _STOPPED)
        top = max(counts.values(), default=1)
        scores.append(math.sqrt(sum((0.4 + 0.6 * n / top) ** 2 for n in counts.values())))
    return scores


METHODS = {"frequency": _by_frequency, "lsa": _by_latent_terms}


def summary_of(text: str | None, sentence_count: int = 3, method: str = "frequency") -> str | None:
    """The summary of one text; see ``summarize``."""
    if text is None:
        return None
    bare = _ENDS.sub("", text)
    if len(bare) < 100:
        return text[:300]
    parts = [p for p in (_ENDS.sub("", s) for s in _BETWEEN.split(bare)) if p]
    if len(parts) <= sentence_count:
        return " ".join(parts)
    tokens = [_plain_words(p) for p in parts]
    scores = METHODS[method](text, tokens)
    if not scores:
        return " ".join(parts[:sentence_count])
    best = sorted(sorted(range(len(parts)), key=lambda i: (-scores[i], i))[:sentence_count])
    return " ".join(parts[i] for i in best)


def summarize(df: DataFrame, text: str = "text", key: str = "_ord", sentence_count: int = 3, out: str = "summary", method: str = "frequency") -> DataFrame:
    """Adds ``out``: texts under 100 characters keep their first 300; else the sentences
    that ``method`` scores best, in text order: ``frequency`` (of their words in the text)
    or ``lsa`` (their weight in the text's latent term space).  Null stays null.

    A summary needs its own row alone, so this is one Arrow pass without a shuffle; as
    array expressions each word is a linear search in the row's map of counts."""

    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")

    def run(column: pa.Array) -> pa.Array:
        return pa.array([summary_of(x.as_py(), sentence_count, method) for x in column], pa.string())

    return df.withColumn(out, F.arrow_udf(run, T.StringType())(F.col(text)))


def keywords_of(text: str | None, top_words: int = 5) -> list[str]:
    """The keywords of one text; see ``keywords``."""
    counts = Counter(w for w in _plain_words(text or "") if len(w) > 4 and w not in _KEYWORD_STOPPED)
    return [w for w, _ in counts.most_common(top_words)]  # of equal counts the first met comes first


def keywords(df: DataFrame, text: str = "text", key: str = "_ord", top_words: int = 5, out: str = "keywords") -> DataFrame:
    """Adds ``out``: the most frequent words of five letters or more, ties by first use.

    As for ``summarize``, one Arrow pass: rows of single words would all be held and dealt
    out by a key that their text has already brought together."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([keywords_of(x.as_py(), top_words) for x in column], pa.list_(pa.string()))

    return df.withColumn(out, F.arrow_udf(run, T.ArrayType(T.StringType()))(F.col(text)))


def summarize_with_keywords(df: DataFrame, text: str = "text", key: str = "_ord", sentence_count: int = 3, top_words: int = 5) -> DataFrame:
    """summary, keywords and coverage (share of the text, three digits)."""
    done = keywords(summarize(df, text, key, sentence_count), text, key, top_words)
    share = F.when(F.length(text) > 0, F.length("summary") / F.length(text)).otherwise(0.0)
    return done.withColumn("coverage", F.round(share, 3))


def batch_summarize(
    urls: DataFrame,
    pages: DataFrame,
    sentence_count: int = 3,
    include_full_text: bool = False,
    include_media: bool = False,
    dedupe: bool = True
) -> DataFrame:
    """Summaries of the articles behind ``urls`` (url, _ord); ``pages`` are extracted
    articles by url.  A page that is missing or has no text gives status ``failed``."""
    wanted = urls.withColumn("_key", U.normalize_url(F.col("url")))
    if dedupe:
        wanted = wanted.groupBy("_key").agg(F.min(F.struct("_ord", "url")).alias("r")).select("_key", "r._ord", "r.url")
    found = pages.withColumn("_key", U.normalize_url(F.col("url"))).drop("url", "_ord").dropDuplicates(["_key"])
    rows = summarize(wanted.join(found, "_key", "left"), "text", "_ord", sentence_count)
    ok = F.coalesce(F.col("text") != "", F.lit(False))
    columns = [
        "_ord", "url", F.when(ok, "success").otherwise("failed").alias("status"), F.when(ok, F.coalesce("title", F.lit(""))).otherwise("").alias("title"),
        F.when(ok, F.col("summary")).otherwise("Could not extract article content").alias("summary"), F.when(~ok, "Empty text").alias("error"),
    ]
    if include_full_text:
        columns.append(F.when(ok, F.col("text")).alias("text"))
    if include_media:
        columns += [F.when(ok, F.col(c)).alias(c) for c in ("images", "videos", "top_image") if c in rows.columns]
    return rows.select(*columns)


def search_and_summarize(found: DataFrame, pages: DataFrame, **how) -> DataFrame:
    """Search rows with the summary of each; the summary's fields win, and of search rows
    of one URL the last one stays."""
    done = batch_summarize(found.select("url", "_ord"), pages, **how)
    last = found.groupBy("url").agg(F.max_by(F.struct(*[c for c in found.columns if c != "url"]), "_ord").alias("_f")).select("url", "_f.*")
    both = [c for c in last.columns if c in done.columns and c != "url"]
    renamed = last.select("url", *[F.col(c).alias(f"_found_{c}" if c in both else c) for c in last.columns if c != "url"])
    merged = done.join(renamed, "url", "left")
    return merged.drop(*[f"_found_{c}" for c in both])
