"""Adapters from plain tables to article frames, and the page store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import urls as U
from newsloom.functions.extract import extract_articles


def articles_from_documents(docs: DataFrame) -> DataFrame:
    """Title is the first line; URL and date follow from id and source, so they need no
    state.  A document has no description of its own."""
    id_ = F.col("doc_id")
    return docs.select(
        id_.alias("_ord"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/story/"), id_.cast("string"), F.lit("?utm_source=feed")).alias("url"),
        "source",
        F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + id_ * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        F.lit(None).cast("string").alias("description"),
        "text",
        F.col("lang").alias("language"),
    )


def page_store(pages: DataFrame) -> DataFrame:
    """Extracted articles of a page table, one per normalised URL: that of the least URL,
    of equal URLs that of the least HTML."""
    keyed = pages.withColumn("_key", U.normalize_url(F.col("url")))
    one = keyed.groupBy("_key").agg(F.min_by(F.struct(*pages.columns), F.struct("url", "html")).alias("_p")).select("_p.*")
    return extract_articles(one)
