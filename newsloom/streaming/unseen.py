"""Only unseen stories from a stream of polls.

A story is new when any of its coverage's URLs is new; a story without URLs when its title
is.  Seen keys live in a Parquet table by batch, so a repeated batch replaces its own keys
(``foreachBatch`` may run twice) and never hides a story from itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions import urls as U
from newsloom.functions.text import normalised_title

SEEN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("batch", T.LongType())])
MIN_SECONDS = 5


def story_keys(stories: DataFrame) -> DataFrame:
    """(_ord, kind, key): normalised URLs of all coverage, and the title."""
    urls = F.array("url")
    if "similar_articles" in stories.columns:
        urls = F.concat(urls, F.coalesce(F.transform("similar_articles", lambda m: m["url"]), F.array().cast("array<string>")))
    rows = stories.select(
        "_ord",
        F.array_distinct(F.transform(F.filter(urls, lambda u: u.isNotNull() & (u != "")), U.normalize_url)).alias("u"),
        normalised_title(F.col("title")).alias("t")
    )
    by_url = rows.select("_ord", F.lit("url").alias("kind"), F.explode("u").alias("key"))
    by_title = rows.where("t != ''").select("_ord", F.lit("title").alias("kind"), F.col("t").alias("key"))
    return by_url.union(by_title)


def only_unseen(stories: DataFrame, seen: DataFrame) -> DataFrame:
    """The stories of one poll that bring something new, in their order: of two stories
    with the same key the first has it."""
    keys = story_keys(stories)
    first = keys.withColumn("_first", F.min("_ord").over(Window.partitionBy("kind", "key")))
    known = seen.select("kind", "key").distinct().withColumn("_known", F.lit(True))
    marked = first.join(known, ["kind", "key"], "left").withColumn("_new", F.col("_known").isNull() & (F.col("_first") == F.col("_ord")))
    judged = marked.groupBy("_ord").agg(
        F.max(F.col("kind") == "url").alias("has_url"),
        F.max((F.col("kind") == "url") & F.col("_new")).alias("url_new"),
        F.max((F.col("kind") == "title") & F.col("_new")).alias("title_new")
    )
    fresh = judged.where(F.when(F.col("has_url"), F.col("url_new")).otherwise(F.col("title_new"))).select("_ord")
    return stories.join(fresh, "_ord", "left_semi").orderBy("_ord")


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SEEN).parquet(path)
    except Exception as e:  # made by the first batch
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], SEEN)
        raise


def emit_batch(stories: DataFrame, batch: int, seen_path: str, sink: Callable[[DataFrame, int], None], horizon: int | None = None) -> None:
    """One poll: pass the fresh stories to ``sink`` (not when there are none) and note
    their keys.  ``horizon`` forgets keys older than so many batches; by default all stay."""
    spark = stories.sparkSession
    seen = read_seen(spark, seen_path).where(F.col("batch") != batch)
    if horizon is not None:
        seen = seen.where(F.col("batch") >= batch - horizon)
    fresh = only_unseen(stories, seen).persist()
    try:
        if fresh.isEmpty():
            return
        sink(fresh, batch)
        notes = story_keys(fresh).select("kind", "key").distinct()
        notes.write.mode("overwrite").parquet(f"{seen_path}/batch={batch}")
    finally:
        fresh.unpersist()


def stream_unseen(
    raw: DataFrame,
    pipeline: Callable[[DataFrame], DataFrame],
    seen_path: str,
    checkpoint: str,
    sink: Callable[[DataFrame, int], None],
    seconds: int | None = None,
    horizon: int | None = None
) -> StreamingQuery:
    """Run ``pipeline`` on each micro-batch of polled rows and emit what is unseen.  With
    ``seconds`` the query polls at that pace (5 at least), else it takes what is there."""

    def each(batch: DataFrame, number: int) -> None:
        emit_batch(pipeline(batch), number, seen_path, sink, horizon)

    writer = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{max(MIN_SECONDS, seconds)} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def deduplicated(stream: DataFrame, time: str, delay: str, key: Column | None = None) -> DataFrame:
    """Bounded alternative for single-URL rows: drops keys repeated within a watermark."""
    return stream.withColumn(
        "_key", U.normalize_url(F.col("url")) if key is None else key
    ).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
