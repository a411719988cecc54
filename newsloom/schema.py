"""Record shapes and the helpers every operator shares.

Rows of a DataFrame have no order, so each article carries ``_ord``.  "Empty" means null,
an empty string or an empty array or map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _A = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


META = _struct(canonical=_S, description=_S, site_name=_S, keywords=_A, language=_S, inLanguage=_S, source_is_aggregator=_B, source_resolved=_B)
RAW = _struct(_ord=_L, title=_S, url=_S, source=_S, published=_S, description=_S, _tier=_S, _aggregator_source=_B)
ARTICLE = T.StructType(
    RAW.fields
    + _struct(
        text=_S, authors=_A, publish_date=_S, published_at=_S, category=_S, keywords=_A, language=_S, top_image=_S, images=_A, videos=_A, sources=_A, summary=_S,
        meta=META, _field_sources=T.MapType(_S, _S), _full_content=_B, _full_content_reason=_S, _rank_score=_D,
    ).fields
)
CLUSTER_FIELDS = tuple("id label topic size score sources first_seen last_seen representative articles".split())
STORY_FIELDS = tuple("cluster_id cluster_score cluster_size first_seen last_seen similar_articles".split())
PROFILE = _struct(user_id=_S, interests=_A, categories=_A, languages=_A, preferred_sources=_A, blocked_sources=_A, schema_version=T.IntegerType())
CACHE = _struct(namespace=_S, cache_key=_S, value=T.BinaryType(), expires_at=_D, created_at=_D)


def conform(df: DataFrame, schema: T.StructType = ARTICLE) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks as typed nulls; extras stay."""
    have = set(df.columns)
    return df.select(*df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in have])


def is_empty(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, T.ArrayType | T.MapType):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def text_or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def nullif_blank(c: Column) -> Column:
    return F.when(c != "", c)


def with_ord(df: DataFrame, *keys: str | Column, name: str = "_ord") -> DataFrame:
    """Number the rows by a natural key.  A global numbering needs one ordered pass, so
    sources with an id of their own should use that instead."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)
