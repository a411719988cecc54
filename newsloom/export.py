"""Exporters: CSV, JSON, JSON-LD, Markdown and plain text.

Each item is rendered by column expressions in its own task; only the rendered items
are put together, in ``_ord`` (or story id) order.  ``write_*`` forms leave them
distributed as files, one item per row."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import dates as D
from newsloom.functions.text import SPACE, stripped
from newsloom.schema import nullif_blank

SCHEMA_VERSION = "1.0"
CSV_COLUMNS = tuple(
    "cluster_id cluster_label cluster_size cluster_score cluster_first_seen cluster_last_seen title url description summary text publish_date category language source sources authors keywords top_image images videos meta similar_articles".split()
)
JSON_INTERNAL = frozenset("_cluster_size _full_content_reason _full_content _field_sources _aggregator_source _tier".split())
_STORY = {
    "cluster_id": "id", "cluster_label": "label", "cluster_size": "size", "cluster_score": "score",
    "cluster_first_seen": "first_seen", "cluster_last_seen": "last_seen"
}


def is_clusters(df: DataFrame) -> bool:
    """Whether rows are clusters: ``articles`` is an array and ``size`` a number."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return isinstance(kinds.get("articles"), T.ArrayType) and isinstance(kinds.get("size"), T.IntegralType)


def order_key(df: DataFrame) -> str:
    return "id" if is_clusters(df) else "_ord"


def without_internal(df: DataFrame) -> DataFrame:
    return df.select([c for c in df.columns if not c.startswith("_")])


def write_output(path: str | None, content: str) -> str:
    if path:
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        with target.open("w", encoding="utf-8", newline="") as f:
            f.write(content)
    return content


def _scalar(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def csv_rows(df: DataFrame, include_text: bool = True, include_internal: bool = False) -> DataFrame:
    """The export's columns as strings, one row per article or cluster."""
    fields: dict[str, tuple[Column, T.DataType]] = {}
    if is_clusters(df):
        rep = df.schema["representative"].dataType
        fields |= {f.name: (F.col("representative")[f.name], f.dataType) for f in rep.fields}
        fields |= {k: (F.col(v), df.schema[v].dataType) for k, v in _STORY.items()}
        fields["sources"] = (F.col("sources"), df.schema["sources"].dataType)
    else:
        fields |= {f.name: (F.col(f.name), f.dataType) for f in df.schema.fields}
    names = [c for c in CSV_COLUMNS if include_text or c != "text"]
    if include_internal:
        names += sorted(c for c in fields if c.startswith("_"))
    key = F.col(order_key(df)).alias("_key")
    return df.select(key, *[(_scalar(*fields[c]) if c in fields else F.lit(None).cast("string")).alias(c) for c in names if c != "_key"])


def _csv_line(columns: list[str]) -> Column:
    cells = []
    for c in columns:
        v = F.coalesce(F.col(c), F.lit(""))
        cells.append(F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v))
    return F.concat_ws(",", *cells)


def _collected(df: DataFrame, key: str, text: Column) -> list[str]:
    """The rendered items in order: an export is one document, so it comes together here."""
    return [r[1] for r in df.select(F.col(key), text.alias("_text")).orderBy(key).collect()]


def to_csv(df: DataFrame, path: str | None = None, *, include_internal: bool = False, include_text: bool = True) -> str:
    rows = csv_rows(df, include_text, include_internal)
    names = rows.columns[1:]
    return write_output(path, "".join(f"{x}\n" for x in [",".join(names), *_collected(rows, "_key", _csv_line(names))]))


def write_csv(df: DataFrame, path: str, **how) -> None:
    csv_rows(df, **how).drop("_key").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_items(df: DataFrame, include_internal: bool = False) -> DataFrame:
    keep = [c for c in df.columns if include_internal or (c not in JSON_INTERNAL and c != "_ord")]
    return df.select(F.col(order_key(df)).alias("_key"), F.to_json(F.struct(*keep)).alias("item"))


def write_json(df: DataFrame, path: str, include_internal: bool = False) -> None:
    """JSON lines in a folder, written where the rows are."""
    json_items(df, include_internal).select("item").write.mode("overwrite").text(path)


def to_json(
    df: DataFrame,
    path: str | None = None,
    *,
    envelope: bool = True,
    ensure_ascii: bool = False,
    extra_meta: dict | None = None,
    generated_at: dt.datetime | None = None,
    include_internal: bool = False,
    indent: int | None = 2
) -> str:
    items = [json.loads(x) for x in _collected(json_items(df, include_internal), "_key", F.col("item"))]
    kind = "clusters" if is_clusters(df) else "articles"
    payload: Any = items
    if envelope:
        payload = {
            "schema_version": SCHEMA_VERSION, "generated_at": (generated_at or dt.datetime.now(dt.UTC)).isoformat(),
            "count": len(items), "kind": kind, kind: items, **(extra_meta or {})
        }
    return write_output(path, json.dumps(payload, indent=indent, ensure_ascii=ensure_ascii, default=str))


def read_json_export(spark, path: str) -> DataFrame:
    """Rows of a JSON export, enveloped or bare."""
    df = spark.read.option("multiLine", True).json(path)
    name = next(
        (c for c in ("clusters", "articles") if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType) and "schema_version" in df.columns),
        None
    )
    return df.select(F.explode(name).alias("_i")).select("_i.*") if name else df


class _Item:
    """Safe access to an article's fields, in a frame or in a struct of it."""

    def __init__(self, get, names: list[str]):
        self._get, self.names = get, names

    def text(self, name: str) -> Column:
        return nullif_blank(self._get(name).cast("string")) if name in self.names else F.lit(None).cast("string")

    def array(self, name: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.filter(F.coalesce(self._get(name), empty), lambda x: x.isNotNull()) if name in self.names else empty

    def meta(self, name: str) -> Column:
        return nullif_blank(self._get("meta")[name]) if "meta" in self.names else F.lit(None).cast("string")

    def joined(self, name: str) -> Column:
        return nullif_blank(F.array_join(self.array(name), ", "))


def _item(df: DataFrame) -> _Item:
    if is_clusters(df):
        return _Item(lambda c: F.col("representative")[c], df.schema["representative"].dataType.names)
    return _Item(F.col, df.columns)


def news_article(a: _Item) -> Column:
    """schema.org NewsArticle; missing fields are left out."""
    url, images = a.text("url"), a.array("images")
    top = a.text("top_image")
    images = F.when(top.isNotNull() & ~F.array_contains(images, top), F.concat(F.array(top), images)).otherwise(images)
    publisher = F.coalesce(a.text("source"), a.meta("site_name"))
    some = lambda c: F.when(F.size(c) > 0, c)
    lit = F.lit
    return F.struct(
        lit("NewsArticle").alias("@type"), a.text("title").alias("headline"), url.alias("url"), a.text("description").alias("description"), a.text("text").alias("articleBody"),
        F.coalesce(a.text("publish_date"), a.text("published")).alias("datePublished"), F.coalesce(a.text("date_modified"), a.text("modified")).alias("dateModified"),
        url.alias("@id"), F.when(url.isNotNull(), F.struct(lit("WebPage").alias("@type"), url.alias("@id"))).alias("mainEntityOfPage"),
        some(F.transform(F.filter(a.array("authors"), lambda x: x != ""), lambda x: F.struct(lit("Person").alias("@type"), x.alias("name")))).alias("author"),
        F.coalesce(a.text("language"), a.meta("language"), a.meta("inLanguage")).alias("inLanguage"), a.text("category").alias("articleSection"),
        F.when(publisher.isNotNull(), F.struct(lit("Organization").alias("@type"), publisher.alias("name"))).alias("publisher"),
        some(images).alias("image"), some(a.array("keywords")).alias("keywords"),
    )


def jsonld_items(df: DataFrame) -> DataFrame:
    item = F.to_json(news_article(_item(df)))
    if is_clusters(df):
        prop = lambda n, v: F.to_json(F.struct(F.lit("PropertyValue").alias("@type"), F.lit(n).alias("name"), v.alias("value")))
        props = [
            prop("clusterSize", F.col("size")),
            F.when(nullif_blank(F.col("label")).isNotNull(), prop("clusterLabel", F.col("label"))),
            F.when(F.size("sources") > 0, prop("sources", F.col("sources")))
        ]
        props += [F.when(F.col(c).isNotNull(), prop(n, F.col(c))) for c, n in {"first_seen": "firstSeen", "last_seen": "lastSeen"}.items()]
        extra = F.concat(F.lit(',"additionalProperty":['), F.concat_ws(",", *props), F.lit("]}"))
        item = F.concat(F.substr(item, F.lit(1), F.length(item) - 1), extra)
    return df.select(F.col(order_key(df)).alias("_key"), item.alias("item"))


def write_jsonld(df: DataFrame, path: str) -> None:
    """NewsArticle lines in a folder, written where the rows are."""
    jsonld_items(df).select("item").write.mode("overwrite").text(path)


def to_jsonld(df: DataFrame, path: str | None = None, *, indent: int | None = 2) -> str:
    items = _collected(jsonld_items(df), "_key", F.col("item"))
    elements = [{"@type": "ListItem", "position": i, "item": json.loads(x)} for i, x in enumerate(items, 1)]
    whole = {"@type": "ItemList", "@context": "https://schema.org", "itemListElement": elements, "numberOfItems": len(elements)}
    return write_output(path, json.dumps(whole, indent=indent, ensure_ascii=False))


def slug(c: Column) -> Column:
    low = stripped(F.lower(c))
    plain = F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}\p{M}_\s\p{Z}\x85-]+", ""), rf"{SPACE}+", "-")
    return F.coalesce(nullif_blank(F.regexp_replace(F.regexp_replace(plain, "-+", "-"), "^-|-$", "")), F.lit("section"))


def _shown_date(c: Column) -> Column:
    return F.when(c.isNotNull(), F.coalesce(D.display(D.parse_iso(c)), c))


def _markdown_block(a: _Item, heading: str, number: Column | None, options: dict, similar: Column | None) -> Column:
    title = F.coalesce(a.text("title"), F.lit("Untitled"))
    head = F.concat(F.lit(heading + " "), number, F.lit(". "), title) if number is not None else F.concat(F.lit(heading + " "), title)
    parts = [head, F.lit("")]
    pair = lambda line: F.when(line.isNotNull(), F.concat(line, F.lit("\n")))
    if options["include_metadata"]:
        sources, source = a.joined("sources"), F.coalesce(a.text("source"), a.meta("site_name"))
        date = _shown_date(F.coalesce(a.text("publish_date"), a.text("published")))
        bits = F.concat_ws(
            " — ",
            F.when(sources.isNotNull(), F.concat(F.lit("**Sources:** "), sources)).when(source.isNotNull(), F.concat(F.lit("**Source:** "), source)),
            F.when(date.isNotNull(), F.concat(F.lit("**Published:** "), date)),
            F.when(a.joined("authors").isNotNull(), F.concat(F.lit("**Authors:** "), a.joined("authors"))),
        )
        parts.append(pair(nullif_blank(bits)))
    if options["include_summary"]:
        text = nullif_blank(stripped(F.coalesce(a.text("description"), a.meta("description"))))
        parts.append(pair(F.concat(F.lit("> "), text)))
    if options["include_text"]:
        text = nullif_blank(stripped(a.text("text")))
        if limit := options["max_text_chars"]:
            text = F.when(
                F.length(text) > limit,
                F.concat(F.regexp_replace(F.substring(text, 1, limit), rf"{SPACE}+$", ""), F.lit(" […]"))
            ).otherwise(text)
        parts.append(pair(text))
    parts.append(pair(F.concat(F.lit("[Read original]("), a.text("url"), F.lit(")"))))
    if similar is not None:
        lines = F.transform(
            similar,
            lambda m: _linked(m, F.concat(F.lit(" — _"), F.coalesce(nullif_blank(m["source"]), F.lit("Unknown source")), F.lit("_")))
        )
        parts.append(F.when(F.size(similar) > 0, F.concat(F.lit("**Similar coverage:**\n\n"), F.array_join(lines, "\n"), F.lit("\n"))))
    return F.concat_ws("\n", *parts)


def _linked(m: Column, suffix: Column) -> Column:
    title = F.coalesce(nullif_blank(m["title"]), F.lit("Untitled"))
    return F.when(
        nullif_blank(m["url"]).isNotNull(), F.concat(F.lit("- ["), title, F.lit("]("), m["url"], F.lit(")"), suffix)
    ).otherwise(F.concat(F.lit("- "), title, suffix))


def to_markdown(
    df: DataFrame,
    path: str | None = None,
    *,
    generated_at: dt.datetime | None = None,
    include_all_members: bool = False,
    include_metadata: bool = True,
    include_summary: bool = True,
    include_text: bool = True,
    include_toc: bool = True,
    max_text_chars: int | None = 4000,
    title: str | None = None
) -> str:
    clusters = is_clusters(df)
    options = {
        "include_text": include_text, "include_summary": include_summary, "include_metadata": include_metadata,
        "max_text_chars": max_text_chars
    }
    key, a = order_key(df), _item(df)
    number = F.lit("\u0000")  # the position, filled in when the items come together
    similar = F.col("similar_articles") if "similar_articles" in df.columns and not clusters else None
    if clusters:
        span = F.concat_ws(
            ", ", F.concat(F.lit("first "), _shown_date(F.col("first_seen"))),
            F.concat(F.lit("latest "), _shown_date(F.col("last_seen")))
        )
        parts = [
            F.concat(F.lit("## \u0000. "), F.coalesce(nullif_blank(F.col("label")), F.lit("Cluster \u0000")), F.lit("\n")),
            F.concat(F.lit("_Cluster of "), F.col("size").cast("string"), F.lit(" article(s)._\n")),
            F.when(F.size("sources") > 0, F.concat(F.lit("**Sources:** "), F.array_join("sources", ", "), F.lit("\n"))),
            F.when(span != "", F.concat(F.lit("_Timeline: "), span, F.lit("_\n"))),
            _markdown_block(a, "###", None, options, None),
        ]
        if include_all_members:
            others = F.transform(
                F.slice("articles", 2, F.greatest(F.size("articles"), F.lit(1))),
                lambda m: _linked(m, F.coalesce(F.concat(F.lit(" — _"), nullif_blank(m["source"]), F.lit("_")), F.lit("")))
            )
            parts.append(F.when(F.col("size") > 1, F.concat(F.lit("### Other reports\n\n"), F.array_join(others, "\n"), F.lit("\n"))))
        block = F.concat_ws("\n", *parts, F.lit("---\n"))
        label = F.col("label")
    else:
        block = F.concat(_markdown_block(a, "##", number, options, similar), F.lit("\n---\n"))
        label = a.text("title") if "title" in a.names else F.lit(None).cast("string")
    labels = F.coalesce(nullif_blank(label), F.lit("Item \u0000"))
    rendered = df.select(
        F.col(key).alias("_key"), block.alias("b"), labels.alias("l"), slug(F.concat(F.lit("0. "), labels)).alias("s")
    ).orderBy("_key").collect()
    now = generated_at or dt.datetime.now(dt.UTC)
    unit = "cluster(s)" if clusters else "article(s)"
    out = [
        f"# {title or ('News Clusters' if clusters else 'News Export')}", "",
        f"_Generated: {now:%Y-%m-%d %H:%M} UTC — {len(rendered)} {unit}_", ""
    ]
    if not rendered:
        return write_output(path, "\n".join([*out, "_No items._"]))
    if include_toc and len(rendered) > 1:
        out += ["## Table of Contents", ""]
        for i, r in enumerate(rendered, 1):
            name = r["l"].replace("\u0000", str(i))
            out.append(f"{i}. [{name}](#{i}{r['s'][1:]})")
        out += ["", "---", ""]
    out += [r["b"].replace("\u0000", str(i)) for i, r in enumerate(rendered, 1)]
    text = "\n".join(out)
    return write_output(path, f"{text.rstrip()}\n")


def _text_block(a: _Item, include_text: bool, limit: int | None, similar: Column | None) -> Column:
    line = lambda label, v: F.concat(F.lit(label + ": "), v)
    parts = [
        line("Title", F.coalesce(a.text("title"), F.lit("Untitled"))), line("URL", a.text("url")),
        line("Published", F.coalesce(a.text("publish_date"), a.text("published"))), line("Source", a.text("source")),
        line("Category", a.text("category"))
    ]
    parts += [line(label, a.joined(c)) for label, c in (("Sources", "sources"), ("Authors", "authors"), ("Keywords", "keywords"))]
    parts.append(line("Description", a.text("description")))
    if include_text:
        body = stripped(a.text("text"))
        parts.append(F.concat(F.lit("Article text:\n"), body if limit is None else F.substring(body, 1, limit)))
    if similar is not None:
        rows = F.transform(
            similar,
            lambda m: F.concat(
                F.lit("- "),
                F.concat_ws(
                    " | ", F.coalesce(nullif_blank(m["title"]), F.lit("Untitled")),
                    line("source", nullif_blank(m["source"])), line("url", nullif_blank(m["url"]))
                )
            )
        )
        parts.append(F.when(F.size(similar) > 0, F.concat(F.lit("Related coverage:\n"), F.array_join(rows, "\n"))))
    return F.concat_ws("\n", *parts)


def to_text(df: DataFrame, path: str | None = None, *, include_text: bool = True, max_text_chars: int | None = None) -> str:
    if (max_text_chars or 0) < 0:
        raise ValueError("a text limit can't be negative")
    clusters, a = is_clusters(df), _item(df)
    similar = F.col("similar_articles") if "similar_articles" in df.columns and not clusters else None
    block = _text_block(a, include_text, max_text_chars, similar)
    if clusters:
        line = lambda label, v: F.concat(F.lit(label + ": "), v)
        head = F.concat_ws(
            "\n", F.concat(F.lit("Story group \u0000: "), F.coalesce(nullif_blank(F.col("label")), a.text("title"), F.lit("Untitled"))), line("Cluster size", F.col("size").cast("string")),
            line("Sources", nullif_blank(F.array_join("sources", ", "))), line("First seen", F.col("first_seen")), line("Last seen", F.col("last_seen")),
        )
    else:
        head = F.lit("Article \u0000")
    blocks = _collected(df, order_key(df), F.concat_ws("\n", head, block))
    return write_output(path, "\n\n---\n\n".join(b.replace("\u0000", str(i), 1) for i, b in enumerate(blocks, 1)))
