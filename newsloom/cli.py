"""Command line: the toolkit's operations over stored payloads and pages, or live."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import __version__, export
from newsloom.api import Newsroom, rows_of
from newsloom.operators.cluster import cluster_articles
from newsloom.operators.filters import filter_articles
from newsloom.operators.rank import rank_articles
from newsloom.plans.requests import CATEGORIES, FETCH_SORTS, MODES, SEARCH_SORTS, WINDOWS
from newsloom.sources import feeds

DEFAULTS = Path("~/.config/newsloom/config.json")


def user_defaults(path: Path = DEFAULTS) -> dict[str, Any]:
    """The user's defaults; a missing or broken file gives none."""
    try:
        found = json.loads(path.expanduser().read_text())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def listed(text: str | None) -> list[str] | None:
    return [x.strip() for x in text.split(",") if x.strip()] if text else None


def build_parser(defaults: dict[str, Any] | None = None) -> argparse.ArgumentParser:
    own = user_defaults() if defaults is None else defaults
    p = argparse.ArgumentParser(prog="newsloom", description="Fetch, search, group and export news.")
    p.add_argument("--version", action="store_true")
    p.add_argument("--payloads", help="Parquet of (url, payload) in place of live requests")
    p.add_argument("--pages", help="Parquet of (url, html)")
    sub = p.add_subparsers(dest="command")

    def command(name: str, *positional: tuple[str, dict]) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for arg, how in positional:
            c.add_argument(arg, **how)
        c.add_argument("--limit", type=int, default=10)
        c.add_argument("--topic")
        c.add_argument("--topic-mode", choices=sorted(MODES), default="any")
        c.add_argument("--rank-query")
        c.add_argument("--rank-method", default="auto")
        c.add_argument("--save")
        c.add_argument("--json", action="store_true", help="print JSON")
        for kind in ("md", "json", "jsonld", "csv", "txt"):
            c.add_argument(f"--export-{kind}", metavar="FILE")
        return c

    f, s = command("fetch"), command("search", ("query", {}))
    for c, sorts in ((f, FETCH_SORTS), (s, SEARCH_SORTS)):
        c.add_argument("--language", default=own.get("language"))
        c.add_argument("--sort", choices=sorted(sorts), default=own.get("sort_by", "date"))
        c.add_argument("--time-limit", choices=sorted(WINDOWS), default="d")
        c.add_argument("--full-content", action="store_true")
        c.add_argument("--whitelist")
        c.add_argument("--blacklist")
        c.add_argument("--search-in", help="comma-separated: title, description, body")
    f.add_argument("--category", choices=sorted(CATEGORIES), default=own.get("category", "general"))
    f.add_argument("--location")
    s.add_argument("--mode", choices=sorted(MODES), default="any")
    for name in ("--exclude", "--start-date", "--end-date", "--country"):
        s.add_argument(name)
    s.add_argument("--stream", action="store_true")
    s.add_argument("--interval", type=int, default=60)
    command("extract", ("url", {}))
    d = command("discover", ("url", {}))
    d.add_argument("--max-pages", type=int)
    d.add_argument("--max-depth", type=int)
    d.add_argument("--no-rss", action="store_true")
    command("search-site", ("keyword", {}), ("domain", {}))
    c = command("cluster")
    c.add_argument("--query")
    c.add_argument("--input", help="a saved JSON")
    c.add_argument("--threshold", type=float, default=0.75)
    c.add_argument("--drop-singletons", action="store_true")
    m = command("summarize", ("urls", {"nargs": "+"}))
    m.add_argument("--sentences", type=int, default=3)
    command("export", ("input", {}))
    return p


def post_process(df: DataFrame, args: argparse.Namespace) -> DataFrame:
    if args.topic:
        df = filter_articles(df, topic=args.topic, topic_mode=args.topic_mode)
    if args.rank_query:
        df = rank_articles(df, args.rank_query, args.rank_method)
    return df


def emit(df: DataFrame, args: argparse.Namespace, out: Any = None) -> None:
    out = out or sys.stdout
    for kind, write in (
        ("md", export.to_markdown), ("json", export.to_json), ("jsonld", export.to_jsonld), ("csv", export.to_csv),
        ("txt", export.to_text)
    ):
        if path := getattr(args, f"export_{kind}"):
            write(df, path)
    rows = rows_of(df, export.order_key(df))
    if args.save:
        export.write_output(args.save, json.dumps(rows, ensure_ascii=False, indent=2))
    if args.json:
        print(json.dumps(rows, ensure_ascii=False, indent=2), file=out)
        return
    for i, r in enumerate(rows, 1):
        print(f"{i}. {r.get('title') or r.get('label') or r.get('url') or 'Untitled'}", file=out)
        for key in ("url", "source", "published", "status", "summary", "size"):
            if r.get(key):
                print(f"   {key}: {r[key]}", file=out)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    transport = feeds.from_store(spark.read.parquet(args.payloads)) if args.payloads else feeds.from_http
    room = Newsroom(spark, transport, spark.read.parquet(args.pages) if args.pages else None)
    cmd = args.command
    if cmd in ("fetch", "search"):
        common = {
            "max_results": args.limit, "language": args.language, "sort_by": args.sort, "time_limit": args.time_limit,
            "full_content": args.full_content, "whitelist": listed(args.whitelist),
            "blacklist": listed(args.blacklist)
        }
        if args.search_in:
            common["search_in"] = listed(args.search_in)
        if cmd == "fetch":
            df = room.fetch(category=args.category, location=args.location, **common)
        else:
            more = {
                "query_mode": args.mode, "exclude_terms": listed(args.exclude), "start_date": args.start_date,
                "end_date": args.end_date, "country": args.country
            }
            if args.stream:
                for fresh in room.search(args.query, refresh_interval=args.interval, **common, **more):
                    emit(post_process(fresh, args), args)
                return 0
            df = room.search(args.query, **common, **more)
    elif cmd == "extract":
        print(json.dumps(room.get_article(args.url), ensure_ascii=False, indent=2, default=str))
        return 0
    elif cmd == "discover":
        df = room.discover_and_get(args.url, args.limit, max_pages=args.max_pages, max_depth=args.max_depth, prefer_rss=not args.no_rss)
    elif cmd == "search-site":
        df = room.search_site(args.keyword, args.domain, args.limit)
    elif cmd == "cluster":
        rows = _saved(spark, args.input) if args.input else room.search(args.query or "", max_results=args.limit)
        df = cluster_articles(
            rows, args.threshold, drop_singletons=args.drop_singletons, rank_query=args.rank_query, topic=args.topic,
            topic_mode=args.topic_mode
        )
        emit(df, args)
        return 0
    elif cmd == "summarize":
        df = room.batch_summarize(args.urls, sentence_count=args.sentences)
        emit(df, args)
        return 0
    else:
        df = _saved(spark, args.input)
    emit(post_process(df, args), args)
    return 0


def _saved(spark: SparkSession, path: str) -> DataFrame:
    from newsloom.api import frame_of

    found = json.loads(Path(path).read_text(encoding="utf-8"))
    items = found.get("clusters") or found.get("articles") or [] if isinstance(found, dict) else found
    flat = [m for x in items for m in (x["articles"] if isinstance(x.get("articles"), list) else [x])]
    return frame_of(spark, flat)


def main(argv: Sequence[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.version:
        print(__version__)
        return 0
    if not args.command:
        build_parser().print_help()
        return 1
    spark = SparkSession.builder.appName("newsloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(args, spark)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
