"""A tool server over standard input and output: JSON-RPC 2.0, a message a line, with the
methods of the Model Context Protocol that a client needs to find and call tools."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from newsloom import __name__ as NAME

PROTOCOL = "2024-11-05"
_TYPES = {"s": "string", "i": "integer", "n": "number", "b": "boolean", "l": "array", "o": "object"}
#: By tool: what it does, and its parameters as name:type, required ones first and marked.
TOOLS = {
    "search_news": (
        "Stories that match a query",
        "query:s! country:s language:s max_results:i query_mode:s exclude_terms:l time_limit:s sort_by:s full_content:b"
    ),
    "fetch_news": ("Stories of a category or place", "category:s location:s max_results:i time_limit:s sort_by:s full_content:b"),
    "get_article": ("One page as an article", "url:s!"),
    "search_site_news": ("Stories of one site", "keyword:s! domain:s! limit:i query_mode:s language:s full_content:b"),
    "discover_site_news": ("A site's feed, or else a crawl of it", "url:s! limit:i js:b max_pages:i max_depth:i prefer_rss:b full_content:b"),
    "summarize_articles": ("Summaries of the articles behind URLs", "urls:l! sentence_count:i include_full_text:b dedupe:b"),
    "summarize_text_content": ("Summary of a text", "text:s! sentence_count:i"),
    "filter_news": ("Articles that pass filters", "items:l! query:s query_mode:s exclude_terms:l topic:s topic_mode:s"),
    "rank_news": ("Articles by relevance", "items:l! query:s! method:s top_k:i"),
    "cluster_news": ("Articles grouped into stories", "items:l! threshold:n min_cluster_size:i sort_by:s"),
    "export_news": ("Articles as csv, json, jsonld, markdown or text", "items:l! format:s"),
}


def listing() -> list[dict[str, Any]]:
    """Name, description and input schema of every tool."""
    out = []
    for name, (what, parameters) in TOOLS.items():
        named = [p.rstrip("!").split(":") for p in parameters.split()]
        required = [p.split(":")[0] for p in parameters.split() if p.endswith("!")]
        out.append(
            {
                "name": name, "description": what,
                "inputSchema": {"type": "object", "properties": {n: {"type": _TYPES[t]} for n, t in named}, "required": required}
            }
        )
    return out


def answer(message: Any, tools: dict[str, Callable[..., Any]]) -> dict[str, Any] | None:
    """The reply to one request; None for a notification."""
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return _failed(message.get("id") if isinstance(message, dict) else None, -32600, "not a JSON-RPC 2.0 request")
    if "id" not in message:
        return None
    method, given, number = message["method"], message.get("params") or {}, message["id"]
    if method == "initialize":
        result: Any = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": "0.1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": listing()}
    elif method == "tools/call":
        name, arguments = given.get("name"), given.get("arguments") or {}
        if name not in tools:
            return _failed(number, -32602, f"no tool {name!r}")
        try:
            made, wrong = tools[name](**arguments), False
        except Exception as e:  # a tool's failure is its result, the server goes on
            made, wrong = f"{type(e).__name__}: {e}", True
        text = made if isinstance(made, str) else json.dumps(made, ensure_ascii=False, default=str)
        result = {"content": [{"type": "text", "text": text}], "isError": wrong}
    else:
        return _failed(number, -32601, f"no method {method!r}")
    return {"jsonrpc": "2.0", "id": number, "result": result}


def _failed(number: Any, code: int, why: str) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": why}}


def serve(tools: dict[str, Callable[..., Any]], lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answer every line until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(json.loads(line), tools)
        except json.JSONDecodeError:
            reply = _failed(None, -32700, "not JSON")
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()


def main() -> None:
    from pyspark.sql import SparkSession

    from newsloom.api import Newsroom, tools

    serve(tools(Newsroom(SparkSession.builder.appName(NAME).getOrCreate())))


if __name__ == "__main__":
    main()
