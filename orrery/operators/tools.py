"""Named tools over one corpus: what a caller asks for by name and arguments, as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import search, sources

#: Other names of tools, and the arguments that may hold a query.
ALIASES = {
    "search": "search_code",
    "search_codebase": "search_code",
    "search_repo": "search_code",
    "search_repository": "search_code",
    "grep": "search_code",
    "search_in_file": "search_code",
    "grep_in_file": "search_code",
    "search_file": "search_code",
    "find_text": "search_code",
    "read": "smart_read",
    "read_file": "read_whole_file",
    "open_file": "read_whole_file",
    "read_source_region": "get_source_region",
    "get_source_region": "get_source_region",
    "source_region": "get_source_region",
    "outline": "get_file_outline",
}
QUERY_ARGUMENTS = ("query", "q", "pattern", "term", "text", "name")


@dataclass(frozen=True)
class Corpus:
    """files (path, language, role, text), lines (path, language, role, line, text), symbols (id, path, name, qualified_name), anchors and notes."""

    files: DataFrame
    lines: DataFrame
    symbols: DataFrame
    anchors: DataFrame
    notes: DataFrame


def clamped(value, default: int, low: int, high: int) -> int:
    """A whole number from a caller, else the default, inside its bounds."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        n = default
    return max(low, min(high, n))


def _query(args: dict) -> str:
    return next((args[k].strip() for k in QUERY_ARGUMENTS if isinstance(args.get(k), str) and args[k].strip()), "")


def chosen(df: DataFrame, args: dict) -> DataFrame:
    """Rows of the role and language that are asked for, where any is."""
    for k in ("role", "language"):
        if args.get(k):
            df = df.filter(F.col(k) == args[k])
    return df


def _path(args: dict) -> str | None:
    return args.get("path") or args.get("file_path") or None


def _search_code(c: Corpus, args: dict) -> DataFrame:
    hits = search.search_code(chosen(c.lines, args), _query(args), clamped(args.get("limit"), 10, 1, 25))
    hits = hits.filter(F.col("path") == _path(args)) if _path(args) else hits
    return with_context(hits, c.lines, clamped(args.get("context_lines"), 2, 0, 8))


def with_context(hits: DataFrame, lines: DataFrame, around: int) -> DataFrame:
    """hits (path, line, score) with start_line, end_line and text of the lines around each; hits are few, so they are broadcast."""
    h = hits.select("path", F.col("line").alias("hit"), "score")
    near = lines.select("path", "line", "text").join(F.broadcast(h), "path").filter(F.abs(F.col("line") - F.col("hit")) <= around)
    g = near.groupBy("path", "hit", "score").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("x"))
    return g.select("path", F.col("hit").alias("line"), "score", "start_line", "end_line", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))


def _ranges(c: Corpus, path: str | None, start: int, end: int) -> DataFrame:
    spark = c.files.sparkSession
    asked = spark.createDataFrame([(0, path or "", start, end)], "request int, path string, start_line long, end_line long")
    return sources.read_ranges(c.lines, asked).drop("request")


def _read_range(c: Corpus, args: dict) -> DataFrame:
    start = clamped(args.get("start_line"), 1, 1, 1 << 30)
    return _ranges(c, _path(args), start, clamped(args.get("end_line"), start, 1, 1 << 30))


def _whole(c: Corpus, args: dict) -> DataFrame:
    own = c.files.filter(F.col("path") == (_path(args) or ""))
    return own.join(sources.whole_files(own), "path").select("path", "token_count", F.when(F.col("readable"), F.col("text")).alias("text"))


def _smart_read(c: Corpus, args: dict) -> DataFrame:
    return _read_range(c, args) if args.get("start_line") else _whole(c, args)


def _expand(c: Corpus, args: dict) -> DataFrame:
    spark = c.files.sparkSession
    start = clamped(args.get("start_line"), 1, 1, 1 << 30)
    region = spark.createDataFrame([(0, _path(args) or "", start, clamped(args.get("end_line"), start, start, 1 << 30))], "region int, path string, start_line long, end_line long")
    last = c.lines.groupBy("path").agg(F.max("line").alias("last"))
    return sources.expanded(region, last, args.get("mode") or "both", clamped(args.get("lines"), 80, 1, 1 << 30)).drop("region")


TOOLS: dict[str, Callable[[Corpus, dict], DataFrame]] = {
    "search_code": _search_code,
    "search_files": lambda c, a: search.search_files(chosen(c.files, a), _query(a), clamped(a.get("limit"), 10, 1, 50)),
    "read_range": _read_range,
    "smart_read": _smart_read,
    "read_whole_file": _whole,
    "expand_region": _expand,
    "get_source_region": _read_range,
    "get_file_outline": lambda c, a: sources.outline(c.lines.filter(F.col("path") == (_path(a) or ""))),
    "find_definition": lambda c, a: search.find_definition(c.symbols, _query(a), clamped(a.get("limit"), 10, 1, 50)),
    "find_references": lambda c, a: search.find_references(c.lines, _query(a), _path(a), clamped(a.get("limit"), 10, 1, 50)),
    "list_anchors": lambda c, a: c.anchors.filter(F.col("kind") == a["kind"]) if a.get("kind") else c.anchors,
    "list_orientation": lambda c, a: c.notes,
    "list_symbols": lambda c, a: c.symbols.filter(F.col("path") == _path(a)) if _path(a) else c.symbols,
}


def run_tool(corpus: Corpus, name: str, args: dict | None = None) -> DataFrame:
    """What a tool returns; an unknown name is an error."""
    name = ALIASES.get(name.strip(), name.strip())
    if name not in TOOLS:
        raise ValueError(f"Unsupported tool: {name}")
    return TOOLS[name](corpus, args or {})
