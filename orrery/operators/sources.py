"""Reading sources: exact ranges, whole files under a budget, regions and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import stable_id, token_estimate

#: How many tokens a whole file may have.
BUDGET = 30_000
#: What begins a declaration in script files.
_SCRIPT = [
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)",
    r"^\s*(?:export\s+)?class\s+([A-Za-z_$][\w$]*)",
    r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>",
]
#: What begins a declaration on a line, by language; the other languages go by the script patterns.
STARTS = {
    "python": [r"^\s*class\s+([A-Za-z_][\w]*)", r"^\s*(?:async\s+)?def\s+([A-Za-z_][\w]*)"],
    "go": [r"^\s*func\s+(?:\([^)]+\)\s*)?([A-Za-z_][\w]*)"],
    "rust": [r"^\s*(?:pub\s+)?fn\s+([A-Za-z_][\w]*)", r"^\s*(?:pub\s+)?(?:struct|enum|trait|impl)\s+([A-Za-z_][\w]*)?"],
    "java": [r"^\s*(?:public|private|protected)?\s*(?:class|interface|enum)\s+([A-Za-z_][\w]*)", r"^\s*(?:public|private|protected)?\s*(?:static\s+)?[\w<>\[\]]+\s+([A-Za-z_][\w]*)\s*\("],
}
#: A marked heading, and what underlines one.
HEADING, UNDERLINE = r"^\s{0,3}#{1,6}\s+(.+?)\s*$", r"^\s*(=+|-+)\s*$"


def normalized_path(path: Column) -> Column:
    """path with forward slashes and without . and .. where these can be followed; null where it leaves the root or is absolute."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    # a step up from the root leaves a mark that no later step takes away
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    return F.when(~p.startswith("/") & (F.size(parts) > 0) & (F.element_at(parts, 1) != ".."), F.array_join(parts, "/"))


def read_ranges(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """request, path, start_line, end_line, text, error of requests (request, path, start_line, end_line).

    The end is cut to the file's; what cannot be read has an error and no text. Only lines that are asked for are joined.
    """
    last = lines.groupBy("path").agg(F.max("line").alias("last"))
    df = requests.join(last, "path", "left")
    error = (
        F.when(F.col("last").isNull(), "no such file")
        .when(F.col("start_line") < 1, "start_line must be >= 1")
        .when(F.col("end_line") < F.col("start_line"), "end_line must be >= start_line")
        .when(F.col("start_line") > F.col("last"), "start_line is beyond end of file")
    )
    df = df.withColumn("error", error).withColumn("end_line", F.when(error.isNull(), F.least("end_line", "last")).otherwise(F.col("end_line")))
    asked = df.filter("error is null").select("request", "path", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    got = asked.join(lines.select("path", "line", "text"), ["path", "line"]).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("x"))
    got = got.select("request", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))
    return df.join(got, "request", "left").select("request", "path", "start_line", "end_line", "text", "error")


def whole_files(files: DataFrame, budget: int = BUDGET) -> DataFrame:
    """path, token_count, readable of files (path, text): whether a file may be read whole, within the budget of tokens."""
    n = token_estimate(F.col("text"))
    return files.select("path", n.alias("token_count"), (n <= budget).alias("readable"))


def region_ids(regions: DataFrame, run_id: str = "run") -> DataFrame:
    """regions (path, start_line, end_line, content_hash, region_type) with region_id."""
    return regions.withColumn("region_id", stable_id("region", F.lit(run_id), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content_hash"), F.col("region_type")))


def expanded(regions: DataFrame, last: DataFrame, mode: str, by: int = 80) -> DataFrame:
    """path, start_line, end_line of regions (region, path, start_line, end_line) after growing up, down, both or whole_file; last: (path, last)."""
    a, b = F.col("start_line"), F.col("end_line")
    up, down = F.greatest(F.lit(1), a - by), F.least(F.col("last"), b + by)
    grown = {"up": (up, b), "down": (a, down), "both": (up, down), "whole_file": (F.lit(1), F.greatest(F.lit(1), F.col("last")))}
    if mode not in grown:
        raise ValueError(f"no such mode: {mode}")
    start, end = grown[mode]
    return regions.join(last, "path").select("region", "path", start.cast("long").alias("start_line"), end.cast("long").alias("end_line"))


def outline(lines: DataFrame) -> DataFrame:
    """path, start_line, end_line, label, kind, confidence of lines (path, language, role, line, text).

    Prose goes by headings, marked or underlined, and code by what begins a declaration; a file without either is one item.
    An item ends before the next one begins.
    """
    prose = F.col("language").isin("markdown", "rst", "text") | (F.col("role") == "docs")
    here = Window.partitionBy("path").orderBy("line")
    marked = F.regexp_extract("text", HEADING, 1)
    under = F.lead("text").over(here).rlike(UNDERLINE) & (F.trim("text") != "")
    heading = F.when(marked != "", F.trim(marked)).when(under, F.trim("text"))
    first = lambda patterns: F.coalesce(*[F.when(F.col("text").rlike(p), F.coalesce(F.nullif(F.regexp_extract("text", p, 1), F.lit("")), F.trim("text"))) for p in patterns])
    declared = first(_SCRIPT)
    for language, patterns in STARTS.items():
        declared = F.when(F.col("language") == language, first(patterns)).otherwise(declared)
    df = lines.withColumn("heading", F.when(prose, heading)).withColumn("declared", declared)
    every = df.groupBy("path").agg(F.max("line").alias("last"), F.count("heading").alias("headings"), F.count("declared").alias("declarations"))
    label = F.when(F.col("headings") > 0, F.col("heading")).otherwise(F.col("declared"))
    starts = df.select("path", "line", "heading", "declared").filter("heading is not null or declared is not null").join(every, "path").withColumn("label", label).filter("label is not null")
    nxt = F.lead("line").over(here)
    items = starts.select("path", F.col("line").alias("start_line"), F.greatest(F.col("line"), F.coalesce(nxt - 1, F.col("last"))).alias("end_line"), "label", F.when(F.col("headings") > 0, "section").otherwise("symbol").alias("kind"), F.when(F.col("headings") > 0, 0.75).otherwise(0.55).alias("confidence"))
    bare = every.filter("headings = 0 and declarations = 0")
    return items.unionByName(bare.select("path", F.lit(1).cast("long").alias("start_line"), F.col("last").alias("end_line"), F.col("path").alias("label"), F.lit("file").alias("kind"), F.lit(0.35).alias("confidence")))
