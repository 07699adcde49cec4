"""What a reader is shown of a node: slices of its source, steps of a lens, explanations, answers, and the texts of documents.

Caps are those of a screen. A rank is limited within its own key before rows travel, so a large key costs no large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import stable_id

#: How sure a status is, and what is said where nothing matched.
CONFIDENCE = {"verified": 1.0, "inferred": 0.65, "orientation_only": 0.65, "uncertain": 0.35}
NO_ANSWER = "The System Overview does not contain enough detail to answer this question. Try asking a more specific question about the codebase architecture."


def _first(df: DataFrame, keys: list[str], order: list[str], most: int, name: str) -> DataFrame:
    """The first `most` rows of each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= most)


def terms(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, in lower case, of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def slices(regions: DataFrame, nodes: DataFrame, tabs: int = 5, most: int = 20) -> DataFrame:
    """Highlights (node, tab, role, path, summary, rank, region, start_line, end_line, confidence) of a node's first files.

    regions: (node, region, path, start_line, end_line, place), in order of place; nodes: (node, status). A file stands where
    its first region does; its summary counts all its regions, also those that are not shown.
    """
    files = regions.groupBy("node", "path").agg(F.min("place").alias("at"), F.count(F.lit(1)).alias("n"))
    shown = _first(files, ["node"], ["at", "path"], tabs, "tab")
    rows = _first(regions, ["node", "path"], ["place", "region", "start_line", "end_line"], most, "rank").join(shown, ["node", "path"]).join(nodes, "node")
    return rows.select(
        "node", "tab", F.when(F.col("tab") == 1, "primary").otherwise("supporting").alias("role"), "path",
        F.concat(F.col("n").cast("string"), F.lit(" highlighted source region(s).")).alias("summary"), "rank", "region", "start_line", "end_line",
        F.when(F.col("status") == "verified", 1.0).otherwise(0.5).alias("confidence"),
    )


def slice_heads(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, status, primary_span, strength, unsupported_reason) of every node, without regions too."""
    first = regions.groupBy("node").agg(F.min(F.struct("place", "path", "region")).alias("x"))
    df = nodes.join(first, "node", "left")
    strength = F.when(F.col("x").isNull(), 0.0).when(F.col("status") == "verified", 1.0).otherwise(0.5)
    reason = F.when(F.col("x").isNull(), "no_source_regions").otherwise("")
    return df.select("node", F.when(F.col("x").isNull(), "insufficient").otherwise(F.col("status")).alias("status"), F.col("x.region").alias("primary_span"), strength.alias("strength"), reason.alias("unsupported_reason"))


def confidence(status: Column) -> Column:
    """The number that a support status stands for; 0 for any other."""
    out = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def mean_confidence(claims: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, confidence): the mean over a group's claims (group, status); 0 for one without claims."""
    per = claims.groupBy("group").agg(F.avg(confidence(F.col("status"))).alias("confidence"))
    return groups.select("group").join(per, "group", "left").na.fill(0.0, ["confidence"])


def steps(children: DataFrame, regions: DataFrame, length: int = 200) -> DataFrame:
    """Evidence (child, region, path, start_line, end_line, preview, status, confidence, reason) of a lens's children.

    children: (child, label, summary, status, confidence, region), one row for each region named; regions that are not known
    give no row. A child without a summary is explained by its label.
    """
    found = children.join(regions.select("region", "path", "start_line", "end_line", F.substring("text", 1, length).alias("preview")), "region")
    reason = F.coalesce(F.nullif("summary", F.lit("")), F.col("label"))
    return found.select("child", "region", "path", "start_line", "end_line", "preview", "status", "confidence", reason.alias("reason"))


def file_groups(named: DataFrame, regions: DataFrame) -> DataFrame:
    """Children (component, id, label, region, path, status, confidence) where no lens is at hand: one for each file of a component.

    named: (component, label, region, place); regions: (region, path). The first known region of a file stands for it.
    """
    first = named.join(regions.select("region", "path"), "region").groupBy("component", "path").agg(F.min(F.struct("place", "region", "label")).alias("x"))
    return first.select(
        "component", stable_id("lens-child", F.col("component"), F.col("path")).alias("id"), "path", F.col("x.region").alias("region"),
        F.concat(F.lit("Source-backed file group for "), F.col("x.label"), F.lit(".")).alias("summary"), F.lit("uncertain").alias("status"), F.lit(0.35).alias("confidence"),
    )


def claim_regions(children: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """(child, region): regions cited by claims that share a term with a child's label, or cite a file that shares one with its paths.

    children: (child, label, paths); claims: (claim, text); citations: (claim, region, path). Terms meet by equality.
    """
    by_label = children.select("child", F.explode(terms(F.col("label"))).alias("term")).join(claims.select("claim", F.explode(terms(F.col("text"))).alias("term")), "term").select("child", "claim").distinct()
    paths = children.select("child", F.explode("paths").alias("path")).select("child", F.explode(terms(F.col("path"))).alias("term")).distinct()
    cited = citations.select("path").distinct().select("path", F.explode(terms(F.col("path"))).alias("term"))
    files = paths.join(cited, "term").select("child", "path").distinct()
    by_path = files.join(citations.select("claim", "path").distinct(), "path").select("child", "claim").distinct()
    return by_label.unionByName(by_path).distinct().join(citations.filter("region is not null").select("claim", "region").distinct(), "claim").select("child", "region").distinct()


def _lines(rows: DataFrame, key: str, text: Column, order: list[str], most: int, beyond: str | None = None) -> DataFrame:
    """(key, body): the first `most` texts below one another, and a line on how many more there are."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    shown = _first(rows.withColumn("_text", text), [key], [*order, "_text"], most, "r").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "_text"))).alias("x"))
    body = F.array_join("x._text", "\n")
    if beyond:
        body = F.concat(body, F.when(F.col("n") > most, F.concat(F.lit("\n" + beyond.split("{}")[0]), (F.col("n") - most).cast("string"), F.lit(beyond.split("{}")[1]))).otherwise(""))
    return shown.join(n, key).select(key, body.alias("body"))


def symbol_facts(symbols: DataFrame, most: int = 20) -> DataFrame:
    """(id, facts): what is known of each symbol, one fact a line, its first children last.

    symbols: (id, parent, kind, name, qualified_name, path, start_line, end_line, signature).
    """
    child = F.concat(F.lit("  - "), F.concat_ws(" ", "kind", "name"), F.lit(" (lines "), F.concat_ws("-", "start_line", "end_line"), F.lit(")"))
    inner = _lines(symbols.filter("parent is not null").withColumnRenamed("parent", "of"), "of", child, ["start_line"], most, "  - ... and {} more")
    outer = symbols.select(F.col("id").alias("parent"), F.concat_ws(" ", "kind", "qualified_name").alias("inside"))
    df = symbols.join(outer, "parent", "left").join(inner.withColumnRenamed("of", "id"), "id", "left")
    span = F.concat_ws("-", "start_line", "end_line")
    facts = [
        F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("name: "), "name"), F.concat(F.lit("qualified_name: "), "qualified_name"), F.concat(F.lit("path: "), "path"), F.concat(F.lit("lines: "), span),
        F.concat(F.lit("signature: "), F.coalesce(F.nullif("signature", F.lit("")), F.col("name"))), F.concat(F.lit("declared inside: "), "inside"), F.concat(F.lit("contains:\n"), "body"),
    ]
    return df.select("id", F.concat_ws("\n", *facts).alias("facts"))


def module_facts(modules: DataFrame, symbols: DataFrame, most: int = 20) -> DataFrame:
    """(path, facts) of modules (path, summary) with their top-level symbols (path, kind, name, start_line, end_line)."""
    line = F.concat(F.lit("  - "), F.concat_ws(" ", "kind", "name"), F.lit(" (lines "), F.concat_ws("-", "start_line", "end_line"), F.lit(")"))
    top = _lines(symbols, "path", line, ["start_line"], most, "  - ... and {} more")
    declared = F.coalesce(F.concat(F.lit("top-level declarations:\n"), "body"), F.lit("top-level declarations: (none parsed)"))
    summary = F.concat(F.lit("parser-derived summary: "), F.nullif("summary", F.lit("")))
    return modules.join(top, "path", "left").select("path", F.concat_ws("\n", F.lit("kind: module"), F.concat(F.lit("path: "), "path"), summary, declared).alias("facts"))


def bullets(groups: DataFrame, rows: DataFrame, empty: str, most: int) -> DataFrame:
    """(group, body): the first `most` rows (group, place, text) as a list; `empty` for a group without rows."""
    body = _lines(rows, "group", F.concat(F.lit("- "), "text"), ["place"], most)
    return groups.select("group").join(body, "group", "left").na.fill(empty, ["body"])


def declarations(symbols: DataFrame) -> DataFrame:
    """(id, summary, documentation) of symbols (id, kind, name, qualified_name, path, start_line, end_line, signature)."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    kind = F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))
    summary = F.concat(kind, F.lit(" "), tick("qualified_name"), F.lit(" is declared in "), tick("path"), F.lit(" at lines "), F.concat_ws("-", "start_line", "end_line"), F.lit("."))
    note = ". No separate authored component documentation was found; the source below is authoritative."
    text = F.concat(summary, F.lit("\n\nSource declaration: "), tick(F.coalesce(F.nullif("signature", F.lit("")), F.col("name"))), F.lit(note))
    return symbols.select("id", summary.alias("summary"), text.alias("documentation"))


def explanations(nodes: DataFrame, evidence: DataFrame, duties: DataFrame, most: int = 40) -> DataFrame:
    """Claims (node, part, text, support, evidence) that explain a node.

    nodes: (node, description, status); evidence: (node, id), of which at most `most` count; duties: (node, text). A node
    without duties is explained by its description, and what is not backed by evidence is insufficient.
    """
    n = evidence.groupBy("node").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("evidence"))
    df = nodes.join(n, "node", "left").na.fill(0, ["evidence"])
    own = df.join(duties, "node").select("node", F.lit("responsibility").alias("part"), "text", F.when(F.col("status") == "candidate", "inferred").otherwise(F.col("status")).alias("support"), "evidence")
    rest = df.join(duties.select("node").distinct(), "node", "left_anti").filter("description <> ''")
    rest = rest.select("node", F.lit("responsibility").alias("part"), F.col("description").alias("text"), F.when(F.col("evidence") > 0, F.col("status")).otherwise("insufficient").alias("support"), "evidence")
    text = F.concat(F.col("evidence").cast("string"), F.lit(" source-backed evidence item(s) support this node."))
    happens = df.select("node", F.lit("what_happens").alias("part"), text.alias("text"), F.when(F.col("evidence") > 0, "verified").otherwise("insufficient").alias("support"), "evidence")
    return own.unionByName(rest).unionByName(happens)


def answers(questions: DataFrame, components: DataFrame, claims: DataFrame, most: int = 5) -> DataFrame:
    """(question, answer, confidence) from matched components (question, label, place) and claims (question, text, place)."""

    def listed(rows: DataFrame, column: str, sep: str, name: str) -> DataFrame:
        shown = _first(rows, ["question"], ["place", column], most, "r").groupBy("question").agg(F.array_sort(F.collect_list(F.struct("r", column))).alias("x"))
        return shown.select("question", F.array_join(f"x.{column}", sep).alias(name))

    df = questions.select("question").join(listed(components, "label", ", ", "areas"), "question", "left").join(listed(claims, "text", "; ", "findings"), "question", "left")
    areas = F.concat(F.lit("Based on the System Overview, the relevant architecture areas are: "), "areas", F.lit("."))
    said = F.concat_ws(" ", areas, F.concat(F.lit("Key findings: "), "findings"))
    return df.select("question", F.when(said == "", NO_ANSWER).otherwise(said).alias("answer"), F.when(F.col("findings").isNotNull(), 0.55).otherwise(0.35).alias("confidence"))


def coverage(questions: DataFrame, lenses: DataFrame) -> DataFrame:
    """(question, lens_count, evidence_count, confidence) over lenses (question, evidence, confidence)."""
    per = lenses.groupBy("question").agg(F.count(F.lit(1)).alias("lens_count"), F.sum("evidence").alias("evidence_count"), F.max("confidence").alias("confidence"))
    return questions.select("question").join(per, "question", "left").na.fill(0, ["lens_count", "evidence_count"]).na.fill(0.0, ["confidence"])


def input_keys(rows: DataFrame, model: str, mode: str) -> DataFrame:
    """(run, key): a key of all rows (run, item) that an overview is made from, with the model and the mode.

    Sums of hashes do not depend on the order of rows and are added up before they travel; repeated rows change them.
    """
    part = lambda at: F.conv(F.substring(F.sha1("item"), at, 15), 16, 10).cast("decimal(38,0)")
    per = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))
    return per.select("run", F.sha1(F.concat_ws("|", F.lit(model), F.lit(mode), "run", "n", "a", "b")).alias("key"))
