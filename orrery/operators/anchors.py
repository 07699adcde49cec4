"""Semantic anchors by a table of line rules, and orientation notes of documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """kind of anchor and how it is found; pattern on a line; roles left out; whether only a file's first hit counts.

    Where `beside` is given, the file's path or text must fit that too; that is for rules of a file's first hit. Lines that the
    pattern fits hold one of `needs` in lower case, and what `beside` fits one of `beside_needs`: few lines come to a pattern.
    """

    kind: str
    method: str
    confidence: float
    pattern: str
    without: tuple[str, ...]
    first: bool
    needs: tuple[str, ...]
    beside: str | None = None
    beside_needs: tuple[str, ...] = ()


#: Borders of words in any script; engines differ in what they take for a letter.
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
NOT_CODE, NOT_DOCS = ("docs", "test", "example"), ("docs", "test")
#: Rules in the order in which kinds are shown.
RULES = [
    Rule("http_route", "python_route_decorator", 0.92, r"(?i)@\s*(app|router|blueprint|bp)\.(get|post|put|patch|delete|head|options|route)\s*\(\s*['\"][^'\"]+['\"]", NOT_CODE, False, ("app.", "router.", "blueprint.", "bp.")),
    Rule("http_route", "python_route_map_assignment", 0.90, r"(?i)routes\s*\[\s*['\"](GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+[^'\"]+['\"]\s*\]", NOT_CODE, False, ("routes",)),
    Rule("http_route", "javascript_route_call", 0.86, rf"(?i){_B}(app|router|server)\.(get|post|put|patch|delete|head|options|all)\s*\(\s*['`][^'`]+['`]", NOT_CODE, False, ("app.", "router.", "server.")),
    Rule("cli_command", "python_main_guard", 0.86, r"__name__.*__main__", NOT_DOCS, False, ("__main__",)),
    Rule("cli_command", "cli_library_signal", 0.78, r"(?i)argparse\.argumentparser|click\.command|typer\(", NOT_DOCS, False, ("argparse.", "click.", "typer(")),
    Rule("worker", "worker_signal", 0.72, rf"(?i)@(shared_task|celery\.task)|{_B}new\s+Worker{_E}|{_B}Queue\(", NOT_DOCS, True, ("worker", "queue(", "@shared_task", "@celery.")),
    Rule("cron_job", "cron_or_schedule_signal", 0.74, rf"(?i){_B}(cron\.schedule|schedule\.every|@scheduled|crontab|cronjob|schedule:)", NOT_DOCS, True, ("cron", "schedule")),
    Rule("webhook", "webhook_signal", 0.78, r"(?i)webhook", NOT_DOCS, True, ("webhook",)),
    Rule("db_schema", "schema_or_migration_file", 0.76, rf"(?i){_B}(create\s+table|alter\s+table|create\s+index){_E}", NOT_DOCS, True, ("create", "alter")),
    Rule("queue_boundary", "queue_signal", 0.67, rf"(?i){_B}(queue|publish|subscribe|consumer|producer|enqueue|dequeue|rabbitmq|kafka|sqs){_E}", NOT_DOCS, True, ("queue", "publish", "subscribe", "consumer", "producer", "rabbitmq", "kafka", "sqs")),
    Rule("external_api_client", "outbound_http_signal", 0.68, rf"(?i){_B}(fetch|axios\.\w+|httpx\.\w+|requests\.\w+)\s*\(|https?://[^'\"\s]+", NOT_CODE, True, ("fetch", "axios.", "http", "requests.")),
    Rule("plugin_registry", "plugin_registry_signal", 0.66, rf"(?i){_B}(plugin|extension|registry|register_plugin|register\()", NOT_DOCS, True, ("plugin", "extension", "registry", "register("), rf"(?i){_B}(plugin|extension|registry){_E}", ("plugin", "extension", "registry")),
    Rule("auth_boundary", "auth_signal", 0.70, rf"(?i){_B}(auth|authenticate|authorization|jwt|token|session|permission|login){_E}", NOT_DOCS, True, ("auth", "jwt", "token", "session", "permission", "login"), rf"(?i){_B}(auth|jwt|token|session|permission|login){_E}", ("auth", "jwt", "token", "session", "permission", "login")),
]
#: What a document may be about.
SIGNALS = ["api", "auth", "authentication", "authorization", "cli", "client", "database", "deployment", "docker", "event", "frontend", "http", "integration", "job", "queue", "route", "server", "service", "test", "transport", "webhook", "worker", "workflow"]
DETECTED = 0.7
#: Manifests that orient a reader, and the order of notes.
NOTED_MANIFESTS = ["package.json", "pyproject.toml", "requirements.txt", "go.mod", "Cargo.toml", "docker-compose.yml", "docker-compose.yaml"]
NOTE_ORDER = ["readme", "manifest", "docs_page", "deployment_note", "example", "config", "text_note"]


#: What a route's label is taken from, by method.
ROUTES = {
    "python_route_decorator": r"(?i)@\s*(?:app|router|blueprint|bp)\.(get|post|put|patch|delete|head|options|route)\s*\(\s*['\"]([^'\"]+)['\"]",
    "python_route_map_assignment": r"(?i)routes\s*\[\s*['\"](GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+([^'\"]+)['\"]\s*\]",
    "javascript_route_call": r"(?i)(?:app|router|server)\.(get|post|put|patch|delete|head|options|all)\s*\(\s*['`]([^'`]+)['`]",
}


def _label(method: str, text: Column, path: Column) -> Column:
    if method in ROUTES:
        return F.concat(F.upper(F.regexp_extract(text, ROUTES[method], 1)), F.lit(" "), F.regexp_extract(text, ROUTES[method], 2))
    return {"python_main_guard": F.lit("Python module entrypoint"), "cli_library_signal": F.lit("CLI command setup")}.get(method, path)


def _holds(low: Column, needs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in needs:
        out = out | low.contains(x)
    return out


def line_anchors(lines: DataFrame) -> DataFrame:
    """kind, path, line, label, method, confidence, status from lines (path, role, line, text): all rules in one pass.

    Of one kind, file, line and label (in lower case) the most certain method stays, then the first in order of rules. Lines
    that no rule can fit go by plain search before any pattern is tried, and files meet once, with what was found on a line.
    """
    low, paths = F.col("low"), F.col("low_path")

    def hit(i: int, r: Rule) -> Column:
        fits = ~F.col("role").isin(list(r.without)) & _holds(low, r.needs) & F.col("text").rlike(r.pattern)
        label = _label(r.method, F.col("text"), F.col("path"))
        row = lambda found, met: F.struct(
            F.lit(i).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.method).alias("method"), F.lit(r.confidence).alias("confidence"),
            F.when(found, F.col("line")).alias("line"), F.lit(r.first).alias("first"), met.alias("met"), label.alias("label"),
        )
        if not r.beside:
            return F.when(fits, row(F.lit(True), F.lit(True)))
        fits = F.coalesce(fits, F.lit(False))
        met = (_holds(low, r.beside_needs) & F.col("text").rlike(r.beside)) | (_holds(paths, r.beside_needs) & F.col("path").rlike(r.beside))
        met = F.coalesce(met, F.lit(False))
        return F.when(fits | met, row(fits, met))

    any_ = _holds(low, tuple(dict.fromkeys(n for r in RULES for n in (*r.needs, *r.beside_needs))))
    df = lines.filter("path is not null").withColumn("low", F.lower("text")).withColumn("low_path", F.lower("path")).filter(any_)
    df = df.select("path", F.explode(F.array_compact(F.array(*[hit(i, r) for i, r in enumerate(RULES)]))).alias("x")).select("path", "x.*")
    # a file's first hit, or each; a rule's second condition may be met on any of its lines
    at = F.when(~F.col("first"), F.col("line"))
    df = df.groupBy("path", "rule", "kind", "method", "confidence", "label", at.alias("at")).agg(F.min("line").alias("line"), F.max("met").alias("met")).filter("met and line is not null")
    best = F.row_number().over(Window.partitionBy("kind", "path", "line", F.lower("label")).orderBy(F.desc("confidence"), "rule"))
    df = df.withColumn("r", best).filter("r = 1")
    return df.select("kind", "path", "line", "label", "method", "confidence", F.when(F.col("confidence") >= DETECTED, "source_detected").otherwise("candidate").alias("status"))


#: What a package's own file gives out, how many names of a line count, and how sure that is.
PACKAGE_IMPORT, PACKAGE_LIST = r"^\s*from\s+\.[\w.]+\s+import\s+(.+)$", r"^\s*__all__\s*=\s*\[(.+)\]"
MOST_IMPORTED, MOST_LISTED, SURE_IMPORTED, SURE_LISTED = 12, 20, 0.86, 0.88


def export_anchors(lines: DataFrame) -> DataFrame:
    """path, line, label, method, confidence of names that a Python package's own file gives out; lines: (path, role, line, text)."""
    own = lines.filter(F.element_at(F.split("path", "/"), -1) == "__init__.py").filter(~F.col("role").isin(list(NOT_CODE)))
    taken = F.regexp_extract("text", PACKAGE_IMPORT, 1)
    listed = F.regexp_extract("text", PACKAGE_LIST, 1)
    names = F.transform(F.split(taken, ","), lambda x: F.element_at(F.split(F.trim(x), " as "), 1))
    imported = own.filter(taken != "").select("path", "line", F.explode(F.slice(names, 1, MOST_IMPORTED)).alias("label")).filter("label <> '' and not startswith(label, '_')")
    quoted = F.regexp_extract_all(listed, F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))
    given = own.filter((taken == "") & (listed != "")).select("path", "line", F.explode(F.slice(quoted, 1, MOST_LISTED)).alias("label"))
    out = imported.select("path", "line", "label", F.lit("python_package_init_import").alias("method"), F.lit(SURE_IMPORTED).alias("confidence"))
    return out.unionByName(given.select("path", "line", "label", F.lit("python_dunder_all").alias("method"), F.lit(SURE_LISTED).alias("confidence")))


def manifest_anchors(files: DataFrame) -> DataFrame:
    """kind, path, label, method, confidence of package.json files (path, role, text): scripts, exports and main; broken JSON gives none."""
    own = files.filter(F.element_at(F.split("path", "/"), -1) == "package.json")
    text = F.col("text")
    scripts = F.slice(F.map_keys(F.from_json(F.get_json_object(text, "$.scripts"), "map<string,string>")), 1, 20)
    row = lambda k, label, m, c: F.struct(F.lit(k).alias("kind"), label.alias("label"), F.lit(m).alias("method"), F.lit(c).alias("confidence"))
    exports, main = F.get_json_object(text, "$.exports"), F.get_json_object(text, "$.main")
    run = F.when(~F.col("role").isin(list(NOT_DOCS)), F.transform(scripts, lambda x: row("cli_command", F.concat(F.lit("npm script: "), x), "package_json_script", 0.72)))
    rest = F.array_compact(F.array(F.when(exports.isNotNull() & ~exports.isin("", "{}", "[]"), row("public_export", F.lit("package exports"), "package_json_exports", 0.80)), F.when(main != "", row("public_export", F.concat(F.lit("package main: "), main), "package_json_main", 0.72))))
    return own.select("path", F.explode(F.concat(F.coalesce(run, F.slice(rest, 1, 0)), rest)).alias("x")).select("x.kind", "path", "x.label", "x.method", "x.confidence")


def signals(text: Column, limit: int = 20_000) -> Column:
    """Subjects that a text names, in order; an s may follow."""
    head = F.lower(F.substring(text, 1, limit))
    return F.array_compact(F.array(*[F.when(head.rlike(f"{_B}{s}s?{_E}"), F.lit(s)) for s in SIGNALS]))


def path_anchors(files: DataFrame) -> DataFrame:
    """kind, path, method, confidence from files (path, language, role) by where they lie."""
    p, name = F.lower("path"), F.element_at(F.split(F.lower("path"), "/"), -1)
    code = ~F.col("role").isin(list(NOT_CODE))
    screen = code & F.col("language").isin("javascript", "typescript", "svelte", "vue") & (F.concat(F.lit("/"), p).rlike("/(pages|routes)/") | F.concat(F.lit("/"), p).rlike(r"/app/.+/page\.(tsx|jsx|ts|js)$") | name.isin("+page.svelte", "page.tsx", "page.jsx", "page.ts", "page.js"))
    open_ = ~F.col("role").isin(list(NOT_DOCS))
    deploy = (F.col("role") == "infrastructure") | name.isin("dockerfile", "docker-compose.yml", "docker-compose.yaml") | (name.rlike(r"\.(tf|ya?ml)$") & p.rlike(r"\b(k8s|deploy|helm|terraform|docker)\b"))
    # fixed values: kinds by where a file lies, how each is found, and how sure that is
    rules = [
        (screen, "frontend_screen", "frontend_route_file", 0.78), (open_ & p.rlike(r"/cli\.|/cmd/|/commands/"), "cli_command", "cli_path_signal", 0.65),
        (open_ & p.rlike(r"\b(worker|workers|consumer|job|jobs|task|tasks)\b"), "worker", "worker_signal", 0.62), (open_ & p.rlike(r"\b(cron|schedule|scheduler)\b"), "cron_job", "cron_or_schedule_signal", 0.60),
        (open_ & ((F.col("language") == "sql") | p.rlike(r"\b(migration|migrations|schema\.prisma|models?)\b")), "db_schema", "schema_or_migration_file", 0.76), (deploy, "deployment_unit", "deployment_file", 0.75),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(m).alias("method"), F.lit(v).alias("confidence"))) for c, k, m, v in rules]))
    return files.select("path", F.explode(hits).alias("x")).select("x.kind", "path", "x.method", "x.confidence")


def headings(lines: DataFrame, most: int = 40) -> DataFrame:
    """path, headings: marked by # or underlined by = or -, in order, at most `most`."""
    w = Window.partitionBy("path").orderBy("line")
    under = F.lead("text").over(w).rlike(r"^(=+|-+)\s*$") & (F.length(F.trim("text")) > 0) & ~F.col("text").rlike(r"^\s*(#|=+\s*$|-+\s*$)")
    title = F.when(F.col("text").rlike(r"^#{1,6}\s+\S"), F.trim(F.regexp_replace("text", r"^#{1,6}\s+|\s+#*\s*$", ""))).when(under, F.trim("text"))
    df = lines.withColumn("title", title).filter("title is not null").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return df.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("headings"))


def orientation(files: DataFrame) -> DataFrame:
    """path, kind, priority, trust_level, proof_allowed, signals, summary of files (path, language, role, text) that orient a reader."""
    from orrery.functions.text import preview

    name = F.lower(F.element_at(F.split("path", "/"), -1))
    prose = F.col("language").isin("markdown", "rst", "text")
    kind = (
        F.when(name.startswith("readme") & prose, "readme")
        .when((F.col("role") == "docs") & prose, "docs_page")
        .when((F.col("role") == "example") & F.col("language").isin("markdown", "rst", "text", "python", "javascript", "typescript"), "example")
        .when((F.col("role") == "infrastructure") & F.col("language").isin("markdown", "text", "yaml", "json", "dockerfile"), "deployment_note")
        .when(F.element_at(F.split("path", "/"), -1).isin(NOTED_MANIFESTS), "manifest")
        .when(F.col("role") == "config", "config")
        .when(F.col("language").isin("text", "rst"), "text_note")
    )
    order = {kind: i for i, kind in enumerate(NOTE_ORDER)}
    df = files.withColumn("kind", kind).filter("kind is not null")
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return df.select("path", "kind", F.element_at(rank, F.col("kind")).alias("priority"), F.when(F.col("kind") == "manifest", "metadata_guidance").otherwise("guidance_only").alias("trust_level"), F.lit(False).alias("proof_allowed"), signals(F.concat_ws(" ", "path", "text")).alias("signals"), preview(F.col("text"), 360).alias("summary"))


#: The order of kinds where anchors are shown, files that are a public surface, and folders that are none.
KIND_ORDER = ["http_route", "frontend_screen", "cli_command", "worker", "cron_job", "webhook", "db_schema", "queue_boundary", "external_api_client", "public_export", "plugin_registry", "deployment_unit", "auth_boundary"]
SURFACE_FILES = ["index.ts", "index.js", "main.ts", "main.js"]
ASIDE = ["/tests/", "/test/", "/docs/", "/examples/"]


def ordered(anchors: DataFrame) -> DataFrame:
    """anchors (kind, path, line, label, ...) with place: by order of kinds, path, line and label, unknown kinds last.

    A place counts the anchors of smaller kinds and then those before in its own kind, so no task orders all of them.
    """
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KIND_ORDER) for x in (k, i)]), F.col("kind")), F.lit(99))
    df = anchors.withColumn("kind_place", order)
    per = df.groupBy("kind_place").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.orderBy("kind_place")) - F.col("n")).drop("n")  # a row for each kind
    rank = F.row_number().over(Window.partitionBy("kind_place").orderBy("kind", "path", "line", "label"))
    return df.join(F.broadcast(before), "kind_place").withColumn("place", F.col("before") + rank).drop("before", "kind_place")


def exported_anchors(symbols: DataFrame) -> DataFrame:
    """kind, path, line, end_line, label, method, confidence of exported symbols (path, language, kind, qualified_name, start_line, end_line, exported).

    Symbols of script files, and of files that are a public surface; tests, docs and examples give none.
    """
    low = F.concat(F.lit("/"), F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), F.lit("/"))
    aside = F.lit(False)
    for part in ASIDE:
        aside = aside | low.contains(part)
    public = F.element_at(F.split("path", "/"), -1).isin(SURFACE_FILES) | F.col("language").isin("javascript", "typescript")
    df = symbols.filter(F.col("exported") & ~aside & public)
    return df.select(F.lit("public_export").alias("kind"), "path", F.col("start_line").alias("line"), "end_line", F.col("qualified_name").alias("label"), F.lit("parsed_exported_symbol").alias("method"), F.lit(0.82).alias("confidence"))
