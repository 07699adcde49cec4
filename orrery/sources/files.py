"""Files as a table: scan, inspection, classification, manifests and package boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import line_count

#: Directories and files that a scan leaves out.
IGNORED_DIRS = [
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", ".venv", "venv", "env", ".env",
    "dist", "build", ".next", ".nuxt", "coverage", ".coverage", ".idea", ".vscode", "vendor", "target", "bin", "obj",
]
IGNORED_FILES = [".env", ".env.local", ".env.development", ".env.production", ".env.test"]
#: Language of each file name ending.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".svelte": "svelte", ".vue": "vue",
    ".go": "go", ".java": "java", ".rs": "rust", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".c": "c", ".h": "c_header", ".hpp": "cpp_header", ".kt": "kotlin", ".swift": "swift", ".sql": "sql",
    ".md": "markdown", ".mdx": "markdown", ".rst": "rst", ".txt": "text", ".json": "json", ".toml": "toml", ".yaml": "yaml",
    ".yml": "yaml", ".xml": "xml", ".ini": "ini", ".cfg": "ini", ".gradle": "gradle", ".lock": "lockfile",
}
#: Manifest kind of each file name.
MANIFESTS = {
    "package.json": "node_package", "pnpm-workspace.yaml": "pnpm_workspace", "yarn.lock": "yarn_lock", "package-lock.json": "npm_lock",
    "pyproject.toml": "python_project", "requirements.txt": "python_requirements", "poetry.lock": "poetry_lock", "go.mod": "go_module",
    "Cargo.toml": "rust_package", "pom.xml": "maven_project", "build.gradle": "gradle_project", "settings.gradle": "gradle_settings",
    "docker-compose.yml": "docker_compose", "docker-compose.yaml": "docker_compose",
}
#: Kinds of manifest that mark the directory they stand in as a package.
PACKAGES = ["node_package", "python_project", "go_module", "rust_package", "maven_project", "gradle_project"]
#: Directories and marks in names of each role, in the order in which roles are tried.
TEST_DIRS, TEST_MARKS = ["tests", "test", "__tests__", "__mocks__", "spec"], [".spec.", ".test.", "_test.", "test_", "_spec."]
EXAMPLE_DIRS = ["examples", "example", "samples", "sample", "demo", "demos"]
DOCS_DIRS, DOCS_ENDS = ["docs", "doc"], [".md", ".mdx", ".rst"]
TOOLING_DIRS = ["scripts", "tools", ".github", ".gitlab", "ci", "bench", "benchmark", "benchmarks"]
INFRASTRUCTURE_DIRS = ["deploy", "deployment", "k8s", "kubernetes", "helm", "terraform"]
CONFIG_DIRS = ["config", "configs"]
GENERATED_MARKS = [".generated.", ".gen.", ".min."]
MAX_BYTES, MAX_LINES, SNIFFED = 1 << 20, 50_000, 8192


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    name = name_of(path)
    by_end = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    end = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "dockerfile").when(name == "Makefile", "makefile").otherwise(F.coalesce(F.try_element_at(by_end, end), F.lit("unknown")))


def role(path: Column) -> Column:
    """The first rule that fits. `test_` counts anywhere in a name, so `latest_news.py` is a test."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    one_of = lambda names: "|".join(n.replace(".", r"\.") for n in names)
    under = lambda names: low.rlike(rf"(^|/)({one_of(names)})(/|$)")
    named = lambda marks: low.rlike(rf"({one_of(marks)})[^/]*/*$")
    known = one_of(m for m in MANIFESTS if m == m.lower())
    return (
        F.when(under(TEST_DIRS) | named(TEST_MARKS), "test")
        .when(under(EXAMPLE_DIRS), "example")
        .when(under(DOCS_DIRS) | low.rlike(rf"({one_of(DOCS_ENDS)})$"), "docs")
        .when(under(TOOLING_DIRS), "tooling")
        .when(under(INFRASTRUCTURE_DIRS), "infrastructure")
        .when(low.rlike(rf"(^|/)({known})$") | under(CONFIG_DIRS), "config")
        .when(named(GENERATED_MARKS), "generated")
        .otherwise("production")
    )


def manifest(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    return F.try_element_at(kinds, name_of(path))


def inspected(files: DataFrame) -> DataFrame:
    """path, language, role, status, readable, size_bytes, line_count, content_hash, text from (path, content).

    Too large is found before binary; a binary sample has a zero byte or more than 30 % control bytes. Text is null
    where a file is not readable.
    """
    sample = F.substring(F.hex(F.substring("content", 1, SNIFFED)), 1, 2 * SNIFFED)
    control = F.regexp_count(F.regexp_replace(sample, "(..)", "$1 "), F.lit("(0[0-8]|0E|0F|1[0-9A-F]) "))
    zero = F.regexp_replace(sample, "(..)", "$1 ").contains("00 ")
    size = F.length("content").cast("long")
    df = files.withColumn("size_bytes", size).withColumn("binary", zero | (control > 0.3 * F.least(size, F.lit(SNIFFED))))
    df = df.withColumn("text", F.when((F.col("size_bytes") <= MAX_BYTES) & ~F.col("binary"), F.make_valid_utf8(F.col("content").cast("string"))))
    n = F.coalesce(line_count(F.col("text")), F.lit(0))
    status = F.when(F.col("size_bytes") > MAX_BYTES, "too_large").when(F.col("binary"), "binary").when(n > MAX_LINES, "too_many_lines").otherwise("readable")
    df = df.withColumn("line_count", n.cast("int")).withColumn("status", status).withColumn("readable", F.col("status") == "readable")
    df = df.withColumn("content_hash", F.sha2("content", 256)).withColumn("text", F.when(F.col("readable"), F.col("text")))
    return df.select("path", language(F.col("path")).alias("language"), role(F.col("path")).alias("role"), "status", "readable", "size_bytes", "line_count", "content_hash", "text")


def listed(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """Files below root as (URI, bytes); ignored directories are not entered, ignored files and links are left out.

    The driver lists directories by the file system's own client, so root may be in any store that Spark reads.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo, out = [top], []
    while todo:
        for entry in store.listStatus(todo.pop()):
            name = entry.getPath().getName()
            if entry.isDirectory():
                if name not in IGNORED_DIRS:
                    todo.append(entry.getPath())
            elif entry.isFile() and not entry.isSymlink() and name not in IGNORED_FILES:
                out.append((entry.getPath().toString(), entry.getLen()))
    return sorted(out)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files below root that are not ignored, inspected; paths are relative to root. Empty files count too."""
    found = listed(spark, root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    full = [p for p, n in found if n]
    df = spark.createDataFrame([(p, bytearray()) for p, n in found if not n], "path string, content binary")
    if full:
        df = df.unionByName(spark.read.format("binaryFile").load(full).select("path", "content"))
    return inspected(df.select(F.regexp_replace(F.col("path"), f"^.*?\\Q{base}\\E/", "").alias("path"), "content"))


def manifests(files: DataFrame) -> DataFrame:
    """path, kind, package_name; a name that cannot be read is empty."""
    df = files.withColumn("kind", manifest(F.col("path"))).filter("kind is not null")
    text = F.coalesce("text", F.lit(""))
    toml = F.regexp_extract(text, r"(?s)\[(?:project|package|tool\.poetry)\][^\[]*?\bname\s*=\s*[\"']([^\"']+)", 1)
    name = F.when(F.col("kind") == "node_package", F.get_json_object(text, "$.name")).when(F.col("kind").isin("python_project", "rust_package"), toml).when(F.col("kind") == "go_module", F.regexp_extract(text, r"(?m)^module\s+(\S+)", 1))
    return df.select("path", "kind", F.coalesce(name, F.lit("")).alias("package_name"))


def boundaries(manifest_rows: DataFrame) -> DataFrame:
    """path (the directory, or .), kind, manifest_path, package_name of each package."""
    up = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return manifest_rows.filter(F.col("kind").isin(PACKAGES)).select(F.when(up == "", ".").otherwise(up).alias("path"), "kind", F.col("path").alias("manifest_path"), "package_name")
