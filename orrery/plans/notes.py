"""Anchors, outlines and notes over texts written from rows so that every rule is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import slug
from orrery.operators import anchors, documents, notes, sources
from orrery.plans import corpus
from orrery.plans.catalog import FILES, _rules_sql, query
from orrery.plans.surface import _outline_sql

table = corpus.table

#: Where a text stands, by its number: before and after it, language, role.
PLACES = [
    ("src/app", ".py", "python", "production"), ("web/routes", ".ts", "typescript", "production"), ("docs/page", ".md", "markdown", "docs"), ("tests/test_", ".py", "python", "test"),
    ("plugin/part", ".py", "python", "production"), ("cmd/go", ".go", "go", "production"), ("examples/use", ".py", "python", "example"),
]
#: Lines, of which a text takes three by its number: those that a rule is for, those that it is nearly for, and plain ones.
LINES = [
    "@app.get('/things/{id}')", "@bp.route(\"/x\") and @router.post('/y')", "routes['DELETE /old'] = gone", "app.post(`/js/${id}`, f)", "server.all('/any')", "if __name__ == '__main__':", "parser = argparse.ArgumentParser()", "@click.command()",
    "@shared_task", "w = new Worker('x')", "q = Queue()", "cron.schedule('* * * * *')", "schedule: daily", "on_webhook(event)", "CREATE TABLE t (x int)", "alter  table t", "topic.publish(x)", "the kafka topic", "r = requests.get(url)", "see https://example.org/a b",
    "fetch ('/api')", "register(plugin)", "register('x')", "a registry of things", "login(user)", "authenticate(user)", "check a JWT token", "plain words only", "# Top heading #", "## Second", "Under", "=====", "---", "class Thing(Base):", "    async def run(self):",
    "def plain():", "export const go = async (a) => a", "export class Wide {", "func (r *R) Serve(w W) {", "function old() {", "   ", "routes['FETCH /no']", "preregister(x)", "tokens and sessions",
]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PLACE = lambda i: f"list_extract({_sql_list([p[i] for p in PLACES])}, CAST(c_custkey % {len(PLACES)} + 1 AS BIGINT))"
_LINE = lambda by, add: f"list_extract({_sql_list(LINES)}, CAST((c_custkey * {by} + {add}) % {len(LINES)} + 1 AS BIGINT))"
WRITTEN = f"""WITH files AS (SELECT concat({_PLACE(0)}, c_custkey, {_PLACE(1)}) AS path, {_PLACE(2)} AS language, {_PLACE(3)} AS role, concat_ws(chr(10), {_LINE(1, 0)}, {_LINE(5, 3)}, {_LINE(11, 7)}) AS text FROM customer),
lines AS (SELECT path, role, unnest([1, 2, 3])::BIGINT AS line, unnest(string_split(text, chr(10))) AS text FROM files)"""


def _written(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files and their lines."""
    k = F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    place = lambda i: pick([p[i] for p in PLACES], k)
    text = F.array(pick(LINES, k), pick(LINES, k * 5 + 3), pick(LINES, k * 11 + 7))
    df = table(spark, d, "customer").select(F.concat(place(0), k, place(1)).alias("path"), place(2).alias("language"), place(3).alias("role"), text.alias("rows"))
    lines = df.select("path", "language", "role", F.posexplode("rows").alias("at", "text")).select("path", "language", "role", (F.col("at") + 1).cast("long").alias("line"), "text")
    return df.select("path", "language", "role", F.array_join("rows", "\n").alias("text")), lines


_KINDS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(anchors.KIND_ORDER)) + " ELSE 99 END"


@query(f"""{WRITTEN}, hits AS ({_rules_sql()}), ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, path, line, lower(label) ORDER BY confidence DESC, rule) AS r FROM hits)
SELECT kind, path, line, label, method, confidence, CASE WHEN confidence >= 0.7 THEN 'source_detected' ELSE 'candidate' END AS status, row_number() OVER (ORDER BY {_KINDS}, kind, path, line, label) AS place FROM ranked WHERE r = 1""")
def anchors_in_order(spark, d):
    """Every kind of anchor on a line, in the order in which a reader sees them."""
    return anchors.ordered(anchors.line_anchors(_written(spark, d)[1].drop("language")))


@query(_outline_sql().replace(FILES, WRITTEN))
def written_outline(spark, d):
    """Marked and underlined headings, and what begins a declaration, by language."""
    return sources.outline(_written(spark, d)[1])


@query("""SELECT 'public_export' AS kind, path, start_line AS line, end_line, qualified_name AS label, 'parsed_exported_symbol' AS method, 0.82::DOUBLE AS confidence FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN concat('src/c', c_custkey, '/index.ts') WHEN 1 THEN concat('src/c', c_custkey, '.js') WHEN 2 THEN concat('src/c', c_custkey, '.py') WHEN 3 THEN concat('Tests/c', c_custkey, '.ts') ELSE concat('a/main.js/c', c_custkey, '.go') END AS path,
  c_custkey % 5 IN (0, 1, 3) AS script, c_custkey AS start_line, c_custkey + 2 AS end_line, concat('q:', c_custkey) AS qualified_name, c_acctbal > 0 AS exported FROM customer) WHERE exported AND script AND NOT contains(concat('/', lower(path), '/'), '/tests/')""")
def exported_symbols(spark, d):
    k = F.col("c_custkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("src/c"), k, F.lit("/index.ts"))).when(k % 5 == 1, F.concat(F.lit("src/c"), k, F.lit(".js"))).when(k % 5 == 2, F.concat(F.lit("src/c"), k, F.lit(".py"))).when(k % 5 == 3, F.concat(F.lit("Tests/c"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("a/main.js/c"), k, F.lit(".go")))
    language = F.element_at(F.array(*map(F.lit, ["typescript", "javascript", "python", "typescript", "go"])), (k % 5 + 1).cast("int"))
    s = table(spark, d, "customer").select(path.alias("path"), language.alias("language"), F.lit("class").alias("kind"), F.concat(F.lit("q:"), k).alias("qualified_name"), k.alias("start_line"), (k + 2).alias("end_line"), (F.col("c_acctbal") > 0).alias("exported"))
    return anchors.exported_anchors(s)


#: Five shapes of notes by a part's number, and what is to be read from each.
NOTES = """n AS (SELECT p_partkey % 5 AS v, p_partkey AS k, p_name AS name FROM part),
notes AS (SELECT CASE v WHEN 0 THEN concat('docs/n', k, '.md') WHEN 1 THEN concat('n', k, '.txt') WHEN 2 THEN concat('p', k, '/README.md') WHEN 3 THEN concat('p', k, '/package.json') ELSE concat('n', k, '.txt') END AS path, CASE v WHEN 0 THEN 'docs_page' WHEN 2 THEN 'readme' WHEN 3 THEN 'manifest' ELSE 'text_note' END AS kind,
  CASE v WHEN 0 THEN concat('T', k) WHEN 2 THEN 'README' WHEN 3 THEN concat('pkg', k) ELSE concat('n', k, '.txt') END AS title, CASE v WHEN 0 THEN concat('T', k, '|S ', k) WHEN 1 THEN concat('Head ', k, '|Sub') WHEN 2 THEN concat('Only ', k) ELSE '' END AS headings,
  CASE v WHEN 0 THEN concat('one ', name, ' two') WHEN 1 THEN concat('Head ', k, ' ===== body ', name) WHEN 2 THEN concat('README contains sections: Only ', k, '.') WHEN 3 THEN concat('package.json describes package metadata and signals: ', name, ' a b d') ELSE concat('n', k, '.txt is available as guidance-only orientation material.') END AS summary FROM n)"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    rows = [
        (F.concat(F.lit("docs/n"), k, F.lit(".md")), "markdown", "docs_page", F.concat(F.lit("# T"), k, F.lit(" \n\n  one "), name, F.lit("\ntwo\n\n## S "), k, F.lit(" \nrest"))),
        (F.concat(F.lit("n"), k, F.lit(".txt")), "text", "text_note", F.concat(F.lit("Head "), k, F.lit("\n=====\nbody "), name, F.lit("\n\nSub\n---"))),
        (F.concat(F.lit("p"), k, F.lit("/README.md")), "markdown", "readme", F.concat(F.lit("## Only "), k, F.lit("\n"))),
        (F.concat(F.lit("p"), k, F.lit("/package.json")), "json", "manifest", F.concat(F.lit('{"name": "pkg'), k, F.lit('", "description": "'), name, F.lit('", "scripts": {"a": "x", "b": "y"}, "dependencies": {"d": "1"}}'))),
        (F.concat(F.lit("n"), k, F.lit(".txt")), "text", "text_note", F.lit("")),
    ]
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) if isinstance(r[i], str) else r[i] for r in rows]), (k % 5 + 1).cast("int"))
    return table(spark, d, "part").select(pick(0).alias("path"), pick(1).alias("language"), pick(2).alias("kind"), pick(3).alias("text"))


@query(f"WITH {NOTES} SELECT * FROM notes")
def note_texts(spark, d):
    out = notes.described(_notes(spark, d))
    return out.withColumn("headings", F.array_join("headings", "|"))


_PRIORITY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(anchors.NOTE_ORDER)) + " END"


@query(f"""WITH {NOTES}, r AS (SELECT *, row_number() OVER (ORDER BY {_PRIORITY}, path) AS place FROM notes)
SELECT CAST(place AS INTEGER) AS place, path, title AS label, concat(kind, ' guidance-only material, not proof.') AS reason, (SELECT count(*) FROM notes) AS notes, concat('corpus has ', least(5, (SELECT count(*) FROM notes)), ' high-priority orientation files available as guidance-only context.') AS summary FROM r WHERE place <= 5""")
def suggested_reading(spark, d):
    order = F.create_map(*[F.lit(x) for i, k in enumerate(anchors.NOTE_ORDER) for x in (k, i)])
    items = notes.described(_notes(spark, d)).withColumn("priority", F.element_at(order, F.col("kind")))
    return notes.reading(items, "corpus")


@query("""SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(concat('--', p_name, ' & ', p_brand, '! ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN regexp_matches(lower(x), 'external|transport|provider|api client') THEN 'external_boundary' WHEN regexp_matches(lower(x), 'auth|config|observability|logging') THEN 'cross_cutting' ELSE 'component' END AS kind
FROM (SELECT *, concat(p_name, ' ', list_extract(['Auth', 'API Client', 'core', 'External', 'Logging', 'transport of config'], CAST(p_partkey % 6 + 1 AS BIGINT))) AS x FROM part)""")
def node_names(spark, d):
    """How nodes are named in addresses, and what kind their labels make them."""
    k = F.col("p_partkey")
    label = F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, ["Auth", "API Client", "core", "External", "Logging", "transport of config"])), (k % 6 + 1).cast("int")))
    p = table(spark, d, "part")
    return p.select(k.alias("id"), slug(F.concat(F.lit("--"), "p_name", F.lit(" & "), "p_brand", F.lit("! "))).alias("slug"), documents.node_kind(label).alias("kind"))
