"""More queries over the test tables: source reads, outlines, documents, joins of components, and the store of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import documents, graph, sources, store
from orrery.plans import corpus
from orrery.plans.catalog import CLUSTERS, FILES, GRAPH, TREE_ROWS, _clustered, _edges, _tree, query

table = corpus.table

# sources

ASKED = """docs AS (SELECT doc_id, concat_ws('/', source, lang, concat('doc_', doc_id, list_extract(['.py','.ts','.md','.txt','.go','_test.py'], CAST(doc_id % 6 + 1 AS BIGINT)))) AS path FROM documents WHERE doc_id IS NOT NULL),
asked AS (SELECT doc_id AS request, path, doc_id % 5 AS a, doc_id % 11 AS b FROM docs), len AS (SELECT path, max(line) AS last FROM lines GROUP BY path),
judged AS (SELECT request, asked.path, a, b, last, CASE WHEN last IS NULL THEN 'no such file' WHEN a < 1 THEN 'start_line must be >= 1' WHEN b < a THEN 'end_line must be >= start_line' WHEN a > last THEN 'start_line is beyond end of file' END AS error FROM asked LEFT JOIN len ON len.path = asked.path)"""


@query(f"""{FILES}, {ASKED} SELECT request, j.path, a AS start_line, CASE WHEN error IS NULL THEN least(b, last) ELSE b END AS end_line,
CASE WHEN error IS NULL THEN (SELECT string_agg(text, chr(10) ORDER BY line) FROM lines l WHERE l.path = j.path AND l.line BETWEEN a AND least(b, last)) END AS text, error FROM judged j""")
def source_ranges(spark, d):
    docs = table(spark, d, "documents").filter("doc_id is not null")
    path = corpus.path_of(F.col("doc_id"), F.col("source"), F.col("lang"))
    asked = docs.select(F.col("doc_id").alias("request"), path.alias("path"), (F.col("doc_id") % 5).alias("start_line"), (F.col("doc_id") % 11).alias("end_line"))
    return sources.read_ranges(corpus.lines(spark, d), asked)


@query(f"{FILES} SELECT path, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS token_count, floor((length(text) + 3) / 4) <= 30000 AS readable FROM files")
def whole_files(spark, d):
    return sources.whole_files(corpus.files(spark, d))


@query("""SELECT p_partkey AS id, CASE CAST(p_partkey % 8 AS INTEGER) WHEN 0 THEN concat('a/b', p_partkey) WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN concat('b/c', p_partkey) WHEN 4 THEN NULL WHEN 5 THEN concat('a/b', p_partkey) WHEN 6 THEN concat('a/b', p_partkey) ELSE NULL END AS path FROM part""")
def safe_paths(spark, d):
    raw = ["a/./b{}", "../x{}", "/abs/y{}", "a/../b/c{}", "a/../../z{}", "a\\b{}", "a//b{}/", ".."]
    forms = F.array(*[F.concat(F.lit(r.split("{}")[0]), F.col("p_partkey").cast("string"), F.lit(r.split("{}")[1])) if "{}" in r else F.lit(r) for r in raw])
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(forms, (F.col("p_partkey") % 8 + 1).cast("int")).alias("path"))
    return p.select("id", sources.normalized_path(F.col("path")).alias("path"))


@query(f"""{FILES}, len AS (SELECT path, max(line) AS last FROM lines GROUP BY path), r AS (SELECT path, last, line AS a, least(last, line + 3) AS b FROM lines JOIN len USING (path))
SELECT 'up' AS mode, path, greatest(1, a - 5) AS start_line, b AS end_line FROM r UNION ALL SELECT 'down', path, a, least(last, b + 5) FROM r UNION ALL SELECT 'both', path, greatest(1, a - 5), least(last, b + 5) FROM r UNION ALL SELECT 'whole_file', path, 1, greatest(1, last) FROM r""")
def region_modes(spark, d):
    lines = corpus.lines(spark, d)
    last = lines.groupBy("path").agg(F.max("line").alias("last"))
    r = lines.join(last, "path").select(F.col("line").alias("region"), "path", F.col("line").alias("start_line"), F.least("last", F.col("line") + 3).alias("end_line"))
    modes = [sources.expanded(r, last, m, 5).withColumn("mode", F.lit(m)) for m in ("up", "down", "both", "whole_file")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2]).unionByName(modes[3]).drop("region")


def _outline_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    first = lambda ps: "CASE " + " ".join(f"WHEN regexp_matches(text, '{quoted(p)}') THEN coalesce(nullif(regexp_extract(text, '{quoted(p)}', 1), ''), trim(text))" for p in ps) + " END"
    declared = "CASE " + " ".join(f"WHEN language = '{k}' THEN {first(ps)}" for k, ps in sources.STARTS.items()) + f" ELSE {first(sources._SCRIPT)} END"
    return f"""{FILES}, x AS (SELECT l.*, f.language, lead(l.text) OVER (PARTITION BY l.path ORDER BY line) AS nxt FROM lines l JOIN files f ON f.path = l.path),
y AS (SELECT path, line, CASE WHEN language IN ('markdown', 'rst', 'text') OR role = 'docs' THEN CASE WHEN regexp_extract(text, '{quoted(sources.HEADING)}', 1) <> '' THEN trim(regexp_extract(text, '{quoted(sources.HEADING)}', 1)) WHEN regexp_matches(nxt, '{quoted(sources.UNDERLINE)}') AND trim(text) <> '' THEN trim(text) END END AS heading, {declared} AS declared FROM x),
g AS (SELECT path, max(line) AS last, count(heading) AS h, count(declared) AS c FROM y GROUP BY path), s AS (SELECT y.path, line, last, h, CASE WHEN h > 0 THEN heading ELSE declared END AS label FROM y JOIN g USING (path))
SELECT path, line AS start_line, greatest(line, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, last)) AS end_line, label, CASE WHEN h > 0 THEN 'section' ELSE 'symbol' END AS kind, CASE WHEN h > 0 THEN 0.75 ELSE 0.55 END::DOUBLE AS confidence FROM s WHERE label IS NOT NULL
UNION ALL SELECT path, 1, last, path, 'file', 0.35 FROM g WHERE h = 0 AND c = 0"""


@query(_outline_sql())
def document_outline(spark, d):
    f = corpus.files(spark, d)
    return sources.outline(corpus.lines(spark, d).join(f.select("path", "language"), "path"))


@query(f"{FILES} SELECT path FROM files WHERE role = 'production' AND language = 'python'")
def files_by_role(spark, d):
    return corpus.files(spark, d).filter("role = 'production' and language = 'python'").select("path")


@query(f"{FILES}, r AS (SELECT path, 1 AS start_line, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS end_line, sha256(text) AS content_hash, 'whole_file' AS region_type FROM files) SELECT path, concat('region:', substring(sha1(concat_ws('|', 'run', path, start_line, end_line, content_hash, region_type)), 1, 24)) AS region_id FROM r")
def file_regions(spark, d):
    from orrery.functions.text import line_count

    f = corpus.files(spark, d)
    r = f.select("path", F.lit(1).alias("start_line"), line_count(F.col("text")).alias("end_line"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.lit("whole_file").alias("region_type"))
    return sources.region_ids(r).select("path", "region_id")


# components and documents

@query(f"""{GRAPH}, e AS (SELECT DISTINCT sg AS a, tg AS b, kind FROM edges WHERE status = 'resolved' AND sg <> tg) SELECT a AS component, b AS related, kind, concat('The ', b) AS name FROM e UNION ALL SELECT b, a, concat(kind, '_by'), concat('The ', a) FROM e""")
def component_links(spark, d):
    e = _edges(spark, d).filter("source_group <> target_group").select(F.col("source_group").alias("a"), F.col("target_group").alias("b"), F.col("kind").alias("label")).distinct()
    n = table(spark, d, "nation").select(F.col("n_name").alias("id"), F.concat(F.lit("The "), F.col("n_name")).alias("name"))
    return documents.links(e, n)


_WORDS = ["Public", "lifecycle", "Adapter", "cookie", "Response", "timeout", "URL", "multipart", "command", "backend", "screen", "infra"]
_PARTS = ["_api", "session", "transport", "auth", "model", "limit", "url", "decoder", "cli", "router", ".tsx", "docker"]


def _keyword_sql() -> str:
    rule = lambda text, side: " , ".join(f"CASE WHEN {' OR '.join(f"contains(lower({text}), '{w}')" for w in r[side])} THEN {i} END" for i, r in enumerate(documents.KEYWORDS))
    array = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return f"""WITH c AS (SELECT n_name AS component, concat(list_extract({array(_WORDS)}, CAST(n_nationkey % 12 + 1 AS BIGINT)), ' part') AS text, concat('lib/', n_nationkey) AS own FROM nation),
r AS (SELECT p_partkey AS region, CASE WHEN p_partkey % 13 = 12 THEN concat('LIB/', p_partkey % 25) WHEN p_partkey % 13 = 11 THEN concat('zz/_', list_extract({array(_WORDS)}, CAST(p_partkey % 12 + 1 AS BIGINT)), '-.x.py') WHEN p_partkey % 13 = 10 THEN concat('zz/_', list_extract({array(_WORDS)}, CAST(p_partkey % 12 + 1 AS BIGINT)), '-.py') ELSE concat(list_extract({array(_PARTS)}, CAST(p_partkey % 13 + 1 AS BIGINT)), '/x', p_partkey) END AS path FROM part),
cr AS (SELECT *, list_filter([{rule('text', 0)}], lambda x: x IS NOT NULL) AS rules FROM c), rr AS (SELECT *, list_filter([{rule('path', 1)}], lambda x: x IS NOT NULL) AS rules FROM r),
sr AS (SELECT *, trim(regexp_replace(list_extract(string_split(lower(path), '/'), -1), '\\.[^.]*$', ''), '_-') AS stem FROM rr)
SELECT component, region FROM cr JOIN sr ON len(list_intersect(cr.rules, sr.rules)) > 0 OR lower(sr.path) = cr.own OR (stem <> '' AND contains(lower(cr.text), stem))"""


@query(_keyword_sql())
def regions_by_keyword(spark, d):
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    k = F.col("n_nationkey")
    c = table(spark, d, "nation").select(F.col("n_name").alias("component"), F.concat(pick(_WORDS, k % 12), F.lit(" part")).alias("text"), F.array(F.concat(F.lit("lib/"), k)).alias("paths"))
    p = F.col("p_partkey")
    word = pick(_WORDS, p % 12)
    path = F.when(p % 13 == 12, F.concat(F.lit("LIB/"), p % 25)).when(p % 13 == 11, F.concat(F.lit("zz/_"), word, F.lit("-.x.py"))).when(p % 13 == 10, F.concat(F.lit("zz/_"), word, F.lit("-.py"))).otherwise(F.concat(F.try_element_at(F.array(*map(F.lit, _PARTS)), (p % 13 + 1).cast("int")), F.lit("/x"), p))
    return documents.regions_by_keyword(c, table(spark, d, "part").select(p.alias("region"), path.alias("path")))


@query("""WITH w AS (SELECT item_id, text, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark), t AS (SELECT item_id AS source, concat(text, ' $', w[2], '!naïve_', w[1]) AS text FROM w),
n AS (SELECT item_id AS symbol, CASE item_id % 3 WHEN 0 THEN w[1] WHEN 1 THEN concat('$', w[2]) ELSE concat('NAÏVE_', w[1]) END AS name FROM w),
h AS (SELECT source, symbol, name FROM t JOIN n ON length(name) >= 3 AND contains(lower(text), lower(name)) AND symbol <> source),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY symbol) AS INTEGER) AS rank FROM h) SELECT * FROM r WHERE rank <= 40""")
def symbol_mentions(spark, d):
    """Names of word characters, with a sign in front, and with letters beyond ASCII."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    b = table(spark, d, "benchmark").select("item_id", "text", F.try_element_at(w, F.lit(1)).alias("w1"), F.try_element_at(w, F.lit(2)).alias("w2"))
    none = lambda c: F.coalesce(c, F.lit(""))
    name = F.when(F.col("item_id") % 3 == 0, F.col("w1")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("$"), none("w2"))).otherwise(F.concat(F.lit("NAÏVE_"), none("w1")))
    texts = b.select(F.col("item_id").alias("source"), F.concat("text", F.lit(" $"), none("w2"), F.lit("!naïve_"), none("w1")).alias("text"))
    return documents.mentions(texts, b.select(F.col("item_id").alias("symbol"), name.alias("name"), F.col("item_id").alias("place")))


@query("""WITH c AS (SELECT p_type AS component, split_part(p_type, ' ', 1) AS label, concat(p_type, ' part of lib/', p_type, '/', min(p_brand), '.py') AS text FROM part GROUP BY p_type),
k AS (SELECT p_partkey AS claim, concat(p_name, ' ', p_type) AS text, CASE WHEN p_partkey % 3 = 0 THEN concat(upper(p_type), '/', p_brand) WHEN p_partkey % 3 = 1 THEN '' END AS path FROM part)
SELECT DISTINCT component, claim FROM k JOIN c ON contains(lower(k.text), lower(label)) OR (path <> '' AND contains(lower(c.text), lower(path)))""")
def claims_by_label(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    c = p.groupBy(F.col("p_type").alias("component")).agg(F.min("p_brand").alias("brand"))
    c = c.select("component", F.element_at(F.split("component", " "), 1).alias("label"), F.concat("component", F.lit(" part of lib/"), "component", F.lit("/"), "brand", F.lit(".py")).alias("text"))
    path = F.when(k % 3 == 0, F.concat(F.upper("p_type"), F.lit("/"), "p_brand")).when(k % 3 == 1, "")
    return documents.claims_of_components(p.select(k.alias("claim"), F.concat_ws(" ", "p_name", "p_type").alias("text")), p.select(k.alias("claim"), path.alias("path")), c)


@query("""WITH r AS (SELECT l_suppkey AS component, l_partkey AS region, CASE l_returnflag WHEN 'N' THEN 'component_source_region' WHEN 'A' THEN 'grounded_claim' ELSE 'semantic_anchor:route' END AS origin, l_orderkey * 10 + l_linenumber AS place,
  CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS o, CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN CASE l_linestatus WHEN 'O' THEN 0.95 ELSE 0.55 END ELSE l_discount END::DOUBLE AS score FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY component, region ORDER BY o, place, origin, score) AS k FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY o, place, region) AS i FROM f WHERE k = 1) SELECT component, region, origin, score FROM s WHERE i <= 40""")
def component_evidence(spark, d):
    origin = F.when(F.col("l_returnflag") == "N", "component_source_region").when(F.col("l_returnflag") == "A", "grounded_claim").otherwise("semantic_anchor:route")
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("component"), F.col("l_partkey").alias("region"), origin.alias("origin"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.col("l_discount").alias("confidence"), (F.col("l_linestatus") == "O").alias("verified"))
    return documents.component_evidence(rows)


NODES = """WITH e AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey),
nodes AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'insufficient' WHEN o_orderstatus = 'F' THEN 'candidate' WHEN o_orderpriority LIKE '5%' THEN 'unsupported' WHEN n > 0 THEN 'verified' ELSE 'insufficient' END AS status, coalesce(n, 0) AS evidence FROM orders LEFT JOIN e ON l_orderkey = o_orderkey)"""


def _nodes(spark, d):
    e = table(spark, d, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("evidence"))
    o = table(spark, d, "orders").join(e, "o_orderkey", "left").na.fill(0, ["evidence"])
    p = F.col("o_orderpriority")
    support = F.when(F.col("o_orderstatus") == "F", "orientation_only").when(p.startswith("5"), "unsupported").otherwise("verified")
    status = documents.node_status(support, F.col("evidence"), F.when(p.startswith("1"), "degraded_no_llm").otherwise("ready"))
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), "evidence")


@query(f"{NODES} SELECT * FROM nodes")
def node_statuses(spark, d):
    return _nodes(spark, d)


@query(f"{NODES} SELECT count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'insufficient') AS insufficient, count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (evidence = 0) AS without_evidence FROM nodes")
def map_diagnostics(spark, d):
    return documents.diagnostics(_nodes(spark, d))


@query("""WITH s AS (SELECT c_nationkey, concat('c', c_custkey) AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
g AS (SELECT c_nationkey, n, string_agg(name, ', ' ORDER BY r) FILTER (r <= 8) AS names FROM s GROUP BY ALL)
SELECT n_name AS path, CASE WHEN n IS NULL THEN concat(n_name, ' is a python module with no parsed declarations.') ELSE concat(n_name, ' defines ', names, CASE WHEN n > 8 THEN concat(', and ', n - 8, ' more') ELSE '' END, '.') END AS summary FROM nation LEFT JOIN g ON c_nationkey = n_nationkey""")
def module_summaries(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("path"), F.concat(F.lit("c"), F.col("c_custkey")).alias("name"), F.col("c_custkey").alias("place"))
    return documents.module_summary(n.select(F.col("n_name").alias("path"), F.lit("python").alias("language")), c)


@query("""WITH x AS (SELECT event_type AS kind, concat('u', user_id) AS path, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
f AS (SELECT kind, n, path, min(r) AS r FROM x WHERE r <= 12 GROUP BY ALL) SELECT kind, concat(upper(left(replace(kind, '_', ' '), 1)), substring(replace(kind, '_', ' '), 2)) AS label, n AS anchors, string_agg(path, ',' ORDER BY r) AS paths FROM f GROUP BY kind, n""")
def anchor_components(spark, d):
    return documents.anchor_components(table(spark, d, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("u"), F.col("user_id")).alias("path"), F.col("event_id").alias("place")))


@query(f"{FILES} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS id, 'package' AS kind, count(DISTINCT path) AS files, count(*) AS symbols FROM lines GROUP BY 1")
def package_fallback(spark, d):
    return documents.packages(corpus.lines(spark, d).select("path"))


@query("""SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'orphaned' WHEN CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE md5(c_name) END = md5(c_name) THEN 'fresh' ELSE 'stale' END AS state FROM orders LEFT JOIN customer ON c_custkey = o_custkey * (1 + o_orderkey % 2)""")
def stale_documents(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.md5("c_name").alias("hash"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * (1 + F.col("o_orderkey") % 2)).alias("source"))
    # what a document was written from, as kept at that time
    then = o.join(c, "source", "left").select("id", "source", F.when(F.col("id") % 3 == 0, "old").otherwise(F.col("hash")).alias("source_hash"))
    return documents.stale(then, c)


@query("""SELECT p_partkey AS id, len(list_filter(string_split_regex(l, '\\s+'), lambda x: x <> '')) BETWEEN 2 AND 8 AND trim(p_type) <> '' AND length(repeat(p_type, p_size)) <= 1200 AS valid FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS l FROM part)""")
def label_checks(spark, d):
    label = F.when(F.col("p_partkey") % 4 == 0, F.element_at(F.split("p_name", " "), 1)).otherwise(F.col("p_name"))
    p = table(spark, d, "part").select("p_partkey", label.alias("label"), F.repeat("p_type", F.col("p_size")).alias("description"))
    return p.select(F.col("p_partkey").alias("id"), documents.valid_label(F.col("label"), F.col("description")).alias("valid"))


@query(f"{TREE_ROWS} SELECT * FROM tree WHERE parent IS NULL")
def top_level_groups(spark, d):
    return graph.children(_tree(spark, d), None)


@query("SELECT p_partkey AS id, p_name AS name, p_type AS kind FROM part WHERE p_partkey = 42")
def node_by_id(spark, d):
    return table(spark, d, "part").filter("p_partkey = 42").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))


@query(f"""{CLUSTERS} SELECT (SELECT count(*) FROM mods) AS modules, (SELECT count(DISTINCT leaf) FROM mods) AS regions, (SELECT count(DISTINCT container) FROM mods) AS sections, (SELECT count(*) FROM (SELECT DISTINCT group_id, cluster FROM inside)) AS clusters, (SELECT count(*) FROM over) AS ungrouped, (SELECT count(*) FROM edges WHERE status = 'resolved') AS relations""")
def graph_overview(spark, d):
    """One row for the whole graph."""
    m = corpus.modules(spark, d)
    e = _edges(spark, d)
    inside, over = _clustered(spark, d, e)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    parts = {"modules": m, "regions": m.select("leaf").distinct(), "sections": m.select("container").distinct(), "clusters": inside.select("group_id", "cluster").distinct(), "ungrouped": over, "relations": e}
    rows = None
    for name, df in parts.items():
        rows = one(df, name) if rows is None else rows.unionByName(one(df, name))
    return rows.agg(*[F.max(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in parts])


@query(f"""{GRAPH}, e AS (SELECT sc, tc, kind FROM edges WHERE status = 'resolved' AND sc > tc) SELECT kind, CASE WHEN count(*) > 100 THEN 'error' ELSE 'warning' END AS severity, sc AS source_layer, tc AS target_layer, count(*) AS violations FROM e GROUP BY kind, sc, tc""")
def layer_violations(spark, d):
    """Relations against the order of layers: containers in order of name may only use later ones."""
    e = _edges(spark, d, "container").filter("source_group > target_group")
    g = e.groupBy("kind", F.col("source_group").alias("source_layer"), F.col("target_group").alias("target_layer")).agg(F.count(F.lit(1)).alias("violations"))
    return g.withColumn("severity", F.when(F.col("violations") > 100, "error").otherwise("warning"))


# the store of runs

@query("""WITH j AS (SELECT DISTINCT concat('/r/', c_custkey) AS p FROM customer WHERE c_mktsegment = 'BUILDING'), r AS (SELECT o_orderkey AS request, concat('/r/', o_custkey) AS p, o_orderdate AS moment FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY moment, request) AS k FROM r) SELECT request, k = 1 AND p NOT IN (SELECT p FROM j) AS granted FROM f""")
def job_claims(spark, d):
    slash = F.when(F.col("o_orderkey") % 2 == 0, "/").otherwise("")
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.concat(F.lit("/r\\"), F.col("o_custkey"), slash).alias("path"), F.col("o_orderdate").alias("at"))
    j = table(spark, d, "customer").select(F.concat(F.lit("/r/"), F.col("c_custkey")).alias("path"), F.when(F.col("c_mktsegment") == "BUILDING", "running").otherwise("completed").alias("status"))
    return store.claimed(r, j)


@query("""WITH r AS (SELECT event_id AS request, CASE WHEN event_id % 3 = 0 THEN user_id * 2 WHEN event_id % 3 = 1 THEN user_id END AS run_id FROM events), c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'failed' ELSE 'completed' END AS status FROM customer)
SELECT request, CAST(run_id AS VARCHAR) AS run_id, CAST(CASE WHEN run_id IS NULL THEN 503 WHEN status IS NULL THEN 404 WHEN status = 'completed' THEN 200 ELSE 409 END AS INTEGER) AS code FROM r LEFT JOIN c ON c_custkey = run_id""")
def run_resolution(spark, d):
    e, text = F.col("event_id"), lambda c: c.cast("string")
    r = table(spark, d, "events").select(e.alias("request"), text(F.when(e % 3 == 0, F.col("user_id") * 2)).alias("asked"), text(F.when(e % 3 < 2, F.col("user_id"))).alias("header"))
    runs = table(spark, d, "customer").select(text(F.col("c_custkey")).alias("run_id"), F.when(F.col("c_mktsegment") == "BUILDING", "failed").otherwise("completed").alias("status"))
    return store.resolved_runs(r, runs)


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'O' THEN 'Analysis was interrupted by a backend restart.' END AS error FROM orders")
def interrupted_runs(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    return store.repaired(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit(None).cast("string").alias("error")))


@query("""WITH kept AS (SELECT o_custkey AS run_id, o_orderkey AS id, 'old' AS state FROM orders), new AS (SELECT DISTINCT c_custkey AS run_id, c_nationkey AS id, 'new' AS state FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT * FROM kept WHERE run_id NOT IN (SELECT run_id FROM new) UNION ALL SELECT * FROM new""")
def replaced_runs(spark, d):
    kept = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("id"), F.lit("old").alias("state"))
    new = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").cast("long").alias("id"), F.lit("new").alias("state"))
    return store.replaced(kept, new)
