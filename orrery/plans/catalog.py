"""Queries over the test tables, each with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import text as t
from orrery.lineage import durable, light
from orrery.operators import anchors, evidence, graph, runs, search
from orrery.plans import corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Shared by the SQL twins: the adapters of corpus.py.
MODULES = "mods AS (SELECT s_suppkey AS module, n_name AS leaf, r_name AS container, concat(r_name, '/', n_name, '/', s_name) AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SYMBOLS = "syms AS (SELECT DISTINCT concat('s:', l_orderkey, ':', l_suppkey) AS id, l_suppkey AS module FROM lineitem)"
RELATIONS = """raw AS (SELECT concat('s:', a.l_orderkey, ':', a.l_suppkey) AS source, concat('s:', a.l_orderkey, ':', b.l_suppkey) AS tgt,
    CASE a.l_linestatus WHEN 'O' THEN 'calls' ELSE 'inherits' END AS kind,
    CASE a.l_returnflag WHEN 'N' THEN 'resolved' WHEN 'A' THEN 'partial' ELSE 'unresolved' END AS status, CAST(a.l_linenumber AS BIGINT) AS line
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
rels AS (SELECT concat('relation:', substring(sha1(concat_ws('|', 'run', kind, source, tgt, line)), 1, 24)) AS id, source, tgt AS anytarget,
    CASE WHEN min(status) <> 'unresolved' THEN tgt END AS target, kind, min(status) AS status, line FROM raw GROUP BY source, tgt, kind, line)"""
EDGES = """edges AS (SELECT r.*, a.module AS sm, b.module AS tm, ma.leaf AS sg, mb.leaf AS tg, ma.container AS sc, mb.container AS tc FROM rels r
  JOIN syms a ON r.source = a.id JOIN syms b ON r.target = b.id JOIN mods ma ON a.module = ma.module JOIN mods mb ON b.module = mb.module)"""
GRAPH = f"WITH {MODULES}, {SYMBOLS}, {RELATIONS}, {EDGES}"
FILES = """WITH f0 AS (SELECT concat_ws('/', source, lang, concat('doc_', doc_id, list_extract(['.py','.ts','.md','.txt','.go','_test.py'], CAST(doc_id % 6 + 1 AS BIGINT)))) AS path, coalesce(text, '') AS text, doc_id % 6 AS k FROM documents WHERE doc_id IS NOT NULL),
files AS (SELECT path, list_extract(['python','typescript','markdown','text','go','python'], CAST(k + 1 AS BIGINT)) AS language,
  CASE WHEN k = 5 THEN 'test' WHEN k = 2 THEN 'docs' ELSE 'production' END AS role, text FROM f0),
pieces AS (SELECT path, role, unnest(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS text,
  unnest(range(1, 1 + len(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))))) AS line FROM files WHERE text <> ''),
lines AS (SELECT path, role, CAST(line AS BIGINT) AS line, text FROM pieces)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, d: str, group: str = "leaf") -> DataFrame:
    return durable(graph.lifted(graph.resolved(corpus.relations(spark, d)), corpus.symbols(spark, d), corpus.modules(spark, d), group))


# graph

@query(f"""{GRAPH}, e AS (SELECT * FROM edges WHERE status = 'resolved' AND sg <> tg)
SELECT sg AS source_group, tg AS target_group, kind, count(*) AS relation_count, count(DISTINCT concat(source, '|', target)) AS pair_count,
  count(DISTINCT source) AS source_count, count(DISTINCT target) AS target_count, array_to_string(list_sort(list(id))[1:20], ',') AS first_ids
FROM e GROUP BY sg, tg, kind""")
def aggregate_edges(spark, d):
    return graph.aggregate_edges(_edges(spark, d))


@query(f"{GRAPH} SELECT sg AS group_id, kind, count(*) AS relation_count FROM edges WHERE status = 'resolved' AND sg = tg GROUP BY sg, kind")
def internal_relation_counts(spark, d):
    return graph.internal_counts(_edges(spark, d))


@query(f"WITH {RELATIONS} SELECT kind, status, count(*) AS n FROM rels GROUP BY kind, status")
def relations_by_kind_and_status(spark, d):
    return corpus.relations(spark, d).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '' AS id, '' AS kind, '' AS status WHERE false")
def relation_violations(spark, d):
    return graph.violations(corpus.relations(spark, d)).select("id", "kind", "status")


@query(f"WITH {RELATIONS} SELECT id, source, target, CASE WHEN status <> 'resolved' THEN anytarget END AS target_reference, kind, status, line, CASE WHEN status = 'partial' THEN CAST(0.8 AS DOUBLE) END AS confidence FROM rels")
def program_relations(spark, d):
    return corpus.relations(spark, d)


@query(f"WITH {RELATIONS}, k AS (SELECT * FROM rels WHERE target IS NOT NULL), b AS (SELECT min(source) AS x FROM k), u AS (SELECT 'dependency' AS side, target AS entity, kind, status FROM k, b WHERE source = x UNION ALL SELECT 'dependent', source, kind, status FROM k, b WHERE target = x) SELECT side, entity, kind, status, count(*) AS n FROM u GROUP BY ALL")
def symbol_neighbours(spark, d):
    r = corpus.relations(spark, d)
    return graph.neighbours(r, r.filter("target is not null").agg(F.min("source").alias("entity"))).drop("of")


@query(f"""{GRAPH}, e AS (SELECT DISTINCT sm, tm, kind FROM edges WHERE sm <> tm AND (sm = 1 OR tm = 1)) SELECT sm AS source_module, tm AS target_module, kind FROM e""")
def module_neighbours(spark, d):
    r = corpus.relations(spark, d).filter("target is not null")
    e = graph.lifted(r, corpus.symbols(spark, d), corpus.modules(spark, d), "leaf")
    return e.filter("source_module <> target_module and (source_module = 1 or target_module = 1)").select("source_module", "target_module", "kind").distinct()


@query(f"""WITH RECURSIVE {RELATIONS}, e0 AS (SELECT source AS a, anytarget AS b FROM rels), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
s AS (SELECT min(a) AS node FROM e0), h AS (SELECT node, 0 AS depth FROM s UNION SELECT e.b, h.depth + 1 FROM h JOIN e ON e.a = h.node WHERE h.depth < 2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM h GROUP BY node""")
def two_hop_neighbourhood(spark, d):
    e = corpus.relations(spark, d).select(F.col("source").alias("a"), F.coalesce("target", "target_reference").alias("b"))
    return graph.hops(e, e.agg(F.min("a").alias("node")), 2)


@query(f"""{GRAPH}, p AS (SELECT DISTINCT sm AS a, tm AS b FROM edges WHERE sm <> tm), m AS (SELECT b FROM p GROUP BY b ORDER BY count(*) DESC, b LIMIT 1)
SELECT a AS node, CAST(1 AS INTEGER) AS depth FROM p, m WHERE p.b = m.b UNION ALL SELECT b, 0 FROM m""")
def module_dependents(spark, d):
    r = corpus.relations(spark, d).filter("target is not null")
    e = graph.lifted(r, corpus.symbols(spark, d), corpus.modules(spark, d), "leaf").filter("source_module <> target_module")
    p = e.select(F.col("target_module").alias("a"), F.col("source_module").alias("b")).distinct()
    start = p.groupBy("a").count().orderBy(F.desc("count"), "a").limit(1).select(F.col("a").alias("node"))
    return graph.hops(p, start, 1, directed=True)


@query(f"""WITH {RELATIONS}, o AS (SELECT l_orderkey, list(concat('s:', l_orderkey, ':', l_suppkey) ORDER BY l_linenumber, l_suppkey) AS nodes FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3),
x AS (SELECT l_orderkey, unnest(nodes[1:len(nodes) - 1]) AS s, unnest(nodes[2:]) AS t FROM o),
k AS (SELECT DISTINCT source, target FROM rels WHERE status = 'resolved' AND kind = 'calls')
SELECT l_orderkey AS path_id, count(*) AS hops, count(k.source) AS matched, count(*) = count(k.source) AS verified FROM x LEFT JOIN k ON x.s = k.source AND x.t = k.target GROUP BY l_orderkey""")
def reachability_along_paths(spark, d):
    li = corpus.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", corpus.symbol_id("l_orderkey", "l_suppkey").alias("s"))
    p = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "s"))).alias("x"), F.count(F.lit(1)).alias("c")).filter("c >= 3")
    p = p.select(F.col("l_orderkey").alias("path_id"), F.lit("calls").alias("kind"), F.transform("x", lambda v: v["s"]).alias("nodes"))
    return graph.verified_paths(p, corpus.relations(spark, d))


TREE = f"""WITH {MODULES}, p AS (SELECT path, string_split(path, '/') AS p FROM mods), x AS (SELECT p, unnest(range(0, least(len(p), 7))) AS level FROM p),
r AS (SELECT CASE WHEN level = 0 THEN '.' ELSE array_to_string(p[1:level], '/') END AS prefix, CAST(level AS INTEGER) AS level, len(p) - 1 = level AS here, CASE WHEN len(p) - 1 > level THEN p[level + 1] END AS child FROM x),
tree AS (SELECT prefix, level, count(*) AS members, count(*) FILTER (here) AS direct, count(DISTINCT child) AS children FROM r GROUP BY prefix, level)"""


@query(f"{TREE} SELECT * FROM tree")
def containment_tree(spark, d):
    return graph.containment(corpus.modules(spark, d))


@query(f"{TREE} SELECT * FROM tree WHERE level = 0 OR (CASE WHEN direct > 0 THEN 1 ELSE 0 END) + children >= 2")
def containment_branch_points(spark, d):
    return graph.branch_points(graph.containment(corpus.modules(spark, d)))


@query(f"""WITH {MODULES} SELECT path AS node, CASE WHEN module % 2 = 0 THEN leaf WHEN r_name IS NOT NULL THEN container ELSE path END AS shown
FROM mods LEFT JOIN (SELECT r_name FROM region WHERE r_regionkey = 1) ON container = r_name""")
def visible_representatives(spark, d):
    """One container is collapsed, and the leaves of modules with even numbers."""
    m = corpus.modules(spark, d)
    up = m.select(F.col("path").alias("node"), "module", F.explode(F.array(F.struct(F.col("path").alias("ancestor"), F.lit(0).alias("distance")), F.struct(F.when(F.col("module") % 2 == 0, F.col("leaf")).alias("ancestor"), F.lit(1).alias("distance")), F.struct(F.col("container").alias("ancestor"), F.lit(2).alias("distance")))).alias("x")).select("node", "x.*").filter("ancestor is not null")
    shut = corpus.table(spark, d, "region").filter("r_regionkey = 1").select(F.col("r_name").alias("node")).unionByName(corpus.table(spark, d, "nation").select(F.col("n_name").alias("node")))
    return graph.representatives(up, shut)


PAIRS = f"""{GRAPH}, pairs AS (SELECT DISTINCT sg AS group_id, least(sm, tm) AS a, greatest(sm, tm) AS b FROM edges
  WHERE status = 'resolved' AND sg = tg AND sm <> tm)"""


def _affinity(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    return graph.affinity(_edges(spark, d) if edges is None else edges)


@query(f"{PAIRS} SELECT * FROM pairs")
def affinity_pairs(spark, d):
    return _affinity(spark, d)


BRIDGES = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
w AS (SELECT group_id, a AS x, b AS y FROM pairs UNION ALL SELECT group_id, b, a FROM pairs),
walk AS (SELECT group_id, a AS ca, b AS cb, a AS v FROM pairs UNION
  SELECT walk.group_id, ca, cb, w.y FROM walk JOIN w ON w.group_id = walk.group_id AND w.x = walk.v AND NOT ((w.x = ca AND w.y = cb) OR (w.x = cb AND w.y = ca))),
flagged AS (SELECT p.group_id, p.a, p.b, NOT EXISTS (SELECT 1 FROM walk x WHERE x.group_id = p.group_id AND x.ca = p.a AND x.cb = p.b AND x.v = p.b) AS bridge FROM pairs p),
core AS (SELECT group_id, a AS x, b AS y FROM flagged WHERE NOT bridge UNION ALL SELECT group_id, b, a FROM flagged WHERE NOT bridge),
reach AS (SELECT group_id, x AS s, x AS v FROM core UNION SELECT reach.group_id, s, core.y FROM reach JOIN core ON core.group_id = reach.group_id AND core.x = reach.v),
part AS (SELECT group_id, s AS v, min(v) AS cluster FROM reach GROUP BY group_id, s)"""


@query(f"{BRIDGES} SELECT f.group_id, f.a, f.b, f.bridge, CASE WHEN NOT f.bridge THEN pa.cluster END AS cluster FROM flagged f LEFT JOIN part pa ON pa.group_id = f.group_id AND pa.v = f.a")
def bridge_separated_clusters(spark, d):
    return graph.clusters(_affinity(spark, d))


CLUSTERS = BRIDGES + """, inside AS (SELECT group_id, v AS module, cluster FROM part), m AS (SELECT leaf AS group_id, module FROM mods),
size AS (SELECT group_id, count(*) AS size FROM m GROUP BY group_id),
over AS (SELECT m.group_id, m.module, CASE WHEN size < 3 THEN 'region_too_small' WHEN m.group_id NOT IN (SELECT group_id FROM pairs) THEN 'no_internal_resolved_relation'
    WHEN m.group_id NOT IN (SELECT group_id FROM inside) THEN 'no_useful_non_bridge_relation_core'
    WHEN NOT EXISTS (SELECT 1 FROM pairs p WHERE p.group_id = m.group_id AND m.module IN (p.a, p.b)) THEN 'no_internal_resolved_relation' ELSE 'only_bridge_connected_or_below_minimum_core' END AS reason,
    CASE WHEN size < 3 THEN 'region_too_small' WHEN m.group_id NOT IN (SELECT group_id FROM pairs) THEN 'no_internal_resolved_relations' ELSE 'insufficient_relation_core' END AS region_reason
  FROM m JOIN size USING (group_id) WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.group_id = m.group_id AND i.module = m.module))"""


def _clustered(spark: SparkSession, d: str, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members of clusters, and what is left over."""
    pairs = durable(_affinity(spark, d, edges))
    inside = durable(graph.members(graph.clusters(pairs)))
    modules = corpus.modules(spark, d).select(F.col("leaf").alias("group_id"), "module")
    return inside, graph.residuals(modules, pairs, inside)


@query(f"{CLUSTERS} SELECT group_id, module, reason FROM over")
def cluster_residuals(spark, d):
    """Modules that are in no cluster, and why."""
    return _clustered(spark, d)[1].select("group_id", "module", "reason")


@query(f"{CLUSTERS} SELECT group_id, region_reason AS reason, count(*) AS members FROM over GROUP BY ALL")
def region_residuals(spark, d):
    return graph.region_reasons(_clustered(spark, d)[1])


@query(f"""{CLUSTERS}, e AS (SELECT r.sg AS group_id, a.cluster AS ca, b.cluster AS cb FROM edges r LEFT JOIN inside a ON a.group_id = r.sg AND a.module = r.sm LEFT JOIN inside b ON b.group_id = r.tg AND b.module = r.tm WHERE status = 'resolved' AND sg = tg AND sm <> tm),
c AS (SELECT group_id, cluster, count(*) AS size FROM inside GROUP BY ALL)
SELECT c.group_id, c.cluster, concat('Structural cluster ', row_number() OVER (ORDER BY c.group_id, c.cluster)) AS display_name, size,
  (SELECT count(*) FROM e WHERE e.group_id = c.group_id AND ca = c.cluster AND cb = c.cluster) AS internal,
  (SELECT count(*) FROM e WHERE e.group_id = c.group_id AND (coalesce(ca = c.cluster, false)) <> (coalesce(cb = c.cluster, false))) AS boundary FROM c""")
def cluster_summary(spark, d):
    e = _edges(spark, d)
    return graph.cluster_table(e, _clustered(spark, d, e)[0])


@query(f"""{CLUSTERS}, e AS (SELECT concat_ws(':', a.group_id, a.cluster) AS source_cluster, concat_ws(':', b.group_id, b.cluster) AS target_cluster, kind, sm, tm FROM edges r JOIN inside a ON a.module = r.sm JOIN inside b ON b.module = r.tm WHERE status = 'resolved')
SELECT source_cluster, target_cluster, kind, count(*) AS relation_count, count(DISTINCT concat(sm, '|', tm)) AS pair_count FROM e WHERE source_cluster <> target_cluster GROUP BY ALL""")
def cluster_edges(spark, d):
    e = _edges(spark, d)
    return graph.cluster_edges(e, _clustered(spark, d, e)[0])


TREE_ROWS = f"""{CLUSTERS}, wrapped AS (SELECT group_id FROM inside UNION SELECT group_id FROM over WHERE reason = 'region_too_small'),
tree AS (SELECT container AS id, NULL AS parent, 'structural_container' AS kind, count(*) AS members FROM mods GROUP BY container
  UNION ALL SELECT leaf, container, 'structural_leaf', count(*) FROM mods GROUP BY ALL
  UNION ALL SELECT concat_ws(':', group_id, cluster), group_id, 'relation_cluster', count(*) FROM inside GROUP BY group_id, cluster
  UNION ALL SELECT concat(group_id, ':residual'), group_id, 'relation_residual', count(*) FROM over WHERE group_id IN (SELECT group_id FROM wrapped) GROUP BY group_id
  UNION ALL SELECT CAST(module AS VARCHAR), concat_ws(':', group_id, cluster), 'module', 1 FROM inside
  UNION ALL SELECT CAST(module AS VARCHAR), CASE WHEN group_id IN (SELECT group_id FROM wrapped) THEN concat(group_id, ':residual') ELSE group_id END, 'module', 1 FROM over)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return graph.group_rows(corpus.modules(spark, d), *_clustered(spark, d))


@query(f"{TREE_ROWS} SELECT * FROM tree")
def group_tree(spark, d):
    return _tree(spark, d)


@query(f"{TREE_ROWS} SELECT * FROM tree WHERE parent = 'ASIA'")
def group_children(spark, d):
    return graph.children(_tree(spark, d), "ASIA")


@query(f"{CLUSTERS}, e AS (SELECT DISTINCT concat_ws(':', i.group_id, i.cluster) AS cluster_id, a.path AS source, b.path AS target, kind FROM edges r JOIN inside i ON i.module = r.sm JOIN inside j ON j.module = r.tm AND j.group_id = i.group_id AND j.cluster = i.cluster JOIN mods a ON a.module = r.sm JOIN mods b ON b.module = r.tm WHERE status = 'resolved') SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY source, target, kind) <= 100")
def cluster_evidence(spark, d):
    e = _edges(spark, d)
    return graph.cluster_evidence(e, _clustered(spark, d, e)[0], corpus.modules(spark, d))


@query(f"{GRAPH} SELECT r.id, a.path AS source_path, b.path AS target_path FROM edges r JOIN mods a ON a.module = r.sm JOIN mods b ON b.module = r.tm WHERE status = 'resolved' AND a.path LIKE 'ASIA/%' AND b.path LIKE 'ASIA/%'")
def group_scope_edges(spark, d):
    m = corpus.modules(spark, d).select("module", "path")
    e = _edges(spark, d).join(m.select(F.col("module").alias("source_module"), F.col("path").alias("source_path")), "source_module")
    e = e.join(m.select(F.col("module").alias("target_module"), F.col("path").alias("target_path")), "target_module")
    return graph.scope_edges(e.select("id", "source_path", "target_path"), "ASIA")


@query(f"WITH {MODULES}, up AS (SELECT path AS node, leaf, container FROM mods), open_ AS (SELECT r_name AS g FROM region WHERE r_regionkey <> 1 UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) SELECT node FROM up WHERE leaf IN (SELECT g FROM open_) AND container IN (SELECT g FROM open_)")
def visible_groups(spark, d):
    m = corpus.modules(spark, d)
    up = m.select(F.col("path").alias("node"), F.posexplode(F.array("path", "leaf", "container")).alias("distance", "ancestor"))
    shown = corpus.table(spark, d, "region").filter("r_regionkey <> 1").select(F.col("r_name").alias("node"))
    return graph.visible(up, shown.unionByName(corpus.table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("node"))))


@query(f"{PAIRS}, e AS (SELECT unnest([a, b]) AS node FROM pairs) SELECT node, count(*) AS degree FROM e GROUP BY node")
def graph_degrees(spark, d):
    return graph.degrees(_affinity(spark, d))


@query(PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT x AS s, x AS v FROM w UNION SELECT s, w.y FROM reach JOIN w ON w.x = reach.v)
SELECT s AS node, min(v) AS component FROM reach GROUP BY s""")
def connected_components(spark, d):
    return graph.connected(_affinity(spark, d))


SPANS = """WITH s AS (SELECT DISTINCT concat('p', l_orderkey) AS path, concat('s', l_orderkey, ':', l_linenumber, ':', l_suppkey) AS id, l_linenumber AS start_line, l_linenumber + CAST(l_quantity AS INTEGER) % 3 AS end_line, l_linenumber % 2 AS odd FROM lineitem)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return corpus.table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_orderkey")).alias("path"), F.concat(F.lit("s"), F.col("l_orderkey"), F.lit(":"), n, F.lit(":"), F.col("l_suppkey")).alias("id"), n.alias("start_line"), (n + F.col("l_quantity").cast("int") % 3).alias("end_line"), (n % 2).alias("odd")).distinct()


@query(f"""{SPANS}, h AS (SELECT a.id AS anchor, b.id AS symbol FROM (SELECT DISTINCT path, id, start_line, end_line FROM s WHERE odd = 0) a JOIN (SELECT DISTINCT path, id, start_line, end_line FROM s WHERE odd = 1) b ON a.path = b.path AND b.end_line >= a.start_line AND b.start_line <= a.end_line),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor ORDER BY symbol) AS INTEGER) AS rank FROM h) SELECT anchor, symbol, rank FROM r WHERE rank <= 8""")
def anchor_symbol_overlap(spark, d):
    s = _spans(spark, d)
    return graph.overlapping(s.filter("odd = 0"), s.filter("odd = 1"))


@query(f"""{SPANS}, p AS (SELECT concat('p', o_orderkey) AS path, o_orderkey AS point, 3 AS line FROM orders),
h AS (SELECT p.point, s.id, s.end_line - s.start_line AS n FROM p JOIN s ON p.path = s.path AND p.line BETWEEN s.start_line AND s.end_line),
r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY n, id) AS k FROM h) SELECT point, id AS span FROM r WHERE k = 1""")
def innermost_span(spark, d):
    points = corpus.table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey")).alias("path"), F.col("o_orderkey").alias("point"), F.lit(3).alias("line"))
    return graph.innermost(_spans(spark, d), points)


# text and search

@query(f"{FILES} SELECT path, language, role, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS line_count, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS token_estimate, sha256(text) AS content_hash FROM files")
def file_inventory(spark, d):
    text = F.col("text")
    return corpus.files(spark, d).select("path", "language", "role", t.line_count(text).cast("long").alias("line_count"), t.token_estimate(text).alias("token_estimate"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


@query(f"{FILES} SELECT language, count(*) AS n FROM files GROUP BY language")
def language_counts(spark, d):
    return corpus.files(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(f"{FILES} SELECT count(*) FILTER (text <> '') AS readable, count(*) FILTER (text = '') AS skipped, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM files")
def parser_coverage(spark, d):
    return corpus.files(spark, d).agg(F.count_if(F.col("text") != "").alias("readable"), F.count_if(F.col("text") == "").alias("skipped"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


_ALIAS = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.ALIASES.items()) + " ELSE NULL END"
TOKENS = f"list_transform(regexp_extract_all(lower(regexp_replace(TXT, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda x: coalesce({_ALIAS}, CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN concat(left(x, length(x) - 3), 'y') WHEN x LIKE '%ing' AND length(x) > 5 THEN left(x, length(x) - 3) WHEN x LIKE '%s' AND length(x) > 4 THEN left(x, length(x) - 1) ELSE x END))"


@query(f"WITH x AS (SELECT item_id, unnest({TOKENS.replace('TXT', 'text')}) AS token FROM benchmark) SELECT token, count(*) AS n, count(DISTINCT item_id) AS items FROM x GROUP BY token")
def normalised_tokens(spark, d):
    df = corpus.table(spark, d, "benchmark").select("item_id", F.explode(t.tokens(F.col("text"))).alias("token"))
    return df.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"))


@query("SELECT doc_id, trim(left(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 220)) AS preview FROM documents")
def previews(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", F.trim(t.preview(F.col("text"))).alias("preview"))


@query(f"{FILES}, s AS (SELECT path, (CASE WHEN contains(lower(path), 'src1') THEN 1.0 ELSE 0.0 END) + (CASE WHEN contains(lower(path), 'en') THEN 1.0 ELSE 0.0 END) AS s, role FROM files) SELECT path, CAST(round(s + CASE WHEN role = 'production' THEN 0.2 ELSE 0 END, 6) AS DOUBLE) AS score FROM s WHERE s > 0 ORDER BY score DESC, path LIMIT 20")
def search_files(spark, d):
    return search.search_files(corpus.files(spark, d), "src1 en")


CODE = "SELECT path, line, CAST(round(2.0 + CASE WHEN role = 'production' THEN 0.4 ELSE 0 END + CASE WHEN line <= 20 THEN 0.1 ELSE 0 END, 6) AS DOUBLE) AS score FROM lines WHERE contains(lower(text), 'license') AND contains(lower(text), 'under') ORDER BY score DESC, path, line LIMIT 20"


@query(f"{FILES} {CODE}")
def search_code(spark, d):
    return search.search_code(corpus.lines(spark, d), "license under")


@query(f"{FILES}, h AS ({CODE}), own AS (SELECT min(path) AS p FROM h) SELECT path, line, round(greatest(0.1, score - 0.5), 6) AS score FROM h, own WHERE path = p")
def find_references(spark, d):
    """References in the file that comes first among them; they are a screenful, so one task compares them."""
    hits = search.find_references(corpus.lines(spark, d), "license under")
    return hits.withColumn("own", F.min("path").over(Window.partitionBy())).filter("path = own").drop("own")


@query("""WITH x AS (SELECT p_partkey AS id, p_brand, (CASE WHEN contains(lower(concat_ws(' ', p_name, p_type)), 'small') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(concat_ws(' ', p_name, p_type)), 'ring') THEN 1 ELSE 0 END)
  + CASE WHEN lower(p_name) = 'small ring' THEN 3 ELSE 0 END AS s FROM part) SELECT id, CAST(s AS DOUBLE) AS score FROM x WHERE s > 0 ORDER BY score DESC, p_brand, id LIMIT 20""")
def find_definition(spark, d):
    p = corpus.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("qualified_name"), F.col("p_brand").alias("path"))
    return search.find_definition(p, "small ring")


@query(f"{FILES}, l AS (SELECT path, max(line) AS last FROM lines GROUP BY path), s AS (SELECT path, line, substring(text, 1, 80) AS title, lead(line) OVER (PARTITION BY path ORDER BY line) - 1 AS e FROM lines WHERE regexp_matches(text, '^[A-Z][a-z]+ [a-z]+')) SELECT s.path, line AS start_line, coalesce(e, last) AS end_line, title FROM s JOIN l ON s.path = l.path")
def file_outline(spark, d):
    return search.outline(corpus.lines(spark, d), "^[A-Z][a-z]+ [a-z]+")


@query(f"{FILES}, l AS (SELECT path, max(line) AS last FROM lines GROUP BY path) SELECT lines.path, line, greatest(1, line - 2) AS start_line, least(last, line + 2) AS end_line FROM lines JOIN l ON lines.path = l.path")
def expanded_regions(spark, d):
    return search.regions(corpus.lines(spark, d), 2)


def _intent_sql() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(q, '{p}')" for p in ps) + f" THEN '{k}'" for k, ps in t.INTENTS)
    return f"WITH x AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE {cases} ELSE 'explanatory' END AS intent FROM x"


@query(_intent_sql())
def question_intents(spark, d):
    return corpus.table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", t.intent(F.col("text")).alias("intent"))


def _search_sql(terms: list[str]) -> str:
    sets = {"name": "nt", "qualified_name": "qt", "path": "pt", "signature": "gt", "source": "st"}
    cols = []
    for i, term in enumerate(terms):
        parts = [f"CASE WHEN list_contains({sets[f]}, '{c}') THEN {w * (1.0 if c == term else search.SYNONYM)} ELSE 0 END" for c in t.CONCEPTS.get(term, [term]) for f, w in search.WEIGHTS.items()]
        cols.append(f"CAST(greatest({', '.join(parts)}) AS DOUBLE) AS t{i}")
    total, hit = " + ".join(f"t{i}" for i in range(len(terms))), " + ".join(f"CASE WHEN t{i} > 0 THEN 1 ELSE 0 END" for i in range(len(terms)))
    tok = lambda c: TOKENS.replace("TXT", c)
    return f"""WITH c AS (SELECT p_partkey, p_name, p_brand, {tok('p_name')} AS nt, {tok("concat(p_brand, ' ', p_name)")} AS qt, {tok('p_brand')} AS pt, {tok('p_type')} AS gt, {tok("concat(p_type, ' ', p_name)")} AS st FROM part),
s AS (SELECT *, {', '.join(cols)} FROM c), r AS (SELECT *, round({total} + 4.0 * ({hit}) / {len(terms)}, 6) AS score FROM s), p AS (SELECT * FROM r WHERE score > 0)
SELECT CAST(row_number() OVER (ORDER BY score DESC, p_brand, p_name, p_partkey) AS INTEGER) AS rank, p_partkey AS id, score, round(least(1.0, 0.35 + score / 24), 6) AS confidence FROM p QUALIFY rank <= 10"""


@query(_search_sql(t.query_terms("where is the small ring stored?")))
def local_search(spark, d):
    p = corpus.table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.lit("class").alias("kind"), F.concat_ws(" ", "p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_name").alias("qualified_name"), F.col("p_brand").alias("path"), F.col("p_type").alias("signature"), F.concat_ws(" ", "p_type", "p_name").alias("source"), F.lit(1).alias("start_line"))
    # names repeat in the test table, so the id follows as the last key
    return search.local_search(c.withColumn("start_line", F.lit(1)), "where is the small ring stored?")


_Q = "['compare', 'small', 'economy', 'rings', 'ring', 'brand']"


@query(f"WITH x AS (SELECT p_partkey AS id, 3 * len(list_intersect(list_distinct(string_split_regex(lower(p_name), '[^a-z0-9]+')), {_Q})) + 2 * len(list_intersect(list_distinct(string_split_regex(lower(p_type), '[^a-z0-9]+')), {_Q})) + len(list_intersect(list_distinct(string_split_regex(lower(p_brand), '[^a-z0-9]+')), {_Q})) AS score FROM part) SELECT id, CAST(score AS BIGINT) AS score FROM x WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def matching_components(spark, d):
    p = corpus.table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("summary"), F.array("p_brand").alias("responsibilities"))
    return search.matching_components(c, "Compare small economy rings: ring of a brand?")


# evidence and claims

CITES = f"""{FILES}, len AS (SELECT f.path, f.role, f.language, sha256(f.text) AS hash, max(line) AS last_line FROM files f JOIN lines l ON l.path = f.path GROUP BY ALL),
src AS (SELECT 'file_range' AS kind, path AS ref, path, 1 AS first_line, last_line, hash FROM len UNION ALL SELECT 'orientation_item', path, path, 1, last_line, hash FROM len WHERE role = 'docs'
  UNION ALL SELECT 'source_region', path, path, 2, least(last_line, 5), hash FROM len UNION ALL SELECT 'semantic_anchor', path, path, 1, last_line, hash FROM len WHERE language = 'go' UNION ALL SELECT 'parsed_symbol', path, path, 1, last_line, hash FROM len WHERE language = 'python'),
docs AS (SELECT doc_id, concat_ws('/', source, lang, concat('doc_', doc_id, list_extract(['.py','.ts','.md','.txt','.go','_test.py'], CAST(doc_id % 6 + 1 AS BIGINT)))) AS path, sha256(coalesce(text, '')) AS hash FROM documents WHERE doc_id IS NOT NULL),
cites AS (SELECT l_orderkey AS claim, l_linenumber AS citation, CASE l_linenumber % 6 WHEN 0 THEN 'orientation_item' WHEN 1 THEN 'file_range' WHEN 2 THEN 'source_region' WHEN 3 THEN 'semantic_anchor' WHEN 4 THEN 'parsed_symbol' ELSE 'guess' END AS kind,
    CASE WHEN l_partkey % 50 <> 0 THEN coalesce(path, concat('lost/', l_partkey)) END AS ref, CASE WHEN l_suppkey % 9 = 0 THEN 'else/where' ELSE path END AS path,
    CASE WHEN l_suppkey % 10 > 0 THEN CAST(l_quantity AS BIGINT) % 4 END AS start_line, CAST(l_quantity AS BIGINT) % 7 AS end_line, CASE WHEN l_suppkey % 4 = 0 THEN 'stale' WHEN l_suppkey % 4 = 1 THEN hash END AS content_hash
  FROM lineitem LEFT JOIN docs ON doc_id = l_partkey),
checked AS (SELECT claim, citation, c.kind, CASE WHEN c.kind = 'guess' THEN 'unsupported_kind' WHEN c.ref IS NULL THEN 'no_reference' WHEN s.ref IS NULL THEN 'missing' WHEN c.kind NOT IN ('file_range', 'source_region') THEN 'ok'
    WHEN c.kind = 'file_range' AND (start_line IS NULL OR end_line IS NULL) THEN 'no_lines' WHEN c.path <> s.path THEN 'other_path' WHEN start_line < first_line THEN 'bad_start' WHEN end_line > last_line THEN 'beyond_end' WHEN end_line < start_line THEN 'bad_end'
    WHEN c.content_hash <> s.hash THEN 'other_hash' ELSE 'ok' END AS reason FROM cites c LEFT JOIN src s ON c.kind = s.kind AND c.ref = s.ref)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.table(spark, d, "documents").filter("doc_id is not null")
    docs = docs.select(F.col("doc_id").alias("l_partkey"), corpus.path_of(F.col("doc_id"), F.col("source"), F.col("lang")).alias("own"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("hash"))
    li = corpus.table(spark, d, "lineitem").join(docs, "l_partkey", "left")
    kinds = ["orientation_item", "file_range", "source_region", "semantic_anchor", "parsed_symbol", "guess"]
    q, s = F.col("l_quantity").cast("long"), F.col("l_suppkey")
    cites = li.select(
        F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("citation"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("kind"),
        F.when(F.col("l_partkey") % 50 != 0, F.coalesce("own", F.concat(F.lit("lost/"), F.col("l_partkey")))).alias("ref"), F.when(s % 9 == 0, "else/where").otherwise(F.col("own")).alias("path"),
        F.when(s % 10 > 0, q % 4).alias("start_line"), (q % 7).alias("end_line"), F.when(s % 4 == 0, "stale").when(s % 4 == 1, F.col("hash")).alias("content_hash"),
    )
    f = corpus.files(spark, d)
    n = t.line_count(F.col("text")).cast("long")
    f = f.select("path", "role", "language", n.alias("last_line"), F.sha2(F.encode("text", "UTF-8"), 256).alias("source_hash")).filter("last_line > 0")
    source = lambda df, kind, first=1, last=F.col("last_line"): df.select(F.lit(kind).alias("kind"), F.col("path").alias("ref"), F.col("path").alias("source_path"), F.lit(first).alias("first_line"), last.alias("last_line"), "source_hash")
    sources = source(f, "file_range").unionByName(source(f.filter("role = 'docs'"), "orientation_item")).unionByName(source(f, "source_region", 2, F.least("last_line", F.lit(5))))
    sources = sources.unionByName(source(f.filter("language = 'go'"), "semantic_anchor")).unionByName(source(f.filter("language = 'python'"), "parsed_symbol"))
    return evidence.checked_citations(cites, sources)


@query(f"{CITES} SELECT claim, citation, kind, reason, reason = 'ok' AS valid FROM checked")
def citation_checks(spark, d):
    return _checked(spark, d)


GROUNDED = f"""{CITES}, g AS (SELECT claim, count(*) AS citations, count(*) FILTER (reason = 'ok' AND kind <> 'orientation_item') AS verified, count(*) FILTER (reason = 'ok' AND kind = 'orientation_item') AS notes, count(*) FILTER (reason <> 'ok') AS bad FROM checked GROUP BY claim),
a AS (SELECT o_orderkey AS claim, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'inferred' ELSE 'uncertain' END AS requested FROM orders),
grounded AS (SELECT a.claim, coalesce(citations, 0) AS citations, coalesce(verified, 0) AS verified, CASE WHEN citations IS NULL THEN 'not_inspected' WHEN bad > 0 AND verified > 0 THEN 'uncertain' WHEN bad > 0 AND notes > 0 THEN 'orientation_only' WHEN bad > 0 THEN 'unsupported'
  WHEN verified > 0 THEN 'verified' WHEN notes > 0 THEN 'orientation_only' WHEN requested = 'verified' THEN 'uncertain' ELSE requested END AS support FROM a LEFT JOIN g ON g.claim = a.claim)"""


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "inferred").otherwise("uncertain")
    return evidence.support(_checked(spark, d), corpus.table(spark, d, "orders").select(F.col("o_orderkey").alias("claim"), asked.alias("requested")))


@query(f"{GROUNDED} SELECT * FROM grounded")
def claim_support(spark, d):
    return _grounded(spark, d)


@query(f"{GROUNDED} SELECT claim, CASE WHEN verified = 0 THEN 'insufficient_evidence' WHEN support IN ('verified', 'inferred') THEN 'supported' ELSE 'insufficient_evidence' END AS support_status, CASE WHEN support = 'verified' AND verified = 1 THEN 'observed' ELSE 'inferred' END AS epistemic_type FROM grounded")
def projected_claims(spark, d):
    return evidence.projected(_grounded(spark, d).withColumnRenamed("verified", "evidence"))


@query(f"{GROUNDED} SELECT count(*) FILTER (support = 'verified') AS verified, count(*) FILTER (support NOT IN ('verified', 'inferred')) AS downgraded, (SELECT count(*) FROM checked WHERE reason <> 'ok') AS failures, round(avg(CASE support WHEN 'verified' THEN 1.0 WHEN 'inferred' THEN 0.65 WHEN 'orientation_only' THEN 0.65 WHEN 'uncertain' THEN 0.35 ELSE 0 END), 6) AS confidence FROM grounded")
def grounding_totals(spark, d):
    return evidence.totals(_grounded(spark, d), _checked(spark, d))


@query(f"""WITH {RELATIONS}, c AS (SELECT DISTINCT source, kind, anytarget AS target, concat(source, '>', anytarget, '>', kind) AS claim FROM rels), k AS (SELECT source, kind, target, min(id) AS evidence FROM rels WHERE status = 'resolved' GROUP BY source, kind, target)
SELECT claim, CASE WHEN evidence IS NOT NULL THEN 'supported' ELSE 'insufficient' END AS verdict, evidence FROM c LEFT JOIN k ON c.source = k.source AND c.kind = k.kind AND c.target = k.target""")
def direct_relation_claims(spark, d):
    r = corpus.relations(spark, d)
    to = F.coalesce("target", "target_reference")
    claims = r.select("source", "kind", to.alias("target"), F.concat_ws(">", "source", to, "kind").alias("claim")).distinct()
    return evidence.verified_relations(claims, r)


#: Evidence from lines of orders: spans and relationships, of which the candidate's differ in an end here and there.
PROVEN = """WITH x AS (SELECT DISTINCT l_orderkey AS claim, l_linenumber AS hop, l_suppkey AS file, CASE WHEN l_quantity % 2 = 0 THEN 'relationship' ELSE 'source_span' END AS kind, CASE WHEN l_tax < 0.04 THEN 'calls' ELSE 'inherits' END AS relation,
  l_suppkey AS source, l_partkey AS target, CASE WHEN l_discount > 0.02 THEN l_partkey END AS symbol, l_returnflag = 'N' AS told, l_linestatus = 'O' AS said FROM lineitem),
t AS (SELECT DISTINCT claim, hop, file, kind, hop AS a, hop + 1 AS b, CASE kind WHEN 'relationship' THEN [CAST(relation AS VARCHAR), CAST(source AS VARCHAR), CAST(target AS VARCHAR)] ELSE [CAST(symbol AS VARCHAR)] END AS ends FROM x WHERE told),
c AS (SELECT DISTINCT claim, hop, file, kind, hop + 1 AS a, hop + 2 AS b, CASE kind WHEN 'relationship' THEN [CASE WHEN hop = 2 THEN 'calls' ELSE relation END, CAST(source AS VARCHAR), CAST(CASE WHEN hop = 4 THEN target + 1 ELSE target END AS VARCHAR)] ELSE [CASE WHEN hop = 3 THEN NULL ELSE CAST(symbol AS VARCHAR) END] END AS ends FROM x WHERE said),
m AS (SELECT DISTINCT t.claim, t.hop, c.hop AS c_hop FROM t JOIN c ON c.claim = t.claim AND c.file = t.file AND c.kind = t.kind AND greatest(c.a, t.a) <= least(c.b, t.b)
  AND c.ends IS NOT DISTINCT FROM t.ends)"""


def _proven(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidate and truth."""
    li, n = corpus.table(spark, d, "lineitem"), F.col("l_linenumber")
    kind = F.when(F.col("l_quantity") % 2 == 0, "relationship").otherwise("source_span")
    relation = F.when(F.col("l_tax") < 0.04, "calls").otherwise("inherits")
    symbol = F.when(F.col("l_discount") > 0.02, F.col("l_partkey"))

    def rows(df, by, relation, target, symbol):
        fact = evidence.fact(kind, relation, F.col("l_suppkey"), target, symbol)
        return df.select(F.col("l_orderkey").alias("claim"), n.alias("hop"), F.col("l_suppkey").alias("file"), fact.alias("fact"), (n + by).alias("start_line"), (n + by + 1).alias("end_line")).distinct()

    part = F.col("l_partkey")
    said = rows(li.filter("l_linestatus = 'O'"), 1, F.when(n == 2, "calls").otherwise(relation), F.when(n == 4, part + 1).otherwise(part), F.when(n != 3, symbol))
    return said, rows(li.filter("l_returnflag = 'N'"), 0, relation, part, symbol)


@query(f"{PROVEN} SELECT * FROM m")
def evidence_overlap(spark, d):
    return evidence.matched_evidence(*_proven(spark, d))


VERDICTS = """WITH truth AS (SELECT doc_id AS claim, CASE WHEN quality = 1 THEN 'supported' WHEN toxic = 1 THEN 'contradicted' ELSE 'insufficient' END AS expected FROM labels),
cand AS (SELECT doc_id AS claim, CASE WHEN length(text) >= 600 THEN 'supported' WHEN length(text) >= 200 THEN 'insufficient' ELSE 'contradicted' END AS actual FROM documents),
j AS (SELECT t.claim, expected, actual FROM truth t LEFT JOIN cand c ON t.claim = c.claim)"""


@query(f"""{VERDICTS}, m AS (
SELECT 'claim_support_precision' AS metric, count(*) FILTER (expected = 'supported' AND actual = 'supported') AS numerator, count(*) FILTER (actual = 'supported') AS denominator FROM j UNION ALL
SELECT 'claim_support_recall', count(*) FILTER (expected = 'supported' AND actual = 'supported'), count(*) FILTER (expected = 'supported') FROM j UNION ALL
SELECT 'unsupported_claim_acceptance_rate', count(*) FILTER (expected <> 'supported' AND actual = 'supported'), count(*) FILTER (expected <> 'supported' AND actual IS NOT NULL) FROM j UNION ALL
SELECT 'correct_abstention_rate', count(*) FILTER (expected <> 'supported' AND actual = expected), count(*) FILTER (expected <> 'supported' AND actual IS NOT NULL) FROM j)
SELECT metric, round(numerator / nullif(denominator, 0), 6) AS value, numerator, denominator FROM m""")
def claim_metrics(spark, d):
    return evidence.scores(*corpus.verdicts(spark, d))


@query(f"{VERDICTS} SELECT expected, coalesce(actual, 'abstained') AS actual, count(*) AS n FROM j GROUP BY ALL")
def claim_confusion(spark, d):
    return evidence.confusion(*corpus.verdicts(spark, d))


@query(f"{VERDICTS} SELECT claim, actual FROM cand WHERE NOT EXISTS (SELECT 1 FROM truth WHERE truth.claim = cand.claim)")
def novel_claims(spark, d):
    truth, cand = corpus.verdicts(spark, d)
    return evidence.novel(cand, truth)


PROPOSED = f"""WITH {RELATIONS}, c AS (SELECT DISTINCT source, kind, anytarget AS target FROM rels), k AS (SELECT source, kind, target, min(id) AS evidence FROM rels WHERE status = 'resolved' GROUP BY source, kind, target),
claims AS (SELECT concat('claim:', substring(sha1(concat_ws('|', 'run', 'observed', 'direct_relation', c.source, c.kind, c.target, '')), 1, 24)) AS claim_id, c.source, c.kind, c.target,
  concat(c.source, CASE c.kind WHEN 'calls' THEN ' calls ' ELSE ' inherits from ' END, c.target, '.') AS statement, CASE WHEN evidence IS NULL THEN 'insufficient_evidence' ELSE 'supported' END AS support_status, 'observed' AS epistemic_type, evidence
  FROM c LEFT JOIN k ON k.source = c.source AND k.kind = c.kind AND k.target = c.target)"""


def _proposed(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.relations(spark, d)
    return evidence.proposition_claims(r.select("source", "kind", F.coalesce("target", "target_reference").alias("target")).distinct(), r)


@query(f"{PROPOSED} SELECT * FROM claims")
def proposition_claims(spark, d):
    return _proposed(spark, d)


@query(f"""{PROPOSED} SELECT source AS target, CAST(CASE support_status WHEN 'supported' THEN 0 ELSE 1 END AS INTEGER) AS section, CASE support_status WHEN 'supported' THEN 'What could be established:' ELSE 'What could not be established:' END AS title, statement AS position,
  CASE support_status WHEN 'supported' THEN concat('- ', statement) ELSE concat('- There was not sufficient deterministic evidence to establish that ', rtrim(statement, '.'), '.') END AS line FROM claims""")
def claim_sections(spark, d):
    c = _proposed(spark, d)
    return evidence.sections(c.select(F.col("source").alias("target"), F.col("statement").alias("position"), F.col("support_status").alias("status"), "statement"))


@query(f"""{PROPOSED}, l AS (SELECT source AS target, statement, support_status, CASE support_status WHEN 'supported' THEN concat('- ', statement) ELSE concat('- There was not sufficient deterministic evidence to establish that ', rtrim(statement, '.'), '.') END AS line FROM claims),
g AS (SELECT target, support_status, string_agg(line, chr(10) ORDER BY statement) AS text, count(*) AS n FROM l GROUP BY ALL)
SELECT target, CAST(sum(n) AS BIGINT) AS claims, string_agg(concat(CASE support_status WHEN 'supported' THEN 'What could be established:' ELSE 'What could not be established:' END, chr(10), text), chr(10) || chr(10) ORDER BY support_status = 'supported' DESC) AS text FROM g GROUP BY target""")
def claim_narrative(spark, d):
    c = _proposed(spark, d)
    return evidence.narrative(c.select(F.col("source").alias("target"), F.col("statement").alias("position"), F.col("support_status").alias("status"), "statement"))


@query(f"""WITH {RELATIONS}, reg AS (SELECT concat('region:', l_orderkey, ':', l_linenumber) AS region_id, concat('p', l_orderkey) AS path, CAST(l_linenumber AS BIGINT) AS a, CAST(l_linenumber + l_linenumber % 2 AS BIGINT) AS b FROM lineitem GROUP BY ALL)
SELECT rels.id AS relation_id, source AS source_entity_id, anytarget AS target_entity_id, kind AS relation_kind, status AS resolution_status, region_id FROM rels LEFT JOIN reg ON reg.path = concat('p', split_part(source, ':', 2)) AND reg.a = line AND reg.a = reg.b""")
def relation_evidence(spark, d):
    n = F.col("l_linenumber")
    regions = corpus.table(spark, d, "lineitem").select(F.concat(F.lit("region:"), F.col("l_orderkey"), F.lit(":"), n).alias("region_id"), F.concat(F.lit("p"), F.col("l_orderkey")).alias("path"), n.cast("long").alias("start_line"), (n + n % 2).cast("long").alias("end_line")).distinct()
    r = corpus.relations(spark, d).withColumn("path", F.concat(F.lit("p"), F.split("source", ":")[1]))
    return evidence.relation_evidence(r, regions)


@query(f"""WITH {RELATIONS}, known AS (SELECT source AS e FROM rels WHERE status = 'resolved' UNION SELECT target FROM rels WHERE status = 'resolved'),
p AS (SELECT id AS proposal, CASE WHEN line % 2 = 0 THEN 'reachability' ELSE 'direct_relation' END AS proposition, kind, source, anytarget FROM rels)
SELECT proposal, NOT (proposition = 'reachability' AND kind = 'inherits') AS allowed, array_to_string(list_sort(list_filter(list_distinct([CASE WHEN source NOT IN (SELECT e FROM known) THEN source END, CASE WHEN anytarget NOT IN (SELECT e FROM known) THEN anytarget END]), lambda x: x IS NOT NULL)), ',') AS unknown,
  NOT (proposition = 'reachability' AND kind = 'inherits') AND source IN (SELECT e FROM known) AND anytarget IN (SELECT e FROM known) AS valid FROM p""")
def proposal_checks(spark, d):
    r = corpus.relations(spark, d)
    known = r.filter("status = 'resolved'").select(F.explode(F.array("source", "target")).alias("entity")).distinct()
    kind = F.when(F.col("line") % 2 == 0, "reachability").otherwise("direct_relation")
    p = r.select(F.col("id").alias("proposal"), kind.alias("proposition"), "kind", F.array("source", F.coalesce("target", "target_reference")).alias("entities"))
    return evidence.validated_proposals(p, known).select("proposal", "allowed", F.array_join("unknown", ",").alias("unknown"), "valid")


@query(f"""WITH RECURSIVE {RELATIONS}, e0 AS (SELECT source AS a, anytarget AS b FROM rels), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), s AS (SELECT min(a) AS node FROM e0),
h AS (SELECT node, 0 AS depth FROM s UNION SELECT e.b, h.depth + 1 FROM h JOIN e ON e.a = h.node WHERE h.depth < 2), near AS (SELECT DISTINCT node FROM h),
c AS (SELECT DISTINCT source, kind, anytarget AS target FROM rels WHERE source IN (SELECT node FROM near) AND anytarget IN (SELECT node FROM near)),
k AS (SELECT DISTINCT source, kind, target FROM rels WHERE status = 'resolved')
SELECT c.source, c.kind, c.target, CASE WHEN k.source IS NULL THEN 'insufficient_evidence' ELSE 'supported' END AS support_status FROM c LEFT JOIN k ON k.source = c.source AND k.kind = c.kind AND k.target = c.target""")
def target_verification(spark, d):
    """All claims about what stands within two steps of one target, checked against relations."""
    e = durable(corpus.symbol_edges(spark, d))
    near = durable(graph.hops(e, e.agg(F.min("a").alias("node")), 2, written=True).select(F.col("node").alias("entity")))
    to = F.coalesce("target", "target_reference")
    # relations of what is near: only they say anything of a claim, and the check below is over them
    end = lambda c: light(near.select(F.col("entity").alias(c)))
    r = corpus.relations(spark, d).withColumn("to", to).join(end("source"), "source", "left_semi").join(end("to"), "to", "left_semi").drop("to")
    r = durable(r)
    p = r.select(F.lit("direct_relation").alias("proposition"), "source", "kind", to.alias("target")).distinct()
    p = p.withColumn("proposal", F.concat_ws(">", "source", "kind", "target")).withColumn("entities", F.array("source", "target"))
    valid = evidence.validated_proposals(p, near).filter("valid").select("source", "kind", "target")
    return evidence.proposition_claims(valid, r).select("source", "kind", "target", "support_status")


@query(f"""{PROVEN}, k AS (SELECT DISTINCT claim FROM c), kt AS (SELECT DISTINCT claim FROM t),
per AS (SELECT claim, count(*) AS hops FROM t WHERE claim IN (SELECT claim FROM k) GROUP BY claim), f AS (SELECT claim, count(DISTINCT hop) AS found FROM m GROUP BY claim)
SELECT 'evidence_correctness' AS metric, round((SELECT count(*) FROM (SELECT DISTINCT claim, c_hop FROM m)) / (SELECT count(*) FROM c WHERE claim IN (SELECT claim FROM kt)), 6) AS value
UNION ALL SELECT 'evidence_completeness', round(avg(coalesce(found, 0) / hops), 6) FROM per LEFT JOIN f ON f.claim = per.claim""")
def evidence_scores(spark, d):
    return evidence.evidence_scores(*_proven(spark, d))


@query(f"""{SPANS}, sp AS (SELECT concat('r', l_orderkey, ':', l_linenumber, ':', l_suppkey) AS id, concat('s', l_orderkey, ':', l_linenumber, ':', l_suppkey) AS symbol, concat('p', l_orderkey) AS path, l_linenumber + l_suppkey % 3 AS line FROM lineitem GROUP BY ALL),
own AS (SELECT id AS symbol, min(path) AS path, min(start_line) AS a, max(end_line) AS b FROM s GROUP BY id)
SELECT sp.id, sp.symbol, sp.path, sp.line FROM sp LEFT JOIN own ON own.symbol = sp.symbol WHERE NOT coalesce(sp.path = own.path AND line BETWEEN a AND b, false)""")
def span_audit(spark, d):
    n = F.col("l_linenumber")
    key = F.concat_ws(":", "l_orderkey", n, "l_suppkey")
    spans = corpus.table(spark, d, "lineitem").select(F.concat(F.lit("r"), key).alias("id"), F.concat(F.lit("s"), key).alias("symbol"), F.concat(F.lit("p"), F.col("l_orderkey")).alias("path"), (n + F.col("l_suppkey") % 3).alias("line")).distinct()
    own = _spans(spark, d).groupBy(F.col("id").alias("symbol")).agg(F.min("path").alias("path"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return evidence.span_audit(spans, own)


# runs and stages

STAGES = """WITH st AS (SELECT user_id AS run_id, concat('stage', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS stage, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'failed' ELSE 'pending' END AS status,
CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_id % 7 AS tokens_in, event_id % 3 AS tokens_out, event_id % 11 = 0 AS cache_hit, event_id AS sort_order, ts AS moment, event_type,
CASE WHEN value > 60 THEN 'model_unavailable' WHEN value > 50 THEN '' END AS fallback_reason, event_id % 4 AS warnings, event_type = 'view' AND value > 40 AS can_render FROM events)"""


@query(f"""{STAGES} SELECT run_id, count(*) AS stage_count, count(*) FILTER (status = 'failed') AS failed_stage_count, count(*) FILTER (tokens_in > 0 OR tokens_out > 0) AS llm_stage_count, count(*) FILTER (fallback_reason <> '') AS fallback_stage_count, CAST(sum(warnings) AS BIGINT) AS warning_count, count(*) FILTER (cache_hit) AS cache_hits,
CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round((sum(tokens_in) * 3.0 + sum(tokens_out) * 15.0) / 1000000, 6)::DOUBLE AS estimated_cost FROM st GROUP BY run_id""")
def run_metrics(spark, d):
    return runs.run_metrics(corpus.stages(spark, d))


@query(f"{STAGES}, r AS (SELECT run_id, stage, duration_ms, CAST(row_number() OVER (PARTITION BY run_id ORDER BY duration_ms DESC, stage) AS INTEGER) AS rank FROM st WHERE duration_ms > 0) SELECT run_id, rank, stage, duration_ms FROM r WHERE rank <= 8")
def slowest_stages(spark, d):
    return runs.slowest(corpus.stages(spark, d))


@query(f"{STAGES} SELECT run_id, coalesce(arg_min(stage, sort_order) FILTER (status = 'running'), arg_max(stage, sort_order) FILTER (status = 'completed'), 'idle') AS current_stage FROM st GROUP BY run_id")
def current_stages(spark, d):
    return runs.current_stage(corpus.stages(spark, d))


@query(f"""{STAGES}, c AS (SELECT run_id, coalesce(arg_min(stage, sort_order) FILTER (status = 'running'), arg_max(stage, sort_order) FILTER (status = 'completed'), 'idle') AS current_stage, coalesce(bool_or(can_render), false) AS can_render FROM st GROUP BY run_id)
SELECT c.*, status, n FROM c JOIN (SELECT run_id, status, count(*) AS n FROM st GROUP BY ALL) USING (run_id)""")
def stage_overviews(spark, d):
    return runs.stage_overview(corpus.stages(spark, d))


@query(f"{STAGES} SELECT run_id, status, count(*) AS n FROM st GROUP BY ALL")
def stage_status_counts(spark, d):
    return corpus.stages(spark, d).groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"{STAGES}, l AS (SELECT run_id, sort_order, status, lag(status) OVER (PARTITION BY run_id ORDER BY moment) AS before FROM st) SELECT run_id, sort_order, status AS payload FROM l WHERE status IS DISTINCT FROM before")
def progress_changes(spark, d):
    s = corpus.stages(spark, d)
    return runs.changes(s.select("run_id", "sort_order", "at", F.col("status").alias("payload"))).select("run_id", "sort_order", "payload")


@query(f"{STAGES} SELECT run_id, event_type AS stage, arg_max(status, moment) AS status, arg_max(sort_order, moment) AS sort_order FROM st GROUP BY ALL")
def latest_stages(spark, d):
    s = corpus.stages(spark, d).drop("stage").withColumnRenamed("event_type", "stage")
    return runs.latest(s.select("run_id", "stage", "status", "sort_order", "at")).select("run_id", "stage", "status", "sort_order")


# anchors and orientation

def _rules_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    label = {"python_main_guard": "'Python module entrypoint'", "cli_library_signal": "'CLI command setup'"}
    label |= {k: f"concat(upper(regexp_extract(text, '{quoted(p)}', 1)), ' ', regexp_extract(text, '{quoted(p)}', 2))" for k, p in anchors.ROUTES.items()}
    parts = []
    for i, r in enumerate(anchors.RULES):
        roles = ", ".join(f"'{x}'" for x in r.without)
        line, group = ("min(line) AS line", "GROUP BY path") if r.first else ("line", "")
        beside = f" AND path IN (SELECT path FROM lines WHERE regexp_matches(text, '{quoted(r.beside)}') OR regexp_matches(path, '{quoted(r.beside)}'))" if r.beside else ""
        parts.append(f"SELECT {i} AS rule, '{r.kind}' AS kind, '{r.method}' AS method, {r.confidence}::DOUBLE AS confidence, path, {line}, {label.get(r.method, 'path')} AS label FROM lines WHERE role NOT IN ({roles}) AND regexp_matches(text, '{quoted(r.pattern)}'){beside} {group}")
    return " UNION ALL ".join(parts)


ANCHORS = f"""{FILES}, hits AS ({_rules_sql()}), ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, path, line, lower(label) ORDER BY confidence DESC, rule) AS r FROM hits),
anchors AS (SELECT kind, path, line, label, method, confidence, CASE WHEN confidence >= 0.7 THEN 'source_detected' ELSE 'candidate' END AS status FROM ranked WHERE r = 1)"""


@query(f"{ANCHORS} SELECT * FROM anchors")
def semantic_anchors(spark, d):
    return anchors.line_anchors(corpus.lines(spark, d))


@query(f"{ANCHORS} SELECT kind, status, count(*) AS n FROM anchors GROUP BY ALL")
def anchor_counts(spark, d):
    return anchors.line_anchors(corpus.lines(spark, d)).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


PAGES = """WITH p AS (SELECT page_id, html, regexp_extract(lower(url), '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages)"""


@query(PAGES + " SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(left(html, 20000)), '{anchors._B}{s}s?{anchors._E}') THEN '{s}' END" for s in anchors.SIGNALS) + "], lambda x: x IS NOT NULL), ',') AS signals FROM p")
def page_signals(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", F.array_join(anchors.signals(F.col("html")), ",").alias("signals"))


@query(f"{FILES} SELECT path, CASE WHEN role = 'docs' AND language IN ('markdown', 'rst', 'text') THEN 'docs_page' WHEN language IN ('text', 'rst') THEN 'text_note' END AS kind, CAST(CASE WHEN role = 'docs' THEN 2 ELSE 6 END AS INTEGER) AS priority FROM files WHERE role = 'docs' OR language = 'text'")
def orientation_inventory(spark, d):
    return anchors.orientation(corpus.files(spark, d)).select("path", "kind", "priority")


# node and edge queries of the API

@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_type = 'ECONOMY' AND p_name LIKE 'small%' ORDER BY p_name, p_partkey LIMIT 10 OFFSET 5")
def node_query(spark, d):
    p = corpus.table(spark, d, "part").filter("p_type = 'ECONOMY' and p_name like 'small%'")
    return p.orderBy("p_name", "p_partkey").offset(5).limit(10).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query(f"{GRAPH} SELECT sg AS source_group, kind, count(*) AS n FROM edges WHERE status = 'partial' AND sg <> tg GROUP BY ALL")
def partial_edges(spark, d):
    r = corpus.relations(spark, d).filter("status = 'partial'")
    e = graph.lifted(r, corpus.symbols(spark, d), corpus.modules(spark, d), "leaf")
    return e.filter("source_group <> target_group").groupBy("source_group", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), s AS (SELECT min(a) AS node FROM pairs HAVING min(a) IS NOT NULL), h AS (SELECT node, 0 AS depth FROM s UNION SELECT w.b, depth + 1 FROM h JOIN w ON w.a = h.node WHERE depth < 4)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM h GROUP BY node""")
def traverse(spark, d):
    e = _affinity(spark, d).select("a", "b")
    return graph.hops(e, e.agg(F.min("a").alias("node")), 4)


@query(f"""{GRAPH}, e AS (SELECT sg, tg FROM edges WHERE status = 'resolved'), i AS (SELECT sg AS g, count(*) AS internal FROM e WHERE sg = tg GROUP BY sg), o AS (SELECT g, count(*) AS outer_ FROM (SELECT sg AS g FROM e WHERE sg <> tg UNION ALL SELECT tg FROM e WHERE sg <> tg) GROUP BY g)
SELECT o.g AS group_id, coalesce(internal, 0) AS internal, outer_ AS boundary, round(coalesce(internal, 0) / (coalesce(internal, 0) + outer_), 6) AS cohesion FROM o LEFT JOIN i ON o.g = i.g""")
def component_cohesion(spark, d):
    e = _edges(spark, d)
    cross = e.filter("source_group <> target_group")
    ends = cross.select(F.explode(F.array("source_group", "target_group")).alias("group_id")).groupBy("group_id").agg(F.count(F.lit(1)).alias("boundary"))
    inner = graph.internal_counts(e).groupBy("group_id").agg(F.sum("relation_count").alias("internal"))
    df = ends.join(inner, "group_id", "left").withColumn("internal", F.coalesce("internal", F.lit(0)).cast("long"))
    return df.select("group_id", "internal", "boundary", F.round(F.col("internal") / (F.col("internal") + F.col("boundary")), 6).alias("cohesion"))


@query(f"""{GRAPH}, e AS (SELECT sg, tg, kind, count(*) AS c FROM edges WHERE status = 'resolved' AND sg <> tg GROUP BY ALL), m AS (SELECT least(6, max(c)) AS least_ FROM e) SELECT sg AS source_group, tg AS target_group, kind, c AS relation_count FROM e, m WHERE c >= least_ AND c > 0""")
def strongest_edges(spark, d):
    e = durable(graph.aggregate_edges(_edges(spark, d)).select("source_group", "target_group", "kind", "relation_count"))
    most = e.agg(F.max("relation_count").alias("most")).select(F.lit(1).alias("one"), "most")
    return e.withColumn("one", F.lit(1)).join(F.broadcast(most), "one").filter(F.col("relation_count") >= F.least(F.lit(6), "most")).drop("one", "most")  # one row


@query("""WITH x AS (SELECT n_name AS grp, s_name AS member, row_number() OVER (PARTITION BY n_name ORDER BY s_name) AS r, count(*) OVER (PARTITION BY n_name) AS members FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT grp AS group_id, members, array_to_string(list(member ORDER BY member) FILTER (r <= 4), ',') AS previews FROM x GROUP BY grp, members""")
def member_previews(spark, d):
    from pyspark.sql import Window

    m = corpus.modules(spark, d).select(F.col("leaf").alias("group_id"), F.element_at(F.split("path", "/"), -1).alias("member"))
    r = F.row_number().over(Window.partitionBy("group_id").orderBy("member"))
    g = m.withColumn("r", r).groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.sort_array(F.collect_list(F.when(F.col("r") <= 4, F.col("member")))).alias("p"))
    return g.select("group_id", "members", F.array_join("p", ",").alias("previews"))


@query("SELECT c_custkey AS id, c_nationkey AS parent, n_name AS title, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS children FROM customer JOIN nation ON c_nationkey = n_nationkey")
def docs_hierarchy(spark, d):
    c, n, o = (corpus.table(spark, d, x) for x in ("customer", "nation", "orders"))
    kids = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"))
    df = c.join(n, c.c_nationkey == n.n_nationkey).join(kids, "c_custkey", "left")
    return df.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), F.col("n_name").alias("title"), F.coalesce("k", F.lit(0)).cast("long").alias("children"))
