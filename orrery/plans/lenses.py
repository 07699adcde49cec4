"""Queries over what a reader is shown: slices, lens steps, explanations, answers and texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import lenses
from orrery.plans import corpus
from orrery.plans.catalog import query

table = corpus.table

REGIONS = """regions AS (SELECT l_suppkey AS node, l_orderkey * 10 + l_linenumber AS region, concat('src/f', l_partkey % 97, '.py') AS path,
  CAST(l_linenumber AS BIGINT) AS start_line, CAST(l_linenumber + l_quantity AS BIGINT) AS end_line, l_orderkey * 10 + l_linenumber AS place FROM lineitem),
nodes AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 2 = 0 THEN 'verified' ELSE 'candidate' END AS status FROM customer)"""


def _regions(spark, d):
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    path = F.concat(F.lit("src/f"), (F.col("l_partkey") % 97).cast("string"), F.lit(".py"))
    end = (F.col("l_linenumber") + F.col("l_quantity")).cast("long")
    # nodes go by customers' numbers, of which there are more than of suppliers: the others have no region
    li = table(spark, d, "lineitem")
    regions = li.select(F.col("l_suppkey").alias("node"), place.alias("region"), path.alias("path"), F.col("l_linenumber").cast("long").alias("start_line"), end.alias("end_line"), place.alias("place"))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 2 == 0, "verified").otherwise("candidate").alias("status"))
    return regions, nodes


@query(f"""WITH {REGIONS}, f AS (SELECT node, path, count(*) AS n, row_number() OVER (PARTITION BY node ORDER BY min(place), path) AS tab FROM regions GROUP BY node, path),
h AS (SELECT *, row_number() OVER (PARTITION BY node, path ORDER BY place, region, start_line, end_line) AS rank FROM regions)
SELECT node, CAST(tab AS INTEGER) AS tab, CASE WHEN tab = 1 THEN 'primary' ELSE 'supporting' END AS role, path, concat(n, ' highlighted source region(s).') AS summary,
  CAST(rank AS INTEGER) AS rank, region, start_line, end_line, CASE status WHEN 'verified' THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence
FROM h JOIN f USING (node, path) JOIN nodes USING (node) WHERE tab <= 5 AND rank <= 20""")
def implementation_slices(spark, d):
    return lenses.slices(*_regions(spark, d))


@query(f"""WITH {REGIONS}, f AS (SELECT node, arg_min(region, place) AS region FROM regions GROUP BY node)
SELECT node, CASE WHEN region IS NULL THEN 'insufficient' ELSE status END AS status, region AS primary_span,
  CASE WHEN region IS NULL THEN 0.0 WHEN status = 'verified' THEN 1.0 ELSE 0.5 END::DOUBLE AS strength,
  CASE WHEN region IS NULL THEN 'no_source_regions' ELSE '' END AS unsupported_reason FROM nodes LEFT JOIN f USING (node)""")
def slice_heads(spark, d):
    return lenses.slice_heads(*_regions(spark, d))


@query("""SELECT c_custkey AS "group", coalesce(avg(CASE left(o_orderpriority, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.65 WHEN '3' THEN 0.35 WHEN '4' THEN 0.65 WHEN '5' THEN 0.0 END::DOUBLE), 0) AS confidence
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def mean_confidence(spark, d):
    names = F.array(*map(F.lit, ["verified", "inferred", "uncertain", "orientation_only", "contradicted"]))
    status = F.element_at(names, F.substring("o_orderpriority", 1, 1).cast("int"))
    claims = table(spark, d, "orders").select(F.col("o_custkey").alias("group"), status.alias("status"))
    return lenses.mean_confidence(claims, table(spark, d, "customer").select(F.col("c_custkey").alias("group")))


@query("""SELECT l_orderkey AS child, p_partkey AS region, concat('src/', p_brand) AS path, CAST(p_size AS BIGINT) AS start_line, CAST(p_size + 5 AS BIGINT) AS end_line,
  left(repeat(concat(p_name, ' '), p_size), 200) AS preview, CASE l_returnflag WHEN 'N' THEN 'verified' ELSE 'uncertain' END AS status, CAST(l_discount AS DOUBLE) AS confidence,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('step ', l_orderkey) ELSE concat('label ', l_orderkey) END AS reason FROM lineitem JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = p_partkey""")
def lens_steps(spark, d):
    li = table(spark, d, "lineitem")
    order = F.col("l_orderkey").cast("string")
    children = li.select(
        F.col("l_orderkey").alias("child"), F.concat(F.lit("label "), order).alias("label"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("step "), order)).otherwise("").alias("summary"),
        F.when(F.col("l_returnflag") == "N", "verified").otherwise("uncertain").alias("status"), F.col("l_discount").cast("double").alias("confidence"), F.col("l_partkey").alias("region"),
    )
    # parts without a customer of their number are regions that are not known
    p = table(spark, d, "part").join(table(spark, d, "customer").select(F.col("c_custkey").alias("p_partkey")), "p_partkey")
    size = F.col("p_size").cast("long")
    regions = p.select(F.col("p_partkey").alias("region"), F.concat(F.lit("src/"), "p_brand").alias("path"), size.alias("start_line"), (size + 5).alias("end_line"), F.expr("repeat(concat(p_name, ' '), p_size)").alias("text"))
    return lenses.steps(children, regions)


@query("""WITH f AS (SELECT l_suppkey AS component, concat('src/', p_brand) AS path, arg_min(l_partkey, (l_orderkey * 10 + l_linenumber, l_partkey)) AS region FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT component, concat('lens-child:', substring(sha1(concat_ws('|', component, path)), 1, 24)) AS id, path, region, concat('Source-backed file group for c', component, '.') AS summary, 'uncertain' AS status, 0.35::DOUBLE AS confidence FROM f""")
def lens_file_groups(spark, d):
    named = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("component"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("label"), F.col("l_partkey").alias("region"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return lenses.file_groups(named, table(spark, d, "part").select(F.col("p_partkey").alias("region"), F.concat(F.lit("src/"), "p_brand").alias("path")))


@query("""WITH t AS (SELECT DISTINCT p_type, p_brand, p_size FROM part), ch AS (SELECT p_type AS child, p_type AS label, concat('src/size', min(p_size), '.py') AS path FROM t GROUP BY p_type),
cl AS (SELECT p_partkey AS claim, concat(p_name, ' ', CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE '' END) AS text, concat('lib/size', p_size, '.go') AS path FROM part),
terms AS (SELECT child, unnest(list_distinct(regexp_extract_all(lower(label), '[a-z0-9]{3,}'))) AS term FROM ch),
words AS (SELECT claim, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS term FROM cl),
cp AS (SELECT child, unnest(list_distinct(regexp_extract_all(lower(path), '[a-z0-9]{3,}'))) AS term FROM ch),
rp AS (SELECT claim, unnest(list_distinct(regexp_extract_all(lower(path), '[a-z0-9]{3,}'))) AS term FROM cl),
hit AS (SELECT child, claim FROM terms JOIN words USING (term) UNION SELECT child, claim FROM cp JOIN rp USING (term)) SELECT DISTINCT child, claim * 7 AS region FROM hit""")
def claim_regions(spark, d):
    p = table(spark, d, "part")
    path = lambda head, n, tail: F.concat(F.lit(head), n.cast("string"), F.lit(tail))
    children = p.groupBy(F.col("p_type").alias("child")).agg(F.array(path("src/size", F.min("p_size"), ".py")).alias("paths")).withColumn("label", F.col("child"))
    claims = p.select(F.col("p_partkey").alias("claim"), F.concat("p_name", F.lit(" "), F.when(F.col("p_partkey") % 9 == 0, F.col("p_type")).otherwise("")).alias("text"))
    citations = p.select(F.col("p_partkey").alias("claim"), (F.col("p_partkey") * 7).alias("region"), path("lib/size", F.col("p_size"), ".go").alias("path"))
    return lenses.claim_regions(children, claims, citations)


SYMS = """syms AS (SELECT concat('n', n_nationkey) AS id, NULL AS parent, 'class' AS kind, n_name AS name, n_name AS qualified_name, concat('src/', n_name, '.py') AS path, 1::BIGINT AS start_line, 9::BIGINT AS end_line, '' AS signature FROM nation
UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 'async_method', concat('m', c_custkey), concat('q.m', c_custkey), concat('src/', n_name, '.py'), c_custkey, c_custkey + 3, concat('m', c_custkey, '(self)') FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
LISTED = """listed AS (SELECT {0} AS k, string_agg(concat('  - ', kind, ' ', name, ' (lines ', start_line, '-', end_line, ')'), chr(10) ORDER BY r) FILTER (r <= 20) AS body, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY start_line, name) AS r FROM syms WHERE {1}) GROUP BY 1),
many AS (SELECT k, concat(body, CASE WHEN n > 20 THEN concat(chr(10), '  - ... and ', n - 20, ' more') ELSE '' END) AS body FROM listed)"""


def _symbols(spark, d):
    text = lambda head, c, tail="": F.concat(F.lit(head), F.col(c).cast("string"), F.lit(tail))
    n = table(spark, d, "nation")
    path = text("src/", "n_name", ".py").alias("path")
    one = n.select(
        text("n", "n_nationkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("class").alias("kind"), F.col("n_name").alias("name"), F.col("n_name").alias("qualified_name"), path,
        F.lit(1).cast("long").alias("start_line"), F.lit(9).cast("long").alias("end_line"), F.lit("").alias("signature"),
    )
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    two = c.select(
        text("c", "c_custkey").alias("id"), text("n", "c_nationkey").alias("parent"), F.lit("async_method").alias("kind"), text("m", "c_custkey").alias("name"), text("q.m", "c_custkey").alias("qualified_name"), path,
        F.col("c_custkey").alias("start_line"), (F.col("c_custkey") + 3).alias("end_line"), text("m", "c_custkey", "(self)").alias("signature"),
    )
    return one.unionByName(two)


@query(f"""WITH {SYMS}, {LISTED.format("parent", "parent IS NOT NULL")}
SELECT s.id, concat_ws(chr(10), concat('kind: ', s.kind), concat('name: ', s.name), concat('qualified_name: ', s.qualified_name), concat('path: ', s.path), concat('lines: ', s.start_line, '-', s.end_line),
  concat('signature: ', CASE WHEN s.signature = '' THEN s.name ELSE s.signature END), 'declared inside: ' || p.kind || ' ' || p.qualified_name, 'contains:' || chr(10) || m.body) AS facts
FROM syms s LEFT JOIN syms p ON p.id = s.parent LEFT JOIN many m ON m.k = s.id""")
def symbol_facts(spark, d):
    return lenses.symbol_facts(_symbols(spark, d))


@query(f"""WITH {SYMS}, {LISTED.format("path", "parent IS NOT NULL")}
SELECT path, concat_ws(chr(10), 'kind: module', concat('path: ', path), 'parser-derived summary: ' || nullif(summary, ''), coalesce('top-level declarations:' || chr(10) || body, 'top-level declarations: (none parsed)')) AS facts
FROM (SELECT concat('src/', n_name, '.py') AS path, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS summary FROM nation UNION ALL SELECT concat('lib/', r_name, '.py'), r_name FROM region) LEFT JOIN many ON k = path""")
def module_facts(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("src/"), "n_name", F.lit(".py")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("n_name")).alias("summary"))
    # modules of regions have no declaration
    r = table(spark, d, "region").select(F.concat(F.lit("lib/"), "r_name", F.lit(".py")).alias("path"), F.col("r_name").alias("summary"))
    return lenses.module_facts(n.unionByName(r), _symbols(spark, d).filter("parent is not null"))


@query(f"""WITH {SYMS}, s AS (SELECT id, concat(CASE kind WHEN 'class' THEN 'Class' ELSE 'Async Method' END, ' `', qualified_name, '` is declared in `', path, '` at lines ', start_line, '-', end_line, '.') AS summary, coalesce(nullif(signature, ''), name) AS sig FROM syms)
SELECT id, summary, concat(summary, chr(10), chr(10), 'Source declaration: `', sig, '`. No separate authored component documentation was found; the source below is authoritative.') AS documentation FROM s""")
def symbol_documentation(spark, d):
    return lenses.declarations(_symbols(spark, d))


@query("""WITH r AS (SELECT o_custkey, concat('[', o_orderstatus, '] order ', o_orderkey) AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT c_custkey AS "group", coalesce(string_agg(concat('- ', text), chr(10) ORDER BY r) FILTER (r <= 15), '(no claims in overview)') AS body FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY c_custkey""")
def claim_lists(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("place"), F.concat(F.lit("["), "o_orderstatus", F.lit("] order "), F.col("o_orderkey").cast("string")).alias("text"))
    return lenses.bullets(table(spark, d, "customer").select(F.col("c_custkey").alias("group")), rows, "(no claims in overview)", 15)


@query(f"""WITH {REGIONS}, e AS (SELECT node, least(count(*), 40) AS evidence FROM regions GROUP BY node), n AS (SELECT s_suppkey AS node, s_name AS description, status, coalesce(evidence, 0) AS evidence FROM supplier JOIN nodes ON node = s_suppkey LEFT JOIN e USING (node)),
duty AS (SELECT p_partkey % 13 AS node, p_name AS text FROM part)
SELECT node, 'responsibility' AS part, text, CASE status WHEN 'candidate' THEN 'inferred' ELSE status END AS support, evidence FROM n JOIN duty USING (node)
UNION ALL SELECT node, 'responsibility', description, CASE WHEN evidence > 0 THEN status ELSE 'insufficient' END, evidence FROM n WHERE node NOT IN (SELECT node FROM duty)
UNION ALL SELECT node, 'what_happens', concat(evidence, ' source-backed evidence item(s) support this node.'), CASE WHEN evidence > 0 THEN 'verified' ELSE 'insufficient' END, evidence FROM n""")
def node_explanations(spark, d):
    regions, nodes = _regions(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("description"))
    duties = table(spark, d, "part").select((F.col("p_partkey") % 13).alias("node"), F.col("p_name").alias("text"))
    return lenses.explanations(s.join(nodes, "node"), regions.select("node", F.col("region").alias("id")), duties)


@query(f"""WITH a AS (SELECT o_custkey AS q, concat('area', o_orderkey) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT o_custkey AS q, concat('order ', o_orderkey) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 = 0),
x AS (SELECT q, string_agg(t, ', ' ORDER BY r) AS areas FROM a WHERE r <= 5 GROUP BY q), y AS (SELECT q, string_agg(t, '; ' ORDER BY r) AS findings FROM c WHERE r <= 5 GROUP BY q)
SELECT c_custkey AS question, coalesce(nullif(concat_ws(' ', 'Based on the System Overview, the relevant architecture areas are: ' || areas || '.', 'Key findings: ' || findings), ''), '{lenses.NO_ANSWER}') AS answer,
  CASE WHEN findings IS NULL THEN 0.35 ELSE 0.55 END::DOUBLE AS confidence FROM customer LEFT JOIN x ON x.q = c_custkey LEFT JOIN y ON y.q = c_custkey""")
def overview_answers(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "question").withColumnRenamed("o_orderkey", "place")
    areas = o.filter("o_orderstatus = 'F'").select("question", F.concat(F.lit("area"), F.col("place").cast("string")).alias("label"), "place")
    claims = o.filter("o_orderstatus = 'O' and question % 3 = 0").select("question", F.concat(F.lit("order "), F.col("place").cast("string")).alias("text"), "place")
    return lenses.answers(table(spark, d, "customer").select(F.col("c_custkey").alias("question")), areas, claims)


@query("""WITH l AS (SELECT l_orderkey AS o, count(*) AS e, max(l_discount) AS c FROM lineitem GROUP BY l_orderkey)
SELECT c_custkey AS question, count(o) AS lens_count, CAST(coalesce(sum(e), 0) AS BIGINT) AS evidence_count, CAST(coalesce(max(c), 0) AS DOUBLE) AS confidence FROM customer LEFT JOIN (SELECT * FROM orders JOIN l ON o = o_orderkey) ON o_custkey = c_custkey GROUP BY c_custkey""")
def evidence_coverage(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("evidence"), F.max("l_discount").cast("double").alias("confidence"))
    rows = table(spark, d, "orders").join(per, "o_orderkey").select(F.col("o_custkey").alias("question"), "evidence", "confidence")
    return lenses.coverage(table(spark, d, "customer").select(F.col("c_custkey").alias("question")), rows)


@query("""WITH i AS (SELECT user_id AS run, sha1(concat_ws('|', event_id, event_type)) AS h FROM events),
s AS (SELECT run, count(*) AS n, sum(CAST(concat('0x', substring(h, 1, 15)) AS BIGINT)) AS a, sum(CAST(concat('0x', substring(h, 16, 15)) AS BIGINT)) AS b FROM i GROUP BY run)
SELECT run, sha1(concat_ws('|', 'none', 'no_model', run, n, a, b)) AS key FROM s""")
def overview_input_keys(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("item"))
    return lenses.input_keys(e, "none", "no_model")
