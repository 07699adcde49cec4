"""Queries over claims that paths of relations prove, over replies of proposers, and over lines that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.lineage import durable
from orrery.operators import claims
from orrery.plans import corpus
from orrery.plans.catalog import RELATIONS, query

table = corpus.table

#: Fourth lines belong to another run. A claim follows an order's symbols; those of open orders with a low priority are refuted by the order's relations.
CLAIMS = f"""WITH {RELATIONS}, own AS (SELECT *, CASE WHEN line = 4 THEN 'other' ELSE 'run' END AS run_id, CAST(split_part(source, ':', 2) AS BIGINT) AS okey FROM rels),
o AS (SELECT l_orderkey AS okey, list(concat('s:', l_orderkey, ':', l_suppkey) ORDER BY l_linenumber, l_suppkey) AS path FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2),
p AS (SELECT o.okey, path, CASE WHEN len(path) = 2 THEN 'direct_relation' ELSE 'reachability' END AS proposition, CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '5%' THEN (SELECT coalesce(list_sort(list(id)), []) FROM own WHERE own.okey = o.okey) END AS refuted
  FROM o JOIN (SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority FROM orders) ON o_orderkey = o.okey),
h AS (SELECT okey, unnest(range(0, len(path) - 1)) AS k, unnest(path[1:len(path) - 1]) AS a, unnest(path[2:]) AS b FROM p),
m AS (SELECT h.okey, k, a, b, min(own.id) AS id FROM h LEFT JOIN own ON source = a AND target = b AND kind = 'calls' AND status = 'resolved' AND run_id = 'run' GROUP BY ALL),
g AS (SELECT okey, count(*) AS n, min(k) FILTER (id IS NULL) AS gap FROM m GROUP BY okey), v AS (SELECT g.*, m.a AS ga, m.b AS gb, coalesce((SELECT list(id ORDER BY k) FROM m x WHERE x.okey = g.okey AND x.k < coalesce(gap, n)), []) AS chain FROM g LEFT JOIN m ON m.okey = g.okey AND m.k = gap),
f AS (SELECT DISTINCT p.okey FROM p JOIN own ON own.okey = p.okey WHERE refuted IS NOT NULL AND run_id = 'other'),
made AS (SELECT p.okey AS claim, concat('claim:', substring(sha1(concat_ws('|', 'run', 'observed', proposition, path[1], 'calls', path[-1], CASE proposition WHEN 'reachability' THEN array_to_string(path, ',') ELSE '' END)), 1, 24)) AS claim_id,
  CASE proposition WHEN 'reachability' THEN concat(path[1], ' reaches ', path[-1], ' through a call path.') ELSE concat(path[1], ' calls ', path[-1], '.') END AS statement,
  CASE WHEN refuted IS NULL THEN CASE WHEN gap IS NULL THEN 'supported' ELSE 'insufficient_evidence' END WHEN len(refuted) = 0 OR f.okey IS NOT NULL THEN 'rejected' ELSE 'contradicted' END AS support_status,
  CASE WHEN refuted IS NULL THEN CASE WHEN gap IS NULL THEN '' WHEN proposition = 'direct_relation' THEN concat('no resolved ''calls'' relation directly connects ''', path[1], ''' to ''', path[2], ''' (a multi-hop path, or a partial/unresolved relation, does not satisfy a direct_relation proposition)')
      ELSE concat('no resolved ''calls'' relation found for hop ''', ga, ''' -> ''', gb, '''; ', gap, '/', n, ' preceding hop(s) were matched before this gap') END
    WHEN len(refuted) = 0 THEN 'cannot assert support_status=''contradicted'' with zero evidence items' WHEN f.okey IS NOT NULL THEN 'relation of another run' ELSE 'caller-asserted contradiction (see assert_contradicted=True); not adapter-detected' END AS reasoning,
  CASE WHEN refuted IS NULL THEN chain WHEN f.okey IS NOT NULL THEN [] ELSE refuted END AS chain FROM p JOIN v ON v.okey = p.okey LEFT JOIN f ON f.okey = p.okey)"""


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return durable(corpus.relations(spark, d).withColumn("run_id", F.when(F.col("line") == 4, "other").otherwise("run")))


def _made(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _relations(spark, d)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", corpus.symbol_id("l_orderkey", "l_suppkey").alias("s"))
    p = li.groupBy(F.col("l_orderkey").alias("claim")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "s"))), lambda x: x["s"]).alias("path")).filter(F.size("path") >= 2)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim"), ((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("5")).alias("against")).distinct()
    ids = r.groupBy(F.split("source", ":")[1].cast("long").alias("claim")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    p = p.join(o, "claim").join(ids, "claim", "left")
    kind = F.when(F.size("path") == 2, "direct_relation").otherwise("reachability")
    p = p.select("claim", kind.alias("proposition"), F.lit("calls").alias("kind"), "path", F.when(F.col("against"), F.coalesce("ids", F.array().cast("array<string>"))).alias("refuted"))
    return claims.claims(p, r), r


@query(f"{CLAIMS} SELECT claim, claim_id, statement, support_status, 'observed' AS epistemic_type, reasoning, array_to_string(chain, ',') AS chain FROM made")
def path_claims(spark, d):
    """Direct and reachability claims with their verdicts; contradictions that a caller brings go through, or are rejected."""
    made, _ = _made(spark, d)
    return made.withColumn("chain", F.array_join("chain", ","))


@query(f"""{CLAIMS}, c AS (SELECT claim, unnest(range(0, len(chain))) AS hop, unnest(chain) AS id FROM made), reg AS (SELECT DISTINCT concat('p', l_orderkey) AS path, CAST(l_linenumber AS BIGINT) AS line, concat('region:', l_orderkey, ':', l_linenumber) AS region FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT claim, CAST(hop AS INTEGER) AS hop, c.id AS relation, source, anytarget AS target, kind, region FROM c JOIN own ON own.id = c.id LEFT JOIN reg ON reg.path = concat('p', own.okey) AND reg.line = own.line""")
def claim_chains(spark, d):
    made, r = _made(spark, d)
    n = F.col("l_linenumber")
    regions = table(spark, d, "lineitem").select(F.concat(F.lit("region:"), F.col("l_orderkey"), F.lit(":"), n).alias("region_id"), F.concat(F.lit("p"), F.col("l_orderkey")).alias("path"), n.cast("long").alias("start_line"), (n + n % 2).cast("long").alias("end_line")).distinct()
    return claims.chains(made, r.withColumn("path", F.concat(F.lit("p"), F.split("source", ":")[1])), regions)


#: A reply for each symbol that comes first in an order: good proposals beside broken ones.
REPLIES = f"""WITH RECURSIVE {RELATIONS}, own AS (SELECT *, CASE WHEN line = 4 THEN 'other' ELSE 'run' END AS run_id FROM rels), mine AS (SELECT * FROM own WHERE run_id = 'run'),
far AS (SELECT a.source AS target, a.kind, a.anytarget AS mid, b.anytarget AS last FROM mine a JOIN mine b ON b.source = a.anytarget AND b.kind = a.kind WHERE a.line = 1 AND b.line = 2 AND a.anytarget <> a.source AND b.anytarget <> a.anytarget),
asked AS (SELECT target, kind, mid, last, row_number() OVER (PARTITION BY target ORDER BY kind, mid, last) AS k FROM far QUALIFY k = 1),
e AS (SELECT source AS a, target AS b FROM mine WHERE target IS NOT NULL UNION SELECT target, source FROM mine WHERE target IS NOT NULL),
shown AS (SELECT target, target AS entity FROM asked UNION SELECT target, e.b FROM asked JOIN e ON e.a = target UNION SELECT target, f.b FROM asked JOIN e ON e.a = target JOIN e f ON f.a = e.b
  UNION SELECT target, s.id FROM asked JOIN (SELECT DISTINCT concat('s:', l_orderkey, ':', l_suppkey) AS id, l_orderkey FROM lineitem) s ON concat('s:', s.l_orderkey) = regexp_extract(target, '^s:[0-9]+') WHERE split_part(target, ':', 3)::BIGINT % 2 = 0 AND split_part(s.id, ':', 3)::BIGINT % 2 = 0
  UNION SELECT target, regexp_extract(target, '^s:[0-9]+') FROM asked WHERE split_part(target, ':', 3)::BIGINT % 2 = 0),
items AS (SELECT target, 0 AS item, 'direct_relation' AS proposition, kind, [target, mid] AS path FROM asked UNION ALL SELECT target, 1, 'reachability', kind, [target, mid, last] FROM asked UNION ALL SELECT target, 2, 'direct_relation', kind, [target, 's:none'] FROM asked),
used AS (SELECT DISTINCT target, item, unnest(path) AS entity FROM items), strange AS (SELECT DISTINCT target, item FROM used u WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.target = u.target AND s.entity = u.entity)),
kept AS (SELECT i.* FROM items i WHERE NOT EXISTS (SELECT 1 FROM strange s WHERE s.target = i.target AND s.item = i.item)),
hop AS (SELECT target, item, kind, unnest(range(0, len(path) - 1)) AS n, unnest(path[1:len(path) - 1]) AS a, unnest(path[2:]) AS b FROM kept)"""


def _replies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    r = _relations(spark, d)
    own = r.filter("run_id = 'run'").select("source", "kind", F.coalesce("target", "target_reference").alias("to"), "line")
    b = own.filter("line = 2").select(F.col("source").alias("to"), "kind", F.col("to").alias("last")).distinct()
    far = own.filter("line = 1 and source <> to").join(b, ["to", "kind"]).filter("to <> last").groupBy(F.col("source").alias("target")).agg(F.min(F.struct("kind", F.col("to").alias("mid"), "last")).alias("x")).select("target", "x.*")
    far = durable(far)  # replies are read in many places
    item = lambda kind, to, path: F.to_json(F.struct(F.struct(F.lit(kind).alias("kind"), F.col("target").alias("subject_entity_id"), F.col("kind").alias("relation_kind"), to.alias("object_entity_id"), path.alias("path_entity_ids")).alias("proposition")))
    no = F.lit(None).cast("array<string>")
    broken = ['{"proposition": {"kind": "direct_relation"}}', '{"proposition": {"kind": "guess", "subject_entity_id": "a", "relation_kind": "calls", "object_entity_id": "b"}}', '"text"', "7", '{"proposition": 3}', '{"other": 1}']
    parts = [item("direct_relation", F.col("mid"), no), item("reachability", F.col("last"), F.array("target", "mid", "last")), item("direct_relation", F.lit("s:none"), no), *map(F.lit, broken)]
    good = far.select("target", F.concat(F.lit('{"proposals": ['), F.concat_ws(", ", *parts), F.lit("]}")).alias("text"))
    bad = far.select(F.concat(F.lit("bad "), "target").alias("target"), F.lit('{"proposals": "none"}').alias("text"))
    symbols = corpus.symbols(spark, d).select("id", F.when(F.col("module") % 2 == 0, F.regexp_extract("id", "^s:[0-9]+", 0)).otherwise(F.lit(None)).alias("parent"))
    every = corpus.symbols(spark, d).select("id", F.regexp_extract("id", "^s:[0-9]+", 0).alias("parent"))
    return good.unionByName(bad), r, symbols, every


@query(f"""{REPLIES}, proof AS (SELECT h.target, h.item, count(*) AS hops, count(k.source) AS hit FROM hop h LEFT JOIN (SELECT DISTINCT source, target AS to_, kind FROM mine WHERE status = 'resolved') k ON k.source = h.a AND k.to_ = h.b AND k.kind = h.kind GROUP BY ALL)
SELECT target, item, CASE WHEN hops = hit THEN 'supported' ELSE 'insufficient_evidence' END AS support_status FROM proof""")
def target_claims(spark, d):
    """Claims from JSON replies about targets, after what names entities that were not shown is left out."""
    replies, r, _, every = _replies(spark, d)
    made, _ = claims.verified_targets(replies, r, _family(every), "run")
    return made.select("target", "item", "support_status")


def _family(every: DataFrame) -> DataFrame:
    """Symbols with their order as parent, for suppliers of even number; others have none and are nobody's siblings."""
    return every.withColumn("parent", F.when(F.element_at(F.split("id", ":"), 3).cast("long") % 2 == 0, F.col("parent")))


@query(f"""{REPLIES}, left_out AS (SELECT target, item, 'entity that was not shown' AS reason FROM strange
  UNION ALL SELECT target, unnest([3, 4, 5, 6, 7, 8]), unnest(['unknown relation', 'unknown kind', 'no object', 'no object', 'no object', 'no proposition']) FROM asked UNION ALL SELECT concat('bad ', target), NULL, 'no list of proposals' FROM asked) SELECT reason, count(*) AS n FROM left_out GROUP BY reason""")
def proposals_left_out(spark, d):
    replies, r, _, every = _replies(spark, d)
    return claims.verified_targets(replies, r, _family(every), "run")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
