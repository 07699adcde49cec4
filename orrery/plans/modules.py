"""Parsing and resolution of modules whose source is written from suppliers: one file each, built on the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.lineage import durable
from orrery.operators import relations
from orrery.plans import corpus
from orrery.plans.catalog import query

#: Lines of a module that builds on the one before it; {k} is its number, {j} the other's, {b} how the base is written, {i} a further import.
BUILT = """from .m{j} import C{j}
{i}

class C{k}({b}):
    def __init__(self, dep: C{j}, plain):
        self.dep = dep
        self.plain = plain
        self.own = C{j}()
    def own_{k}(self):
        return 1
    async def run(self, x):
        self.own_{k}()
        self.dep.own_{j}()
        self.own.own_{j}()
        self.plain.go()
        self.shared()
        super().own_{j}()
        missing()
        y = C{j}()
        y.own_{j}()
        def inner():
            self.own_{k}()
            return y
        return inner
def _hidden(a):
    return C{j}
"""
#: Lines of a module that stands alone.
ALONE = """class C{k}:
    def shared(self):
        return self.own_{k}()
    def own_{k}(self):
        return 1
try:
    import fast
except ImportError:
    class Slow:
        pass
class Child(Slow):
    pass
"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    """path, language, text: every fourth module stands alone; bases are written as a name, by their module, or with a type."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    put = lambda t, **v: _replaced(F.lit(t), v)
    base = F.when(k % 4 == 2, F.concat(F.lit("shop.m"), k - 1, F.lit(".C"), k - 1)).when(k % 4 == 3, F.concat(F.lit("C"), k - 1, F.lit("[int]"))).otherwise(F.concat(F.lit("C"), k - 1))
    also = F.when(k % 4 == 2, F.concat(F.lit("import shop.m"), k - 1)).otherwise("")
    source = F.when(k % 4 == 0, put(ALONE, k=text(k))).otherwise(put(BUILT, k=text(k), j=text(k - 1), b=base, i=also))
    # a row is a few bytes and makes a source to be parsed, so rows are dealt out before: as read they would be one task
    dealt = corpus.table(spark, d, "supplier").select("s_suppkey").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    return dealt.select(F.concat(F.lit("shop/m"), k, F.lit(".py")).alias("path"), F.lit("python").alias("language"), source.alias("text"))


def _replaced(text, values: dict):
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), value)
    return text


#: What these lines declare: name, kind, first and last line, signature, whether exported, whether async, and the parent.
DECLARED = """s AS (SELECT s_suppkey AS k, s_suppkey - 1 AS j, s_suppkey % 4 AS t, concat('shop/m', s_suppkey, '.py') AS path FROM supplier),
d AS (SELECT k, path, unnest([
    {'n': 'C' || k, 'kind': 'class', 'a': 4, 'b': 24, 'sig': 'class C' || k, 'ex': true, 'asy': false, 'up': NULL}, {'n': 'C' || k || '.__init__', 'kind': 'method', 'a': 5, 'b': 8, 'sig': 'def __init__(self, dep, plain)', 'ex': false, 'asy': false, 'up': 'C' || k},
    {'n': 'C' || k || '.own_' || k, 'kind': 'method', 'a': 9, 'b': 10, 'sig': 'def own_' || k || '(self)', 'ex': false, 'asy': false, 'up': 'C' || k}, {'n': 'C' || k || '.run', 'kind': 'method', 'a': 11, 'b': 24, 'sig': 'async def run(self, x)', 'ex': false, 'asy': true, 'up': 'C' || k},
    {'n': 'C' || k || '.run.inner', 'kind': 'function', 'a': 21, 'b': 23, 'sig': 'def inner()', 'ex': false, 'asy': false, 'up': 'C' || k || '.run'}, {'n': '_hidden', 'kind': 'function', 'a': 25, 'b': 26, 'sig': 'def _hidden(a)', 'ex': false, 'asy': false, 'up': NULL}]) AS x FROM s WHERE t <> 0
  UNION ALL SELECT k, path, unnest([{'n': 'C' || k, 'kind': 'class', 'a': 1, 'b': 5, 'sig': 'class C' || k, 'ex': true, 'asy': false, 'up': NULL}, {'n': 'C' || k || '.shared', 'kind': 'method', 'a': 2, 'b': 3, 'sig': 'def shared(self)', 'ex': false, 'asy': false, 'up': 'C' || k},
    {'n': 'C' || k || '.own_' || k, 'kind': 'method', 'a': 4, 'b': 5, 'sig': 'def own_' || k || '(self)', 'ex': false, 'asy': false, 'up': 'C' || k}, {'n': 'Child', 'kind': 'class', 'a': 11, 'b': 12, 'sig': 'class Child', 'ex': true, 'asy': false, 'up': NULL}]) FROM s WHERE t = 0),
sym AS (SELECT path, x.n AS local_name, concat('python:', path, '::', x.n) AS qualified_name, x.kind AS kind, x.a AS start_line, x.b AS end_line, x.sig AS signature, x.ex AS exported, x.asy AS async_, x.up AS up,
  concat('symbol:', substring(sha1(concat_ws('|', 'run', concat('python:', path, '::', x.n), x.a, x.b)), 1, 24)) AS id FROM d)"""


@query(f"""WITH {DECLARED} SELECT s.id, s.path, s.local_name, s.qualified_name, s.kind, CAST(s.start_line AS BIGINT) AS start_line, CAST(s.end_line AS BIGINT) AS end_line, s.signature, s.exported, s.async_, p.id AS parent_symbol_id,
  concat('entity:', substring(sha1(concat_ws('|', s.path, s.qualified_name, s.kind, s.signature)), 1, 24)) AS stable_entity_key FROM sym s LEFT JOIN sym p ON p.path = s.path AND p.local_name = s.up""")
def python_symbols(spark, d):
    out = relations.symbols(durable(relations.facts(_files(spark, d))))
    return out.select("id", "path", "local_name", "qualified_name", "kind", "start_line", "end_line", "signature", "exported", "async_", "parent_symbol_id", "stable_entity_key")


#: What each call and base means: the symbol it stands in, the line, the text, the target, how it is known; a module before the first is not there.
MEANT = f"""{DECLARED}, e AS (SELECT s.*, o.k IS NOT NULL AS near, s.k - s.t IN (SELECT k FROM s) AS far FROM s LEFT JOIN (SELECT k FROM s) o ON o.k = s.j),
m AS (SELECT path, unnest([
    {{'o': 'C' || k || '.__init__', 'l': 8, 'x': 'C' || j, 'tp': 'shop/m' || j || '.py', 't': 'C' || j, 's': near, 'b': 'name', 'k': 'calls'}}, {{'o': 'C' || k || '.run', 'l': 12, 'x': 'self.own_' || k, 'tp': path, 't': 'C' || k || '.own_' || k, 's': true, 'b': 'name', 'k': 'calls'}},
    {{'o': 'C' || k || '.run', 'l': 13, 'x': 'self.dep.own_' || j, 'tp': 'shop/m' || j || '.py', 't': 'C' || j || '.own_' || j, 's': near, 'b': 'constructor_binding', 'k': 'calls'}},
    {{'o': 'C' || k || '.run', 'l': 14, 'x': 'self.own.own_' || j, 'tp': 'shop/m' || j || '.py', 't': 'C' || j || '.own_' || j, 's': near, 'b': 'direct_construction', 'k': 'calls'}},
    {{'o': 'C' || k || '.run', 'l': 15, 'x': 'self.plain.go', 'tp': NULL, 't': NULL, 's': false, 'b': NULL, 'k': 'calls'}},
    {{'o': 'C' || k || '.run', 'l': 16, 'x': 'self.shared', 'tp': 'shop/m' || (k - t) || '.py', 't': 'C' || (k - t) || '.shared', 's': far, 'b': 'inherited_method', 'k': 'calls'}},
    {{'o': 'C' || k || '.run', 'l': 17, 'x': 'super().own_' || j, 'tp': 'shop/m' || j || '.py', 't': 'C' || j || '.own_' || j, 's': near, 'b': 'static_super', 'k': 'calls'}}, {{'o': 'C' || k || '.run', 'l': 17, 'x': 'super', 'tp': NULL, 't': NULL, 's': false, 'b': NULL, 'k': 'calls'}},
    {{'o': 'C' || k || '.run', 'l': 18, 'x': 'missing', 'tp': NULL, 't': NULL, 's': false, 'b': NULL, 'k': 'calls'}}, {{'o': 'C' || k || '.run', 'l': 19, 'x': 'C' || j, 'tp': 'shop/m' || j || '.py', 't': 'C' || j, 's': near, 'b': 'name', 'k': 'calls'}},
    {{'o': 'C' || k || '.run', 'l': 20, 'x': 'y.own_' || j, 'tp': 'shop/m' || j || '.py', 't': 'C' || j || '.own_' || j, 's': near, 'b': 'guess', 'k': 'calls'}}, {{'o': 'C' || k || '.run.inner', 'l': 22, 'x': 'self.own_' || k, 'tp': path, 't': 'C' || k || '.own_' || k, 's': true, 'b': 'name', 'k': 'calls'}},
    {{'o': 'C' || k, 'l': 4, 'x': CASE t WHEN 1 THEN 'C' || j WHEN 2 THEN 'shop.m' || j || '.C' || j ELSE 'C' || j || '[int]' END, 'tp': 'shop/m' || j || '.py', 't': 'C' || j, 's': near, 'b': 'name', 'k': 'inherits'}}]) AS x FROM e WHERE t <> 0
  UNION ALL SELECT path, unnest([{{'o': 'C' || k || '.shared', 'l': 3, 'x': 'self.own_' || k, 'tp': path, 't': 'C' || k || '.own_' || k, 's': true, 'b': 'name', 'k': 'calls'}}, {{'o': 'Child', 'l': 11, 'x': 'Slow', 'tp': NULL, 't': NULL, 's': false, 'b': 'name', 'k': 'inherits'}}]) FROM e WHERE t = 0),
r AS (SELECT a.id AS source, b.id AS target, CASE WHEN NOT x.s THEN 'unresolved' WHEN x.b = 'guess' THEN 'partial' ELSE 'resolved' END AS status, x.x AS text, x.k AS kind, m.path, x.l AS line,
  CASE WHEN x.k = 'inherits' THEN 'name' WHEN NOT x.s THEN NULL WHEN x.b = 'guess' THEN 'name' ELSE x.b END AS basis FROM m JOIN sym a ON a.path = m.path AND a.local_name = x.o LEFT JOIN sym b ON x.s AND b.path = x.tp AND b.local_name = x.t)"""


@query(f"""WITH {MEANT} SELECT concat('relation:', substring(sha1(concat_ws('|', 'run', kind, source, coalesce(target, text), concat_ws(':', path, line, line))), 1, 24)) AS id, kind, source, target, CASE WHEN status <> 'resolved' THEN text END AS target_reference, status, path, CAST(line AS BIGINT) AS line,
  CASE WHEN status = 'partial' THEN CAST(0.8 AS DOUBLE) END AS confidence, basis FROM r""")
def python_relations(spark, d):
    """Every way that a call is resolved or refused, and bases by name, by module prefix, with a type, and hidden under try."""
    return relations.program_relations(_files(spark, d))[1]


@query("SELECT concat('shop/m', s_suppkey, '.py') AS source_path, concat('shop/m', s_suppkey - 1, '.py') AS target_path FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey - 1 IN (SELECT s_suppkey FROM supplier)")
def python_import_edges(spark, d):
    return relations.import_edges(durable(relations.facts(_files(spark, d))))
