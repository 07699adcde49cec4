"""Symbols, bindings, inheritance and calls of Python and script files, resolved by joins.

One pass over the files writes facts; everything else is equi-joins on file and name. A name with more than one meaning, or
with a disqualifier on the way, stays unresolved: counts of candidates decide, never the first one found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import jsfacts, pyfacts
from orrery.functions.text import stable_id
from orrery.lineage import durable

PARTIAL = 0.8


def facts(files: DataFrame) -> DataFrame:
    """Facts of readable Python files (path, language, text); a file that does not parse gives one `error` row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf.path, pdf.text):
                found = pyfacts.facts(text)
                rows += [(path, *r) for r in found] if found is not None else [(path, "error", "", path, None, None, 0, 0)]
            yield pd.DataFrame(rows, columns=["path", *pyfacts.FIELDS])

    source = files.filter("language = 'python' and text is not null").select("path", "text")
    df = source.mapInPandas(run, pyfacts.SCHEMA)
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), r"(^|/)__init__$", ""), "/", ".")
    package = F.when(F.col("path").rlike(r"(^|/)__init__\.pyi?$"), module).otherwise(F.regexp_extract(module, r"^(.*)\.[^.]+$", 1))
    return df.withColumn("module", module).withColumn("package", package)


def _name(qual: str) -> Column:
    return F.element_at(F.split(qual, r"\."), -1)


def symbols(rows: DataFrame, run_id: str = "run") -> DataFrame:
    """id, path, language, name, qualified_name, local_name, kind, start_line, end_line, signature, exported, async_, parent_symbol_id, stable_entity_key."""
    df = rows.filter(F.col("fact").isin("class", "function", "method"))
    name = _name("name")
    df = df.select(
        "path", F.lit("python").alias("language"), name.alias("name"), F.concat(F.lit("python:"), "path", F.lit("::"), "name").alias("qualified_name"), F.col("name").alias("local_name"), F.col("fact").alias("kind"),
        F.col("line").alias("start_line"), "end_line", F.col("detail").alias("signature"), (~name.startswith("_") & ((F.col("fact") == "class") | (F.col("owner") == ""))).alias("exported"), (F.col("extra") == "1").alias("async_"), F.col("owner"),
    )
    df = df.withColumn("id", stable_id("symbol", F.lit(run_id), F.col("qualified_name"), F.col("start_line"), F.col("end_line")))
    df = df.withColumn("stable_entity_key", stable_id("entity", F.col("path"), F.col("qualified_name"), F.col("kind"), F.col("signature")))
    # of equal names in a file the last definition is the one that a name means
    up = _last(df).select("path", F.col("local_name").alias("owner"), F.col("id").alias("parent_symbol_id"))
    return df.join(up, ["path", "owner"], "left").drop("owner")


def _last(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("path", "local_name").orderBy(F.desc("start_line"))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def script_symbols(files: DataFrame, run_id: str = "run") -> DataFrame:
    """Symbols of JavaScript and TypeScript files, with the columns of symbols() that they have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, lang, *r) for p, lang, text in zip(pdf.path, pdf.language, pdf.text) for r in jsfacts.symbols(text)]
            yield pd.DataFrame(rows, columns=["path", "language", "kind", "name", "local_name", "exported", "async_", "start_line", "end_line"])

    df = files.filter("language in ('javascript', 'typescript') and text is not null").select("path", "language", "text")
    df = df.mapInPandas(run, "path string, language string, kind string, name string, local_name string, exported boolean, async_ boolean, start_line long, end_line long")
    df = df.withColumn("qualified_name", F.concat("language", F.lit(":"), "path", F.lit("::"), "local_name"))
    return df.withColumn("id", stable_id("symbol", F.lit(run_id), F.col("qualified_name"), F.col("start_line"), F.col("end_line")))


def import_edges(rows: DataFrame) -> DataFrame:
    """(source_path, target_path): imports between files of the corpus; both the module and a name inside it are tried."""
    level = F.col("extra").cast("int")
    parts = F.split("package", r"\.")
    base = F.when(level <= 1, F.col("package")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - level + 1, F.lit(0))), "."))
    start = F.when(level == 0, F.col("name")).when(F.col("name") == "", base).when(base == "", F.col("name")).otherwise(F.concat_ws(".", base, "name"))
    wanted = rows.filter("fact = 'target'").select("path", start.alias("base"), "detail")
    wanted = wanted.select("path", F.explode(F.array_distinct(F.array_compact(F.array("base", F.when(F.col("detail").isNotNull(), F.when(F.col("base") == "", F.col("detail")).otherwise(F.concat_ws(".", "base", "detail"))))))).alias("module"))
    known = rows.select(F.col("path").alias("target_path"), "module").distinct().filter("module <> ''")
    return wanted.join(known, "module").filter("path <> target_path").select(F.col("path").alias("source_path"), "target_path").distinct()


def script_import_edges(files: DataFrame) -> DataFrame:
    """(source_path, target_path) of relative imports between script files: the exact path, then endings, then an index file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, to) for p, text in zip(pdf.path, pdf.text) for to, _ in jsfacts.imports(text)], columns=["source_path", "to"])

    df = files.filter("language in ('javascript', 'typescript') and text is not null").select("path", "text").mapInPandas(run, "source_path string, to string")
    joined = F.concat(F.array_compact(F.filter(F.split(F.regexp_extract("source_path", "^(.*)/[^/]*$", 1), "/"), lambda x: x != "")), F.split("to", "/"))
    step = lambda a, x: F.when((x == ".") | (x == ""), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    path = F.array_join(F.aggregate(joined, F.array().cast("array<string>"), step), "/")
    ends = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    df = df.distinct().withColumn("base", path).select("source_path", "to", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in ends])).alias("rank", "target_path"))
    hit = df.join(files.select(F.col("path").alias("target_path")), "target_path")
    return hit.groupBy("source_path", "to").agg(F.min_by("target_path", "rank").alias("target_path")).select("source_path", "target_path").filter("source_path <> target_path").distinct()


def names(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """(path, name, kind, tpath, tqual): what a name means at the top of a file; kind is class, function or module.

    A definition goes before an import. An import means the definition of the target module, else its submodule, unless the
    package's own file assigns that name. A name that means two things means nothing.
    """
    top = defs.filter("local_name = name").select("path", "name", "kind", F.col("path").alias("tpath"), F.col("local_name").alias("tqual"))
    mods = rows.select(F.col("path").alias("mpath"), F.col("module").alias("mod")).distinct().filter("mod <> ''")
    one = mods.groupBy("mod").agg(F.count(F.lit(1)).alias("c"), F.min("mpath").alias("mpath")).filter("c = 1").drop("c")
    parts = F.split("extra", ":", 2)
    level, base = parts[0].cast("int"), F.col("package")
    mod = F.when(level == 0, F.col("detail")).when(F.col("detail") == "", base).when(base == "", F.col("detail")).otherwise(F.concat_ws(".", base, "detail"))
    # two levels up or more are not followed: such a name stays open
    froms = rows.filter("fact = 'from'").filter(level <= 1).select("path", "name", mod.alias("mod"), parts[1].alias("item"))
    in_module = froms.join(one, "mod").join(top.select(F.col("path").alias("mpath"), F.col("name").alias("item"), F.col("kind").alias("k"), "tqual"), ["mpath", "item"])
    in_module = in_module.select("path", "name", F.col("k").alias("kind"), F.col("mpath").alias("tpath"), "tqual")
    sub = froms.join(one.select(F.col("mod").alias("sub"), F.col("mpath").alias("spath")), F.concat_ws(".", F.col("mod"), F.col("item")) == F.col("sub"))
    shadow = rows.filter("fact = 'assigned'").select(F.col("module").alias("mod"), F.col("name").alias("item")).distinct()
    sub = sub.join(shadow, ["mod", "item"], "left_anti").join(in_module.select("path", "name"), ["path", "name"], "left_anti")
    sub = sub.select("path", "name", F.lit("module").alias("kind"), F.col("spath").alias("tpath"), F.lit("").alias("tqual"))
    whole = rows.filter("fact = 'import'").select("path", "name", F.col("detail").alias("mod")).join(one, "mod").select("path", "name", F.lit("module").alias("kind"), F.col("mpath").alias("tpath"), F.lit("").alias("tqual"))
    imported = in_module.unionByName(sub).unionByName(whole).distinct().join(top.select("path", "name"), ["path", "name"], "left_anti")
    alone = imported.groupBy("path", "name").agg(F.count(F.lit(1)).alias("c"), F.first(F.struct("kind", "tpath", "tqual")).alias("x")).filter("c = 1").select("path", "name", "x.*")
    return top.unionByName(alone)


def _classes_meant(df: DataFrame, meant: DataFrame, defs: DataFrame, text: str) -> DataFrame:
    """df with cpath and cqual: the class that the text `text` names in the file `path`; null where that is not certain."""
    cls = meant.filter("kind = 'class'").select("path", F.col("name").alias(text), F.col("tpath").alias("c1"), F.col("tqual").alias("q1"))
    mod = meant.filter("kind = 'module'").select("path", F.col("name").alias("_head"), F.col("tpath").alias("_m"))
    top = defs.filter("kind = 'class' and local_name = name").select(F.col("path").alias("_m"), F.col("name").alias("_tail"), F.col("local_name").alias("q2"))
    df = df.withColumn("_head", F.regexp_extract(text, r"^([^.]+)\.[^.]+$", 1)).withColumn("_tail", F.regexp_extract(text, r"^[^.]+\.([^.]+)$", 1))
    df = df.join(cls, ["path", text], "left").join(mod, ["path", "_head"], "left").join(top, ["_m", "_tail"], "left")
    return df.withColumn("cpath", F.coalesce("c1", F.when(F.col("q2").isNotNull(), F.col("_m")))).withColumn("cqual", F.coalesce("q1", "q2")).drop("_head", "_tail", "_m", "c1", "q1", "q2")


def inheritance(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """path, owner, base, text, line, cpath, cqual: one row for each base; the target is null where it is not certain.

    A name means the class of the nearest scope around it; else what an import at the top of the file takes from a module. A
    dotted name means a class at the top of the module that all of it but the last part is bound to: the longest prefix that an
    import names, and one step on. Base[T] means what Base means. A class under if, try or with takes its name from every
    other meaning, but is no symbol itself.
    """
    df = rows.filter("fact = 'base'").select("path", "package", "module", "owner", F.col("name").alias("base"), F.coalesce("detail", "name").alias("text"), "line")
    known = defs.filter("kind = 'class'").select("path", "local_name", F.lit(True).alias("symbol"))
    known = known.unionByName(rows.filter("fact = 'hidden'").select("path", F.col("name").alias("local_name"), F.lit(False).alias("symbol"))).groupBy("path", "local_name").agg(F.max("symbol").alias("symbol"))
    up = F.split("owner", r"\.")
    scopes = F.transform(F.sequence(F.lit(1), F.size(up)), lambda k: F.array_join(F.slice(up, 1, F.size(up) - k), "."))
    key = ["path", "owner", "base", "line"]
    inner = df.filter(~F.contains("base", F.lit("."))).select(*key, F.explode(scopes).alias("scope")).withColumn("local_name", F.when(F.col("scope") == "", F.col("base")).otherwise(F.concat_ws(".", "scope", "base")))
    inner = inner.join(known, ["path", "local_name"]).groupBy(*key).agg(F.max_by(F.struct("local_name", "symbol"), F.length("scope")).alias("inner"))
    level, item = F.split("extra", ":", 2)[0].cast("int"), F.split("extra", ":", 2)[1]
    parts = F.split("module", r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - level, F.lit(0))), ".")
    to = F.when(F.col("extra").isNull() | (level == 0), F.col("detail")).when(F.col("detail") == "", base).when(base == "", F.col("detail")).otherwise(F.concat_ws(".", base, "detail"))
    bound = rows.filter("fact = 'bind'").select("path", F.col("name").alias("head"), to.alias("mod"), item.alias("item")).filter("mod <> ''")
    files = rows.select(F.col("path").alias("tpath"), F.col("module").alias("mod")).filter("mod <> ''").groupBy("mod").agg(F.max("tpath").alias("tpath"))
    bound = bound.join(files, "mod").select("path", "head", "item", "tpath")
    head, tail = F.regexp_extract("base", r"^(.*)\.[^.]+$", 1), F.element_at(F.split("base", r"\."), -1)
    plain = df.filter(~F.contains("base", F.lit("."))).select(*key, F.col("base").alias("head")).join(bound.filter("item is not null"), ["path", "head"]).select(*key, "tpath", F.col("item").alias("tname"))
    dotted = df.filter(F.contains("base", F.lit("."))).select(*key, head.alias("head"), tail.alias("tname")).join(bound.filter("item is null"), ["path", "head"]).select(*key, "tpath", "tname")
    outer = plain.unionByName(dotted).join(known.filter("symbol").select(F.col("path").alias("tpath"), F.col("local_name").alias("tname")), ["tpath", "tname"])
    df = df.join(inner, key, "left").join(outer, key, "left")
    here = F.col("inner.symbol")
    cpath = F.when(here, F.col("path")).when(F.col("inner").isNull(), F.col("tpath"))
    cqual = F.when(here, F.col("inner.local_name")).when(F.col("inner").isNull(), F.col("tname"))
    return df.select("path", "owner", "base", "text", "line", cpath.alias("cpath"), cqual.alias("cqual"))


def captured_self(rows: DataFrame) -> DataFrame:
    """(path, owner, klass): functions inside a method, at any depth, whose `self` is that method's own.

    The method takes `self` first and is neither static nor of the class; neither it nor any function on the way binds the
    name anew. Each round goes one function further in.
    """
    free = rows.filter("fact = 'nested'").select("path", "owner", "name").join(rows.filter("fact = 'binds_self'").select("path", "name"), ["path", "name"], "left_anti")
    front = rows.filter("fact = 'takes_self'").select("path", "name", F.col("owner").alias("klass")).join(rows.filter("fact = 'binds_self'").select("path", "name"), ["path", "name"], "left_anti")
    out = None
    while True:
        front = durable(free.join(front.select("path", F.col("name").alias("owner"), "klass"), ["path", "owner"]).select("path", "name", "klass").distinct())
        out = front if out is None else out.unionByName(front)
        if not front.take(1):
            return out.select("path", F.col("name").alias("owner"), "klass")


def bindings(rows: DataFrame, defs: DataFrame, meant: DataFrame) -> DataFrame:
    """path, owner, attribute, parameter, type, line, cpath, cqual of `self.attribute = parameter` in constructors."""
    df = rows.filter("fact = 'binding'").select("path", "owner", F.col("name").alias("attribute"), F.col("extra").alias("parameter"), F.col("detail").alias("type"), "line")
    return _classes_meant(df, meant, defs, "type")


def _agreed(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cpath, cqual where all rows of a key name one certain class."""
    g = df.groupBy(*keys).agg(F.countDistinct("cpath", "cqual").alias("n"), F.count(F.lit(1)).alias("all"), F.count("cqual").alias("sure"), F.max("cpath").alias("cpath"), F.max("cqual").alias("cqual"))
    return g.filter("n = 1 and all = sure").drop("n", "all", "sure")


def _inherited(calls: DataFrame, bases: DataFrame, methods: DataFrame) -> DataFrame:
    """path, owner, k, detail, line with tpath, tqual: the one definer of a method above a class.

    The search goes up class by class and stops at definers. A class that is looked past and has a base that is not
    certain, or two definers, leaves the call open.
    """
    key = ["path", "owner", "k", "detail", "line"]
    unsure = bases.filter("cqual is null").select(F.col("path").alias("cp"), F.col("owner").alias("cq"), F.lit(True).alias("unsure")).distinct()
    sure = bases.filter("cqual is not null").select(F.col("path").alias("cp"), F.col("owner").alias("cq"), F.col("cpath").alias("np"), F.col("cqual").alias("nq")).distinct()
    front = durable(calls.select(*key, F.col("path").alias("cp"), F.col("k").alias("cq")).distinct())
    seen, found, refused = front, [], []
    while True:
        past = front.join(unsure, ["cp", "cq"])
        refused.append(past.select(*key).distinct())
        up = front.join(sure, ["cp", "cq"]).select(*key, F.col("np").alias("cp"), F.col("nq").alias("cq")).distinct().join(seen, [*key, "cp", "cq"], "left_anti")
        up = durable(up.join(methods.select(F.col("path").alias("cp"), F.col("klass").alias("cq"), F.col("name").alias("detail"), F.col("local_name").alias("tqual")), ["cp", "cq", "detail"], "left"))
        found.append(up.filter("tqual is not null").select(*key, F.col("cp").alias("tpath"), "tqual"))
        front = up.filter("tqual is null").select(*key, "cp", "cq")
        seen = seen.unionByName(front)
        if not front.take(1):
            break
    every, bad = found[0], refused[0]
    for x in found[1:]:
        every = every.unionByName(x)
    for x in refused[1:]:
        bad = bad.unionByName(x)
    one = every.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("tpath").alias("tpath"), F.first("tqual").alias("tqual")).filter("n = 1").drop("n")
    return one.join(bad.distinct(), key, "left_anti")


def _above(calls: DataFrame, bases: DataFrame, methods: DataFrame) -> DataFrame:
    """path, owner, k, detail, line with tpath, tqual: the nearest definer above, where each class on the way has one certain base."""
    key = ["path", "owner", "k", "detail", "line"]
    single = bases.groupBy(F.col("path").alias("cp"), F.col("owner").alias("cq")).agg(F.count(F.lit(1)).alias("n"), F.first("cpath").alias("np"), F.first("cqual").alias("nq")).filter("n = 1 and nq is not null").drop("n")
    front = durable(calls.select(*key, F.col("path").alias("cp"), F.col("k").alias("cq")).distinct())
    seen, found = front, []
    while True:
        up = front.join(single, ["cp", "cq"]).select(*key, F.col("np").alias("cp"), F.col("nq").alias("cq")).join(seen, [*key, "cp", "cq"], "left_anti")
        up = durable(up.join(methods.select(F.col("path").alias("cp"), F.col("klass").alias("cq"), F.col("name").alias("detail"), F.col("local_name").alias("tqual")), ["cp", "cq", "detail"], "left"))
        found.append(up.filter("tqual is not null").select(*key, F.col("cp").alias("tpath"), "tqual"))
        front = up.filter("tqual is null").select(*key, "cp", "cq")
        seen = seen.unionByName(front)
        if not front.take(1):
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def calls(rows: DataFrame, defs: DataFrame, meant: DataFrame, bases: DataFrame, bound: DataFrame) -> DataFrame:
    """path, owner, text, line, tpath, tqual, status, confidence, basis of every call inside a function."""
    raw = rows.filter("fact = 'call'").select("path", "owner", F.col("name").alias("text"), "detail", "extra", "line")
    shape = F.split("extra", ":")
    raw = raw.withColumn("shape", shape[0]).withColumn("k", F.get(shape, F.lit(1))).withColumn("attr", F.get(shape, F.lit(2))).distinct()
    raw = durable(raw)
    methods = defs.filter("kind = 'method'").select("path", F.regexp_extract("local_name", r"^(.*)\.[^.]+$", 1).alias("klass"), "name", "local_name")
    hit = methods.select(F.col("path").alias("cpath"), F.col("klass").alias("cqual"), F.col("name").alias("detail"), F.col("local_name").alias("tqual"))
    key = ["path", "owner", "text", "line"]

    def of_class(df: DataFrame, status: str, basis: str) -> DataFrame:
        return df.join(hit, ["cpath", "cqual", "detail"]).select(*key, F.col("cpath").alias("tpath"), "tqual", F.lit(status).alias("status"), F.lit(basis).alias("basis"))

    plain = lambda df, basis: df.select(*key, "tpath", "tqual", F.lit("resolved").alias("status"), F.lit(basis).alias("basis"))
    bare = raw.filter("shape = 'bare'")
    nested = bare.withColumn("tqual", F.concat_ws(".", "owner", "detail")).join(defs.select("path", F.col("local_name").alias("tqual")), ["path", "tqual"]).withColumn("tpath", F.col("path"))
    named = bare.join(meant.filter("kind <> 'module'").select("path", F.col("name").alias("detail"), "tpath", "tqual"), ["path", "detail"])
    own = raw.filter("shape = 'self'").withColumn("cpath", F.col("path")).withColumn("cqual", F.col("k"))
    made = _classes_meant(raw.filter("shape = 'built'"), meant, defs, "k")
    dotted = raw.filter("shape = 'dotted'")
    in_module = dotted.join(meant.filter("kind = 'module'").select("path", F.col("name").alias("k"), F.col("tpath").alias("tp")), ["path", "k"])
    in_module = in_module.join(defs.filter("local_name = name").select(F.col("path").alias("tp"), F.col("name").alias("detail"), F.col("local_name").alias("tqual")), ["tp", "detail"]).withColumn("tpath", F.col("tp"))
    on_class = _classes_meant(dotted, meant, defs, "k")
    # only methods of the class itself: nothing further is tried from inside another function
    closed = dotted.filter("k = 'self'").join(captured_self(rows), ["path", "owner"]).withColumn("cpath", F.col("path")).withColumn("cqual", F.col("klass"))
    variables = _classes_meant(rows.filter("fact = 'variable'").select("path", "owner", F.col("name").alias("k"), F.col("detail").alias("made")), meant, defs, "made")
    typed = dotted.join(_agreed(variables, ["path", "owner", "k"]), ["path", "owner", "k"]).join(meant.select("path", F.col("name").alias("k")), ["path", "k"], "left_anti")
    attr = raw.filter("shape = 'attr'")
    single = bound.groupBy("path", F.col("owner").alias("k"), F.col("attribute").alias("attr")).agg(F.count(F.lit(1)).alias("n"), F.first("cpath").alias("cpath"), F.first("cqual").alias("cqual")).filter("n = 1 and cqual is not null").drop("n")
    built = _classes_meant(rows.filter("fact = 'built'").select("path", F.col("owner").alias("k"), F.col("name").alias("attr"), F.col("detail").alias("made")), meant, defs, "made")
    built = _agreed(built, ["path", "k", "attr"]).join(bound.select("path", F.col("owner").alias("k"), F.col("attribute").alias("attr")).distinct(), ["path", "k", "attr"], "left_anti")
    ways = [
        plain(nested, "name"), plain(named.join(nested.select(*key), key, "left_anti"), "name"), of_class(own, "resolved", "name"), of_class(made, "resolved", "name"), plain(in_module, "name"),
        of_class(on_class, "resolved", "name"), of_class(closed, "resolved", "name"), of_class(typed, "partial", "name"), of_class(attr.join(single, ["path", "k", "attr"]), "resolved", "constructor_binding"), of_class(attr.join(built, ["path", "k", "attr"]), "resolved", "direct_construction"),
    ]
    direct = ways[0]
    for w in ways[1:]:
        direct = direct.unionByName(w)
    direct = durable(direct)
    open_self = durable(raw.filter("shape = 'self'").join(direct.select(*key), key, "left_anti"))
    above = _inherited(open_self, bases, methods).join(open_self, ["path", "owner", "k", "detail", "line"])
    parents = _above(raw.filter("shape = 'super'"), bases, methods).join(raw.filter("shape = 'super'"), ["path", "owner", "k", "detail", "line"])
    every = direct.unionByName(plain(above, "inherited_method")).unionByName(plain(parents, "static_super")).distinct()
    # the ways go before one another in this order; where ways of one rank differ none holds
    ranks = ["name", "constructor_binding", "direct_construction", "inherited_method", "static_super"]
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col("basis"))
    first = every.groupBy(*key).agg(F.min(rank).alias("first"))
    every = every.join(first, key).filter(rank == F.col("first")).drop("first")
    one = every.groupBy(*key).agg(F.countDistinct("tpath", "tqual").alias("n"), F.min(F.struct("status", "basis", "tpath", "tqual")).alias("x")).filter("n = 1").select(*key, "x.*")
    out = raw.select(*key).distinct().join(one, key, "left").withColumn("status", F.coalesce("status", F.lit("unresolved")))
    return out.withColumn("confidence", F.when(F.col("status") == "partial", PARTIAL))


def program_relations(files: DataFrame, run_id: str = "run") -> tuple[DataFrame, DataFrame]:
    """Symbols, and relations (id, kind, source, target, target_reference, status, path, line, confidence, basis) of Python files.

    Rows whose source is no symbol are dropped; one row for each id.
    """
    rows = durable(facts(files))
    syms = durable(symbols(rows, run_id))
    defs = _last(syms).select("path", "name", "local_name", "kind", "id")
    meant = durable(names(rows, defs))
    bases = durable(inheritance(rows, defs))
    bound = bindings(rows, defs, meant)
    c = calls(rows, defs, meant, bases, bound)
    c = c.select("path", "owner", "text", "line", "tpath", "tqual", "status", "confidence", "basis", F.lit("calls").alias("kind"))
    b = bases.select("path", "owner", "text", "line", F.col("cpath").alias("tpath"), F.col("cqual").alias("tqual"), F.when(F.col("cqual").isNotNull(), "resolved").otherwise("unresolved").alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit("name").alias("basis"), F.lit("inherits").alias("kind"))
    df = c.unionByName(b)
    ids = defs.select("path", F.col("local_name").alias("owner"), F.col("id").alias("source"))
    to = defs.select(F.col("path").alias("tpath"), F.col("local_name").alias("tqual"), F.col("id").alias("target"))
    df = df.join(ids, ["path", "owner"]).join(to, ["tpath", "tqual"], "left")
    df = df.withColumn("target_reference", F.when(F.col("status") != "resolved", F.col("text")))
    span = F.concat_ws(":", "path", "line", "line")
    df = df.withColumn("id", stable_id("relation", F.lit(run_id), F.col("kind"), F.col("source"), F.coalesce("target", "target_reference"), span))
    df = df.select("id", "kind", "source", "target", "target_reference", "status", "path", "line", "confidence", "basis")
    # of rows of one id the surest stays
    sure = F.array_position(F.array(*map(F.lit, ["unresolved", "partial", "resolved"])), F.col("status"))
    others = [c for c in df.columns if c != "id"]
    best = df.groupBy("id").agg(F.max(F.struct(sure.alias("sure"), *others)).alias("x"))
    return syms, best.select("id", *[F.col(f"x.{c}").alias(c) for c in others])
