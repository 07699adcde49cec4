"""Parsing and resolution on a small repository of our own."""

import pytest
from pyspark.sql import functions as F

from orrery.functions import jsfacts, pyfacts
from orrery.operators import relations as R
from orrery.sources import files as S

REPO = {
    "shop/__init__.py": "",
    "shop/store.py": "class Base:\n    def load(self):\n        return 1\n\nclass Store(Base):\n    def save(self, x):\n        self.load()\n        return helper(x)\n\ndef helper(x):\n    return x\n",
    "shop/service.py": (
        "from .store import Store, helper as h\nfrom . import tools\nimport shop.missing\n\n"
        "class Service(Store):\n"
        "    def __init__(self, store: Store, other):\n        self.store = store\n        self.other = other\n        self.own = Store()\n"
        "    def run(self):\n        self.store.save(1)\n        self.other.save(1)\n        self.own.save(2)\n        h(3)\n        tools.mend(4)\n        self.load()\n        super().save(5)\n        unknown(6)\n        s = Store()\n        s.save(7)\n        Store().save(8)\n"
        "    async def late(self):\n        def inner():\n            return 1\n        return inner()\n"
    ),
    "shop/tools.py": "def mend(x):\n    if x:\n        def hidden():\n            pass\n    return x\n",
    "shop/open.py": "from outside import Thing\n\nclass Half(Thing):\n    def go(self):\n        self.load()\n        return Thing.make()\n",
    "shop/bad.py": "def broken(:\n",
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(p, "python", t) for p, t in REPO.items()], "path string, language string, text string")


@pytest.fixture(scope="module")
def resolved(corpus):
    syms, rels = R.program_relations(corpus)
    names = {r.id: r.local_name for r in syms.collect()}
    return syms, rels.collect(), names


def test_symbols(resolved):
    syms, _, _ = resolved
    rows = {r.qualified_name: r for r in syms.collect()}
    s = rows["python:shop/service.py::Service.run"]
    assert (s.kind, s.signature, s.exported) == ("method", "def run(self)", False)
    assert rows["python:shop/service.py::Service.late"].async_ and rows["python:shop/service.py::Service.late.inner"].kind == "function"
    assert "python:shop/tools.py::mend.hidden" not in rows
    assert rows["python:shop/store.py::helper"].exported and s.parent_symbol_id == rows["python:shop/service.py::Service"].id


def test_calls(resolved):
    _, rels, names = resolved
    got = {(names[r.source], r.line): (r.status, names.get(r.target), r.basis) for r in rels if r.kind == "calls" and r.path == "shop/service.py"}
    assert got["Service.run", 11] == ("resolved", "Store.save", "constructor_binding")
    assert got["Service.run", 12][0] == "unresolved"
    assert got["Service.run", 13] == ("resolved", "Store.save", "direct_construction")
    assert got["Service.run", 14][:2] == ("resolved", "helper") and got["Service.run", 15][:2] == ("resolved", "mend")
    assert got["Service.run", 16] == ("resolved", "Base.load", "inherited_method")
    assert got["Service.run", 17] == ("resolved", "Store.save", "static_super") or any(r.line == 17 and names.get(r.target) == "Store.save" for r in rels)
    assert got["Service.run", 18][0] == "unresolved"
    assert got["Service.run", 20][:2] == ("partial", "Store.save")
    assert any(r.line == 21 and names.get(r.target) == "Store.save" and r.status == "resolved" for r in rels)
    assert got["Service.late", 25][:2] == ("resolved", "Service.late.inner")


def test_refusals(resolved):
    _, rels, _ = resolved
    assert all(r.status == "unresolved" and r.target is None for r in rels if r.path == "shop/open.py")
    assert len({r.id for r in rels}) == len(rels)


def test_inheritance(resolved):
    _, rels, names = resolved
    got = {(names[r.source], names.get(r.target), r.status) for r in rels if r.kind == "inherits"}
    assert got == {("Store", "Base", "resolved"), ("Service", "Store", "resolved"), ("Half", None, "unresolved")}


def test_import_edges(corpus):
    got = {tuple(r) for r in R.import_edges(R.facts(corpus)).collect()}
    assert ("shop/service.py", "shop/store.py") in got and ("shop/service.py", "shop/tools.py") in got and not any(a == "shop/open.py" for a, _ in got)


def test_bad_files_cost_only_themselves(corpus):
    assert pyfacts.facts("def broken(:") is None
    assert R.facts(corpus).filter("fact = 'error'").count() == 1


def test_scripts(spark):
    text = "export interface A {\n  x: number\n}\nexport class B {\n  run(a) {\n    if (a) {\n      go(a)\n    }\n  }\n}\nconst f = async (x) => {\n  return x\n}\nfunction g() {}\ncall(1)\n"
    got = [(s[0], s[2], s[5], s[6]) for s in jsfacts.symbols(text)]
    assert got == [("interface", "A", 1, 3), ("class", "B", 4, 10), ("method", "B.run", 5, 9), ("function", "f", 11, 13), ("function", "g", 14, 14)]
    files = spark.createDataFrame([("src/a.ts", "typescript", "import {x} from './lib'\nimport y from '../top.js'\nimport z from 'react'"), ("src/lib/index.ts", "typescript", ""), ("top.js", "javascript", "")], "path string, language string, text string")
    assert {tuple(r) for r in R.script_import_edges(files).collect()} == {("src/a.ts", "src/lib/index.ts"), ("src/a.ts", "top.js")}


def test_scan(spark, tmp_path):
    for path, data in {"src/app.py": b"x = 1\n", "README.md": b"# Hi\n\ntext", "node_modules/x.js": b"1", ".env": b"S=1", "pkg/package.json": b'{"name": "p"}', "img.bin": b"\x00\x01", "go.mod": b"module m/n\n", "latest_news.py": b"y = 2\n", "pkg/__init__.py": b"", "src/node_modules/deep/y.js": b"1"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    df = S.scan(spark, str(tmp_path)).cache()
    rows = {r.path: r for r in df.collect()}
    assert set(rows) == {"src/app.py", "README.md", "pkg/package.json", "img.bin", "go.mod", "latest_news.py", "pkg/__init__.py"}
    assert (rows["pkg/__init__.py"].size_bytes, rows["pkg/__init__.py"].line_count, rows["pkg/__init__.py"].readable) == (0, 0, True)
    assert (rows["README.md"].line_count, rows["README.md"].role, rows["img.bin"].status, rows["latest_news.py"].role) == (3, "docs", "binary", "test")
    m = S.manifests(df)
    assert {(r.path, r.package_name) for r in m.collect()} == {("pkg/package.json", "p"), ("go.mod", "m/n")}
    assert {r.path for r in S.boundaries(m).collect()} == {"pkg", "."}
    assert df.filter(F.col("content_hash").isNull()).count() == 0


def test_distant_relatives_and_dotted_imports_stay_open(spark):
    repo = {
        "top/__init__.py": "", "top/near.py": "def go():\n    return 1\n", "top/sub/__init__.py": "", "top/sub/deep.py": "def down():\n    return 1\n",
        "top/sub/use.py": "from ..near import go\nfrom .deep import down\nimport top.near\n\ndef f():\n    go()\n    down()\n    top.near.go()\n    return top\n",
    }
    df = spark.createDataFrame([(p, "python", t) for p, t in repo.items()], "path string, language string, text string")
    got = {r.line: r.status for r in R.program_relations(df)[1].collect() if r.path == "top/sub/use.py"}
    assert got == {6: "unresolved", 7: "resolved", 8: "unresolved"}


def test_long_chains_of_classes(spark):
    text = "class C0:\n    def m(self):\n        return 1\n" + "".join(f"class C{i}(C{i - 1}):\n    pass\n" for i in range(1, 35))
    text += "class Last(C34):\n    def run(self):\n        self.m()\n        return super().m()\n"
    df = spark.createDataFrame([("a.py", "python", text)], "path string, language string, text string")
    syms, rels = R.program_relations(df)
    names = {r.id: r.local_name for r in syms.collect()}
    assert {names.get(r.target) for r in rels.collect() if r.kind == "calls"} <= {"C0.m", None} and any(names.get(r.target) == "C0.m" for r in rels.collect())


def test_anchors_need_their_second_condition(spark):
    from orrery.operators import anchors

    rows = [("a.py", 1, "register('x')"), ("plugin/b.py", 1, "register('x')"), ("c.py", 1, "authenticate(u)"), ("d.py", 1, "login(u)"), ("e.py", 1, "@app.get('/x') @app.get('/y')"), ("f.py", 1, "@app.get('/x')")]
    df = spark.createDataFrame([(p, "production", n, t) for p, n, t in rows], "path string, role string, line long, text string")
    got = {(r.kind, r.path, r.label) for r in anchors.line_anchors(df).collect()}
    assert ("plugin_registry", "plugin/b.py", "plugin/b.py") in got and not any(k == "plugin_registry" and p == "a.py" for k, p, _ in got)
    assert ("auth_boundary", "d.py", "d.py") in got and not any(p == "c.py" for _, p, _ in got)
    assert ("http_route", "f.py", "GET /x") in got


def test_exports_headings_and_paths(spark):
    from orrery.operators import anchors

    lines = [("pkg/__init__.py", 1, "from .core import Api, _hidden, run as go"), ("pkg/__init__.py", 2, "__all__ = ['Api', \"go\"]"), ("other.py", 1, "from .core import X")]
    df = spark.createDataFrame([(p, "production", n, t) for p, n, t in lines], "path string, role string, line long, text string")
    assert sorted((r.line, r.label, r.confidence) for r in anchors.export_anchors(df).collect()) == [(1, "Api", 0.86), (1, "run", 0.86), (2, "Api", 0.88), (2, "go", 0.88)]
    files = spark.createDataFrame([("a/package.json", "production", '{"scripts": {"build": "x"}, "exports": {".": "i"}, "main": "i.js"}'), ("b/package.json", "config", "{broken")], "path string, role string, text string")
    assert {(r.kind, r.label) for r in anchors.manifest_anchors(files).collect()} == {("cli_command", "npm script: build"), ("public_export", "package exports"), ("public_export", "package main: i.js")}
    text = [("r.md", i + 1, t) for i, t in enumerate(["# One #", "", "Two", "---", "text", "## Three"])]
    heads = anchors.headings(spark.createDataFrame(text, "path string, line long, text string")).collect()
    assert heads[0].headings == ["One", "Two", "Three"]
    where = spark.createDataFrame([("deploy/x.yaml", "yaml", "infrastructure"), ("web/pages/home.tsx", "typescript", "production"), ("lib/a.py", "python", "production")], "path string, language string, role string")
    assert {(r.kind, r.path) for r in anchors.path_anchors(where).collect()} == {("deployment_unit", "deploy/x.yaml"), ("frontend_screen", "web/pages/home.tsx")}
