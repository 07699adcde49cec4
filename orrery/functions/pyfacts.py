"""Facts of one Python file by a single walk over its syntax tree.

The walk resolves nothing: names are written down with the scope they stand in, and joins find what they mean. All rows of a
file carry the same columns, so that one pass over the files feeds every table.
"""

from __future__ import annotations

import ast

#: fact, owner (qualified name of the symbol it stands in), name, detail, extra, line, end_line
FIELDS = ["fact", "owner", "name", "detail", "extra", "line", "end_line"]
SCHEMA = "path string, fact string, owner string, name string, detail string, extra string, line long, end_line long"


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a name or an attribute of a name; None for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def annotation(node: ast.AST | None) -> str | None:
    if node is None:
        return "<unannotated>"
    return dotted(node) or ast.unparse(node)


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def bound_names(node: ast.AST) -> set[str]:
    """Names that a function's own scope binds otherwise than by a parameter; functions, classes and lambdas inside it are not looked into."""
    names: set[str] = set()
    todo = list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load):
            names.add(n.id)
        elif isinstance(n, (ast.Global, ast.Nonlocal)):
            names.update(n.names)
        elif isinstance(n, ast.alias):
            names.add(n.asname or n.name.split(".")[0])
        elif isinstance(n, (*_FUNCTIONS, ast.ClassDef, ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and n.name:
            names.add(n.name)
        if not isinstance(n, (*_FUNCTIONS, ast.ClassDef, ast.Lambda)):
            todo += ast.iter_child_nodes(n)
    return names


class _Walk:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, fact: str, owner: str, name: str, detail: str | None = None, extra: str | None = None, node: ast.AST | None = None) -> None:
        line = getattr(node, "lineno", 0)
        self.rows.append((fact, owner, name, detail, extra, line, getattr(node, "end_lineno", None) or line))

    def imports(self, node: ast.AST, owner: str) -> None:
        for child in ast.walk(node):
            if isinstance(child, ast.Import):
                for a in child.names:
                    if a.asname or "." not in a.name:  # a dotted name without an alias binds nothing that is followed
                        self.add("import", owner, a.asname or a.name, a.name, None, child)
                    self.add("target", owner, a.name, None, "0", child)
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    if a.name != "*":
                        self.add("from", owner, a.asname or a.name, child.module or "", f"{child.level}:{a.name}", child)
                    self.add("target", owner, child.module or "", a.name, str(child.level), child)

    def bindings(self, tree: ast.Module) -> None:
        """What the statements at the very top bind by imports, the last of a name: a module by its full or first name, or an item of one."""
        found: dict[str, tuple] = {}
        for s in tree.body:
            if isinstance(s, ast.Import):
                for a in s.names:
                    for name, module in [(a.asname, a.name)] if a.asname else [(a.name.split(".")[0], a.name.split(".")[0]), (a.name, a.name)]:
                        found[name] = (module, None, s)
            elif isinstance(s, ast.ImportFrom):
                for a in s.names:
                    if a.name != "*":
                        found[a.asname or a.name] = (s.module or "", f"{s.level}:{a.name}", s)
        for name, (module, item, s) in found.items():
            self.add("bind", "", name, module, item, s)

    def hidden(self, stmts: list, owner: str) -> None:
        """Classes under if, try and with, which are no symbols and yet are what their names mean."""
        for s in stmts:
            if isinstance(s, (ast.If, ast.Try, ast.With)):
                inner = [x for part in ("body", "orelse", "finalbody") for x in getattr(s, part, [])]
                for c in inner:
                    if isinstance(c, ast.ClassDef):
                        self.add("hidden", owner, f"{owner}.{c.name}" if owner else c.name, None, None, c)
                self.hidden(inner, owner)

    def body(self, stmts: list, owner: str, in_class: bool, klass: str | None) -> None:
        if in_class or not owner:
            self.hidden(stmts, owner)
        for s in stmts:
            if isinstance(s, ast.ClassDef):
                self.klass(s, owner)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(s, owner, in_class, klass if in_class else None)
            elif not owner and isinstance(s, (ast.Assign, ast.AnnAssign)):
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if isinstance(t, ast.Name):
                        self.add("assigned", "", t.id, None, None, s)

    def klass(self, node: ast.ClassDef, owner: str) -> None:
        name = f"{owner}.{node.name}" if owner else node.name
        self.add("class", owner, name, f"class {node.name}", "0", node)
        for b in node.bases:
            base = b.value if isinstance(b, ast.Subscript) else b
            self.add("base", name, dotted(base) or ast.unparse(base), ast.unparse(b), None, b)
        self.body(node.body, name, True, name)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str, in_class: bool, klass: str | None) -> None:
        name = f"{owner}.{node.name}" if owner else node.name
        kind = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        args = [a.arg for a in node.args.args]
        self.add("method" if in_class else "function", owner, name, f"{kind} {node.name}({', '.join(args)})", str(int(kind != "def")), node)
        decorated = {dotted(d) for d in node.decorator_list}
        self.scope(node, name, owner, in_class)
        self_name = args[0] if klass and args and not decorated & {"staticmethod", "classmethod"} else None
        if klass and node.name == "__init__" and self_name:
            self.constructor(node, klass, self_name)
        self.calls(node, name, klass, self_name)
        self.body(node.body, name, False, None)

    def scope(self, node: ast.FunctionDef | ast.AsyncFunctionDef, name: str, owner: str, in_class: bool) -> None:
        """What decides whether `self` in a function inside a method is that method's own."""
        a = node.args
        first = [*a.posonlyargs, *a.args][:1]
        if in_class:
            changed = {d.id if isinstance(d, ast.Name) else d.attr for d in node.decorator_list if isinstance(d, (ast.Name, ast.Attribute))} & {"staticmethod", "classmethod"}
            if first and first[0].arg == "self" and not changed:
                self.add("takes_self", owner, name, None, None, node)
        elif owner:
            self.add("nested", owner, name, None, None, node)
            if any(x.arg == "self" for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x is not None):
                self.add("binds_self", owner, name, None, None, node)
        if "self" in bound_names(node):
            self.add("binds_self", owner, name, None, None, node)

    def constructor(self, node: ast.FunctionDef | ast.AsyncFunctionDef, klass: str, self_name: str) -> None:
        types = {a.arg: annotation(a.annotation) for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]}
        for s in ast.walk(node):
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) and s.value else []
            for t in targets:
                if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == self_name:
                    if isinstance(s.value, ast.Name) and s.value.id in types:
                        self.add("binding", klass, t.attr, types[s.value.id], s.value.id, s)
                    elif isinstance(s.value, ast.Call) and dotted(s.value.func):
                        self.add("built", klass, t.attr, dotted(s.value.func), None, s)
                    else:
                        self.add("built", klass, t.attr, None, None, s)

    def calls(self, node: ast.FunctionDef | ast.AsyncFunctionDef, name: str, klass: str | None, self_name: str | None) -> None:
        """Calls and typed variables of this function, without those of functions and classes inside it."""
        todo = list(node.body)
        while todo:
            n = todo.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(n, ast.Call):
                self.call(n, name, klass, self_name)
            if isinstance(n, ast.Assign):
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        self.add("variable", name, t.id, dotted(n.value.func) if isinstance(n.value, ast.Call) else None, None, n)
            todo += ast.iter_child_nodes(n)

    def call(self, n: ast.Call, name: str, klass: str | None, self_name: str | None) -> None:
        f = n.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name):
            inner = f.value.func.id
            if inner == "super" and klass:
                return self.add("call", name, f"super().{f.attr}", f.attr, f"super:{klass}", n)
            return self.add("call", name, f"{inner}().{f.attr}", f.attr, f"built:{inner}", n)
        text = dotted(f)
        if text is None:
            return self.add("call", name, ast.unparse(f), None, "other", n)
        head, _, rest = text.partition(".")
        if not rest:
            return self.add("call", name, text, text, "bare", n)
        if self_name and head == self_name and klass:
            if "." not in rest:
                return self.add("call", name, text, rest, f"self:{klass}", n)
            attr, _, method = rest.partition(".")
            return self.add("call", name, text, method if "." not in method else None, f"attr:{klass}:{attr}", n)
        return self.add("call", name, text, rest if "." not in rest else None, f"dotted:{head}", n)


def facts(text: str) -> list[tuple] | None:
    """Rows of one file; None where it does not parse, so that one bad file costs only its own rows."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    walk = _Walk()
    walk.imports(tree, "")
    walk.bindings(tree)
    walk.body(tree.body, "", False, None)
    return walk.rows
