"""Symbols of JavaScript and TypeScript files by line patterns and counted braces."""

from __future__ import annotations

import re

_EXPORT = r"^\s*(?P<export>export\s+)?(?:default\s+)?"
#: kind and pattern of each declaration, in the order they are tried.
DECLARATIONS = [
    ("interface", re.compile(_EXPORT + r"interface\s+(?P<name>[A-Za-z_$][\w$]*)")),
    ("type_alias", re.compile(_EXPORT + r"type\s+(?P<name>[A-Za-z_$][\w$]*)[^=]*=")),
    ("class", re.compile(_EXPORT + r"(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*)")),
    ("function", re.compile(_EXPORT + r"(?P<async>async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*\(")),
    ("function", re.compile(_EXPORT + r"(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)[^=]*=\s*(?P<async>async\s+)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>")),
]
_METHOD = re.compile(r"^\s*(?:(?:public|private|protected|static|readonly|override|get|set)\s+)*(?P<async>async\s+)?(?P<name>[A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?::[^{]+)?\{?\s*$")
_NO_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "constructor_"}
_IMPORT = re.compile(r"""(?:\bimport\s+(?:[^'"]*?\sfrom\s+)?|\bexport\s+[^'"]*?\sfrom\s+|\brequire\s*\(\s*)['"](?P<to>[^'"]+)['"]""")


def region_end(lines: list[str], start: int) -> int:
    """The line on which the braces opened from `start` (from 0) on are closed; `start` itself if none opens before a semicolon."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for ch in lines[i]:
            if ch == "{":
                depth, opened = depth + 1, True
            elif ch == "}":
                depth -= 1
        if opened and depth <= 0:
            return i
        if not opened and (lines[i].rstrip().endswith(";") or i - start > 3):
            return start
    return len(lines) - 1 if opened else start


def symbols(text: str) -> list[tuple]:
    """(kind, name, qualified name, exported, async, line, end line); a method is a call-like line right inside a class body."""
    lines = text.split("\n")
    out: list[tuple] = []
    open_: list[tuple[str, int, int]] = []  # class, depth of its body, last line
    depth = 0
    for i, line in enumerate(lines):
        open_ = [c for c in open_ if i <= c[2]]
        for kind, pattern in DECLARATIONS:
            if m := pattern.match(line):
                found = m.groupdict()
                end = region_end(lines, i)
                out.append((kind, found["name"], found["name"], bool(found["export"]), bool(found.get("async")), i + 1, end + 1))
                if kind == "class":
                    open_.append((found["name"], depth + 1, end))
                break
        else:
            if open_ and depth == open_[-1][1] and (m := _METHOD.match(line)) and m["name"] not in _NO_METHODS:
                owner = open_[-1][0]
                out.append(("method", m["name"], f"{owner}.{m['name']}", False, bool(m["async"]), i + 1, region_end(lines, i) + 1))
        depth += line.count("{") - line.count("}")
    return out


def imports(text: str) -> list[tuple[str, int]]:
    """Relative targets of imports, exports and requires, with their lines."""
    return [(m["to"], text.count("\n", 0, m.start()) + 1) for m in _IMPORT.finditer(text) if m["to"].startswith(".")]
