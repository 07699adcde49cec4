"""Text as columns: tokens, lines, previews, ids. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a question loses.
STOP_WORDS = ["a", "all", "an", "and", "are", "component", "does", "file", "files", "find", "for", "how", "in", "is", "it", "of", "repository", "the", "this", "to", "what", "where", "which"]
#: Tokens that stand for others.
ALIASES = {
    "analysis": "analyze", "analyzer": "analyze", "analyzes": "analyze", "called": "call", "calls": "call", "calling": "call",
    "dependencies": "depend", "dependency": "depend", "depends": "depend", "docs": "document", "documentation": "document", "documents": "document",
    "errors": "error", "generated": "generate", "generates": "generate", "handles": "handle", "imports": "import", "parses": "parse", "parser": "parse",
    "started": "start", "starting": "start", "stored": "store", "stores": "store", "typescript": "typescript", "validates": "validate", "validation": "validate",
}
#: What a question's term also means.
CONCEPTS = {
    "analyze": ["analyze", "process", "service", "workflow"],
    "depend": ["depend", "import", "model", "record", "reference", "repository", "type"],
    "document": ["describe", "display", "doc", "document", "guide", "readme", "report"],
    "error": ["catch", "error", "exception", "invalid", "raise", "validate"],
    "generate": ["build", "create", "describe", "generate", "render"],
    "handle": ["analyze", "controller", "handle", "process", "service", "validate"],
    "parse": ["decode", "parse"],
    "start": ["api", "bootstrap", "create", "entry", "index", "main", "start"],
    "store": ["database", "model", "persist", "record", "repository", "store"],
    "validate": ["check", "error", "invalid", "validate"],
}
#: Question kinds by the phrases that show them; the first kind that fits counts.
INTENTS = [
    ("navigational", ["where", "find", "locate", "show me", "search for"]),
    ("explanatory", ["how does", "what does", "explain", "describe", "tell me about", "walk me through", "how is", "what is"]),
    ("impact", ["what breaks", "what happens if", "depends on", "blast radius", "if i change", "if i remove", "affected by"]),
    ("architectural", ["architecture", "architectural", "boundary", "component", "subsystem", "design pattern", "layers", "structure", "violations", "circular", "coupling"]),
    ("comparative", ["compare", "difference", "differ", "vs", "versus", "similarities", "contrast"]),
    ("diagnostic", ["most complex", "most coupled", "hotspot", "worst", "biggest", "smallest", "most connected"]),
    ("generative", ["how would i", "how should i", "best way to", "how to add", "how to refactor", "recommend", "suggest"]),
    ("inventory", ["list all", "show all", "how many", "enumerate", "count", "all endpoints", "all functions", "all classes"]),
]


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:24 hex digits of the SHA-1 of the parts joined by |; a null part counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha1(joined), 1, 24))


def normalized(token: Column) -> Column:
    """Aliases first, then plural and -ing endings. `process` so becomes `proces`, which callers rely on."""
    out = (
        F.when(token.endswith("ies") & (F.length(token) > 4), F.concat(token.substr(F.lit(1), F.length(token) - 3), F.lit("y")))
        .when(token.endswith("ing") & (F.length(token) > 5), token.substr(F.lit(1), F.length(token) - 3))
        .when(token.endswith("s") & (F.length(token) > 4), token.substr(F.lit(1), F.length(token) - 1))
        .otherwise(token)
    )
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.when(token.isin(list(ALIASES)), F.element_at(alias, token)).otherwise(out)


def tokens(text: Column) -> Column:
    """Normalised tokens in order: camel case is split, then runs of ASCII letters and digits."""
    split = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(F.lower(split), F.lit("[a-z0-9]+"), F.lit(0)), normalized)


def query_terms(question: str) -> list[str]:
    """The terms of a question, on the driver: it is a parameter and not data."""
    import re

    def norm(t: str) -> str:
        if t in ALIASES:
            return ALIASES[t]
        for end, least, put in (("ies", 4, "y"), ("ing", 5, ""), ("s", 4, "")):
            if t.endswith(end) and len(t) > least:
                return t[: -len(end)] + put
        return t

    found = re.findall("[a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", question).lower())
    return list(dict.fromkeys(t for t in map(norm, found) if t not in STOP_WORDS))


def line_count(text: Column) -> Column:
    """Line ends, plus one for a last line without one."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return ends + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def lines(text: Column) -> Column:
    """Lines without their ends; a closing line end opens no further line."""
    split = F.split(text, "\n", -1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def preview(text: Column, n: int = 220) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")), 1, n)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def intent(question: Column) -> Column:
    q, out = F.lower(question), F.lit("explanatory")
    for name, phrases in reversed(INTENTS):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | q.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out
