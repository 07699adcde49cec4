"""Quality rules: length, repetition, and divergence from language references.

Each text gets two histograms, of character classes and of common words, which are compared with the
summed histograms of its language by Jensen-Shannon distance. Both distances are judged only on texts
long enough for their histogram to mean something.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import SPACE, fresh, words

#: Frequent words of each language, as they stand inside a sentence.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"],
}
#: Character classes beside white space and, as the rest, lower-case ASCII letters.
CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "stop": "[.,;:?'\"()-]",
    "symbol": "[#*$%&|<>!@^_=+~{}/\\[\\]\\\\`]",
    "other": "[^\\x00-\\x7F]",
}
SYMBOLS = r"[#*$%&|<>]"
#: White space and lower-case ASCII letters: most of a text, and in none of CLASSES. Spelled out, as ranges take longer to match.
COMMON_CHARS = f"[{ascii_lowercase}\\x20\\x09\\x0A\\x0B\\x0C\\x0D]+"
#: Places in the histogram of character classes.
SPACES, UPPER, SYMBOL, BINS = 1, 2, 2 + list(CLASSES).index("symbol"), 2 + len(CLASSES)
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})


@dataclass(frozen=True)
class Limits:
    """min_words, max_repeat: base rules. The rest: distances allowed, and from which length they are judged."""

    min_words: int = 50
    max_repeat: int = 50
    #: Of the root of the sum of both distances' squares.
    max_distance: float = 0.32
    char_guard: int = 200
    word_guard: int = 50
    #: A histogram of n words lies about sqrt(noise / n) from its own source by chance.
    noise: float = 2.0
    #: References are summed over texts of at least min_words with fewer symbols and capitals than these shares.
    clean_symbols: float = 0.01
    clean_upper: float = 0.20


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) for an f that reads value in a lambda: a column would be taken out of its row, or worked out, again for each element."""
    return F.transform(F.array(value), f)[0]


def _char_counts(text: Column, w: Column, short: Column) -> Column:
    """short: text without COMMON_CHARS, which is all that the patterns look at."""
    space = (F.length(text) - F.length(F.array_join(w, ""))).cast("double")
    rare = [F.regexp_count(short, F.lit(p)).cast("double") for k, p in CLASSES.items() if k != "other"]
    other = F.length(F.regexp_replace(short, "[\\x00-\\x7F]+", "")).cast("double")
    return F.array(space, *rare, other)


def _with_histograms(docs: DataFrame, text: Column, w: str, names: dict[str, str]) -> DataFrame:
    """Adds the text without COMMON_CHARS, and counts by character class and by common word; w names the array of words."""
    df = docs.withColumn(names["short"], F.regexp_replace(text, COMMON_CHARS, ""))
    df = df.withColumn(names["rare"], _char_counts(text, F.col(w), F.col(names["short"])))
    rest = F.length(text) - F.aggregate(F.col(names["rare"]), F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn(names["chars"], F.concat(F.array(rest), F.col(names["rare"]))).drop(names["rare"])
    common = F.concat(F.lit(" "), F.array_join(F.filter(F.col(w), lambda x: x.isin(VOCABULARY)), "  "), F.lit(" "))
    df = df.withColumn(names["common"], common)
    size = F.octet_length(F.col(names["common"]))
    hits = [((size - F.octet_length(F.replace(F.col(names["common"]), F.lit(f" {v} "), F.lit("")))) / (len(v.encode()) + 2)).cast("double") for v in VOCABULARY]
    df = df.withColumn(names["hits"], F.array(*hits)).drop(names["common"])
    rest = F.size(F.col(w)) - F.aggregate(F.col(names["hits"]), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(names["hist"], F.concat(F.array(rest), F.col(names["hits"]))).drop(names["hits"])


def references(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Character and word shares by language, summed over all documents that are plain prose by their shares of symbols and capitals.

    One row for each language of the corpus reaches the driver, whatever its size. A language without plain prose has
    no reference; one that COMMON_WORDS lacks has its own shares of the listed words, and mostly the class of other words.
    """
    df = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(lang).alias("l")).filter(F.col("l").isNotNull())
    df = df.withColumn("w", words(F.col("t")))
    df = _with_histograms(df, F.col("t"), "w", {k: k for k in ("short", "rare", "chars", "common", "hits", "hist")})
    n, m, size = BINS, len(VOCABULARY) + 1, F.length("t")
    # a flag and no filter, which the optimizer would move below the histograms and so count words twice
    df = df.withColumn("ok", (F.size("w") >= limits.min_words) & (F.col("chars")[SYMBOL] <= limits.clean_symbols * size) & (F.col("chars")[UPPER] <= limits.clean_upper * size))

    def total(counts: str, i: int) -> Column:  # of whole numbers, so the order of the rows is of no account
        return F.sum(F.when(F.col("ok"), F.col(counts)[i].cast("long"))).alias(f"{counts}{i}")

    sums = df.groupBy("l").agg(*[total("chars", i) for i in range(n)], *[total("hist", i) for i in range(m)])
    out = {}
    for r in sums.collect():
        chars, hist = [r[f"chars{i}"] or 0 for i in range(n)], [r[f"hist{i}"] or 0 for i in range(m)]
        if sum(chars) and sum(hist):
            out[r["l"]] = ([x / sum(chars) for x in chars], [x / sum(hist) for x in hist])
    return out


def _repeated(h: Column) -> Column:
    """Hashes that may come twice, as structs of h and place i in order; those that do are all among them.

    Numbers sort much faster than structs: a hash whose last bits give way to its place tells by its first ones which can be equal.
    """
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(h)))) - 1
    put = _once(F.lit(2**63 - 1) - low, lambda high: F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))

    def alike(s: Column, b: Column) -> Column:
        next_ = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x.bitwiseXOR(y) <= b, F.array(x, y)))
        return F.transform(F.array_distinct(F.flatten(F.array_compact(next_))), lambda x: x.bitwiseAND(b).cast("int"))

    some = _once(low, lambda b: _once(F.sort_array(put), lambda s: alike(s, b)))
    return F.sort_array(_once(h, lambda a: F.transform(some, lambda i: F.struct(a[i].alias("h"), i.alias("i")))))


def _shares(counts: str, total: Column) -> Column:
    return F.transform(F.col(counts), lambda x: F.when(total > 0, x / total).otherwise(0.0))


def _constant(xs: list[float]) -> Column:
    """An array as one literal: hundreds of literals would slow the optimizer."""
    return F.split(F.lit(",".join(map(repr, xs))), ",").cast("array<double>")


def _divergence(share: Column, reference: Column) -> Column:
    """Jensen-Shannon divergence (base 2), the square of the distance, of two arrays of shares."""

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)).otherwise(q)

    return F.greatest(F.lit(0.0), F.aggregate(F.zip_with(share, reference, term), F.lit(0.0), lambda a, x: a + x) / 2)


def judged(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang", refs: dict | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    A null or empty text has no words and fails. A text whose language is null, has no reference or is farther
    than allowed is compared with all references, and the nearest counts; with no reference at all only the
    base rules apply. Ties and
    repeated rows are judged alike, as each row is judged on its own; an empty table gives an empty table.
    Columns of docs with the names added here are replaced.
    """
    refs = references(docs, limits, text, lang) if refs is None else refs
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    df = docs.drop(*[c for c in docs.columns if c.lower() in added and c not in (text, lang)])
    columns = df.columns
    n = {k: fresh(df, f"qr_{k}") for k in ("text", "w", "short", "rare", "chars", "common", "hits", "hist", "h", "lines", "sorted", "at", "own", "near", "size", "c")}
    df = df.withColumn(n["text"], F.coalesce(F.col(text), F.lit("")))
    t = F.col(n["text"])
    df = df.withColumn(n["w"], words(t))
    df = _with_histograms(df, t, n["w"], n)
    w = F.col(n["w"])
    df = df.withColumn("n_words", F.size(w).cast("long")).withColumn("word_chars", (F.length(t) - F.col(n["chars"])[SPACES]).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(n["short"], F.lit(SYMBOLS)).cast("long")).drop(n["short"])
    df = df.withColumn(n["lines"], F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size(n["lines"]) - F.size(F.array_distinct(n["lines"]))).cast("long"))
    # three-word windows as hashes; positions are looked at only where a hash comes twice
    windows = _once(w, lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, a[i + 1], a[i + 2])))
    df = df.withColumn(n["h"], windows).drop(n["w"], n["lines"])
    h = F.col(n["h"])
    df = df.withColumn(n["sorted"], F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated(h))).drop(n["h"])

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))

    df = df.withColumn(n["at"], F.sort_array(F.transform(_once(F.col(n["sorted"]), twice), lambda x: x["i"]))).drop(n["sorted"])
    after = _once(F.col(n["at"]), lambda at: F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))))
    covered = F.aggregate(after, F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(n["at"])
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    if refs:
        df = df.withColumn(n["size"], F.length(t)).drop(n["text"])
        size = F.col(n["size"])
        df = df.withColumn(n["chars"], _shares(n["chars"], size)).withColumn(n["hist"], _shares(n["hist"], F.col("n_words")))
        each = {k: F.struct(_constant(c).alias("c"), _constant(h).alias("h")) for k, (c, h) in sorted(refs.items())}

        def against(r: Column) -> Column:  # each divergence stands in here once, as it is evaluated wherever it stands
            c = F.when(size >= limits.char_guard, _divergence(F.col(n["chars"]), r["c"])).otherwise(0.0)
            d = F.when(F.col("n_words") >= limits.word_guard, F.greatest(F.lit(0.0), _divergence(F.col(n["hist"]), r["h"]) - limits.noise / F.col("n_words"))).otherwise(0.0)
            return F.struct(c.alias("c"), d.alias("d"))

        def both(x: Column) -> Column:
            return F.struct((x["c"] + x["d"]).alias("both"), x["c"].alias("c"), x["d"].alias("d"))

        own = F.lit(None)
        for k, v in each.items():
            own = F.when(F.col(lang) == k, v).otherwise(own)
        df = df.withColumn(n["c"], own)
        df = df.withColumn(n["own"], F.when(F.col(n["c"]).isNotNull(), against(F.col(n["c"])))).drop(n["c"])
        own, most = F.col(n["own"]), limits.max_distance**2
        # a text far from its own language is compared with the others: it may quote them or be labelled wrongly
        nearest = F.array_min(F.transform(F.transform(F.array(*each.values()), against), both))
        df = df.withColumn(n["near"], F.when(own["c"] + own["d"] <= most, both(own)).otherwise(nearest)).drop(n["own"])
        near = F.col(n["near"])
        df = df.withColumn("char_distance", F.round(F.sqrt(near["c"]), 6)).withColumn("word_distance", F.round(F.sqrt(near["d"]), 6))
        df = df.withColumn("kept", ~F.col("base_failed") & (near["both"] <= most))
    else:
        df = df.withColumn("char_distance", F.lit(0.0)).withColumn("word_distance", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    return df.select(*[F.col(f"`{c}`") for c in columns], *added)


def accepted(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of docs that are kept, with their columns as they are, whatever their names.

    Null and empty texts go, as they fail the base rules; repeated rows go or stay together; an empty table stays empty.
    """
    hidden = {c: f"qa_{i}" for i, c in enumerate(docs.columns)}
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in hidden.items()])
    df = judged(df, limits, hidden[text], hidden[lang])
    # the row number keeps the optimizer from moving the filter below the histograms, which would repeat their work
    df = df.withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0)).filter("kept")
    return df.select(*[F.col(n).alias(c) for c, n in hidden.items()])
