"""What a note says of itself: its title, its headings, its first paragraph, and a summary; and what orients a reader first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import lines

#: Headings that are kept, letters of a summary, headings in a summary, notes that are shown first, and sentences.
HEADINGS, LETTERS, NAMED, FIRST = 40, 360, 6, 5
MARKED, TOP, UNDER = r"^\s{0,3}#{1,6}\s+(.+?)\s*$", r"^\s{0,3}#\s+(.+?)\s*$", r"^\s*(=+|-+)\s*$"
BARE = " is available as guidance-only orientation material."
PACKAGE = " describes package metadata and signals: "
NONE_YET = " has no orientation inventory yet."
SOME = (" has ", " high-priority orientation files available as guidance-only context.")
REASON = " guidance-only material, not proof."


def headings(text: Column, language: Column) -> Column:
    """The first headings in order: of markdown those that are marked, else lines that the next one underlines."""
    rows = lines(text)
    marked = F.transform(F.filter(rows, lambda x: x.rlike(MARKED)), lambda x: F.trim(F.regexp_extract(x, MARKED, 1)))
    pairs = F.zip_with(rows, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda a, b: F.struct(F.trim(a).alias("a"), F.coalesce(b, F.lit("")).alias("b")))
    under = F.transform(F.filter(pairs, lambda x: (x["a"] != "") & x["b"].rlike(UNDER)), lambda x: x["a"])
    return F.slice(F.when(language == "markdown", marked).otherwise(under), 1, HEADINGS)


def title(path: Column, text: Column, language: Column, kind: Column) -> Column:
    """The first top heading of a markdown text, else the name in a package.json, else README, else the file's name."""
    name = F.element_at(F.split(path, "/"), -1)
    top = F.get(F.filter(lines(text), lambda x: x.rlike(TOP)), F.lit(0))
    package = F.when(name == "package.json", F.nullif(F.get_json_object(text, "$.name"), F.lit("")))
    return F.coalesce(F.when(language == "markdown", F.trim(F.regexp_extract(top, TOP, 1))), package, F.when(kind == "readme", "README"), name)


def package_words(text: Column) -> Column:
    """What a package.json says of itself: its description, scripts and dependencies; null where it is no JSON."""
    keys = lambda path: F.coalesce(F.array_join(F.map_keys(F.from_json(F.get_json_object(text, path), "map<string,string>")), " "), F.lit(""))
    said = F.concat_ws(" ", F.coalesce(F.get_json_object(text, "$.description"), F.lit("")), keys("$.scripts"), keys("$.dependencies"))
    return F.when(F.get_json_object(text, "$").isNotNull(), said)


def first_paragraph(text: Column) -> Column:
    """The first lines that follow one another and are neither empty nor marked as a heading, as one line."""
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        gap = (F.trim(x) == "") | F.trim(x).startswith("#")
        kept = F.when(s["done"] | gap, s["kept"]).otherwise(F.concat(s["kept"], F.array(F.trim(x))))
        return F.struct(kept.alias("kept"), (s["done"] | (gap & (F.size(s["kept"]) > 0))).alias("done"))

    return F.array_join(F.aggregate(lines(text), state, step)["kept"], " ")


def described(notes: DataFrame) -> DataFrame:
    """path, kind, title, headings, summary of notes (path, language, kind, text): of a package its own words, else the first paragraph, the sections, or the name."""
    text, name = F.coalesce("text", F.lit("")), F.element_at(F.split("path", "/"), -1)
    package = F.when((F.col("kind") == "manifest") & (name == "package.json"), package_words(text))
    df = notes.select(package.alias("package"), "path", "kind", title(F.col("path"), text, F.col("language"), F.col("kind")).alias("title"), headings(text, F.col("language")).alias("headings"), first_paragraph(text).alias("first"))
    sections = F.concat("title", F.lit(" contains sections: "), F.array_join(F.slice("headings", 1, NAMED), ", "), F.lit("."))
    bare = F.concat(name, F.lit(BARE))
    own = F.concat(name, F.lit(PACKAGE), F.substring("package", 1, LETTERS))
    summary = F.when(F.col("package").isNotNull(), own).when(F.col("first") != "", F.substring("first", 1, LETTERS)).when(F.size("headings") > 0, sections).otherwise(bare)
    return df.select("path", "kind", "title", "headings", summary.alias("summary"))


def reading(items: DataFrame, name: str) -> DataFrame:
    """place, path, label, reason, notes, summary of the first notes of items (path, kind, title, priority), by priority and path.

    notes: how many there are in all; summary: the sentence on the whole, which stands in one row without a place where there is none.
    """
    top = items.orderBy("priority", "path").limit(FIRST)
    top = top.withColumn("place", F.row_number().over(Window.orderBy("priority", "path")))  # as many rows as are shown
    whole = items.agg(F.count(F.lit(1)).alias("notes")).select(F.lit(1).alias("one"), "notes")
    said = F.when(F.col("notes") == 0, F.lit(name + NONE_YET)).otherwise(F.concat(F.lit(name + SOME[0]), F.least(F.col("notes"), F.lit(FIRST)), F.lit(SOME[1])))
    df = whole.join(top.withColumn("one", F.lit(1)), "one", "left")  # one row against those shown
    return df.select("place", "path", F.col("title").alias("label"), F.concat("kind", F.lit(REASON)).alias("reason"), "notes", said.alias("summary"))
