"""Lines of a file that overlap, joined by stretches of lines, so that one long file is not one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a stretch.
STRETCH = 64


def overlaps(a: DataFrame, b: DataFrame, on: list[str], stretch: int = STRETCH) -> DataFrame:
    """Pairs of rows of a (on, a1, a2) and b (on, b1, b2) with equal `on` whose lines a1 to a2 and b1 to b2 share a line.

    A span comes once for each stretch of lines that it touches, and a pair counts in the first stretch that holds both. Spans
    that end before they begin, or with nulls, overlap nothing; null keys match nothing.
    """
    piece = lambda c: F.floor(F.col(c) / stretch)
    cut = lambda df, s, e: df.filter(F.col(s) <= F.col(e)).withColumn("stretch_", F.explode(F.sequence(piece(s), piece(e))))
    both = cut(a, "a1", "a2").join(cut(b, "b1", "b2"), [*on, "stretch_"])
    return both.filter((F.col("a1") <= F.col("b2")) & (F.col("b1") <= F.col("a2")) & (F.col("stretch_") == F.greatest(piece("a1"), piece("b1")))).drop("stretch_")
