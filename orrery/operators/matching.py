"""Which texts hold which patterns, by an index of short runs of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.lineage import durable

#: Letters of a run; a shorter pattern is a run by itself.
RUN = 3
#: Rows of a side that may be broadcast.
FEW = 100_000


def runs(text: Column) -> Column:
    """The distinct runs of one to RUN letters in a text; any characters count as letters."""
    letters = F.split(text, "")
    runs_, out = letters, letters
    for n in range(1, RUN):
        # side by side with the letters further on: no letter is looked up by its place
        runs_ = F.zip_with(runs_, F.slice(letters, n + 1, F.greatest(F.size(letters), F.lit(1))), lambda a, b: F.concat(a, b))
        out = F.concat(out, runs_)
    return F.array_distinct(F.array_compact(out))


def pattern_runs(pattern: Column) -> Column:
    """The distinct runs that every text with this pattern has: those of RUN letters, or the pattern itself."""
    return F.when(F.length(pattern) < RUN, F.array(pattern)).otherwise(F.filter(runs(pattern), lambda r: F.length(r) == RUN))


def _joined(many: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """many with few, which is broadcast if counted small, else both are shuffled.

    Rows that an explode makes do not count in Spark's estimate of a size, so no side may be broadcast by that.
    """
    return many.join(F.broadcast(few) if few.count() <= FEW else few.hint("merge"), on)


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern_id): texts (id, text) that hold a pattern of patterns (pattern_id, pattern), in any case, wherever it stands.

    A pattern is sought under the run of it that fewest texts have, so a common word in it costs nothing; a pattern with a run
    that no text has is out at once. What meets there are ids; each text then comes back once, for the last look. Null or empty
    texts hold nothing and null or empty patterns are held by nothing. ids are of one row each.
    """
    low = patterns.select("pattern_id", F.lower("pattern").alias("low")).filter("low <> ''")
    wanted = low.select("low").distinct().withColumn("run", F.explode(pattern_runs(F.col("low"))))
    posted = texts.filter("text <> ''").select("id", F.explode(runs(F.lower("text"))).alias("run"))
    per = _joined(posted, durable(wanted.select("run").distinct()), "run").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rare = wanted.join(per, "run", "left").groupBy("low").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min_by("run", F.struct("n", "run")).alias("run")).filter("absent = 0")
    met = _joined(posted, durable(rare.select("run", "low")), "run").select("id", "low")
    held = texts.select("id", F.lower("text").alias("in_")).join(met.hint("merge"), "id").filter(F.contains("in_", "low")).select("id", "low")
    return _joined(held, durable(low), "low").select("id", "pattern_id")
