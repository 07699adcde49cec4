"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, at most `most`, that tilts exponentially with its size: rate = min(most, exp(tilt * size / mean)).
Of all rates that meet the token target of a source these lie nearest to one copy of everything, in relative entropy; the
tilt of each source solves a convex dual problem in one variable, by Newton steps that stay inside a bracket. Rates become
whole copies by a hash of the document, with one threshold per source set so that the words taken meet the target.

All steps are grouped sums. What is joined back is one row for each source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import WORD, durable, fresh, small


@dataclass(frozen=True)
class Mix:
    """weights: by place of the source in code point order, repeating. share: of all words that the mix takes.

    most: copies of a document, and the bound of a target against its source's size. Up to broadcast_sources
    sources are joined by broadcast, more of them by a shuffle.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    iterations: int = 200
    tolerance: float = 1e-9
    bins: int = 1024
    rounds: int = 3
    broadcast_sources: int = 10_000
    seed: int = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact(x: Column) -> Column:
    """Sums of this do not depend on the order of rows."""
    return x.cast("decimal(30,6)")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight; what goes beyond most times a source's size is dealt again by weight.

    Filling up in order of size to weight reaches the same end as repeated dealing: a source is full where the
    level, (what is left) / (weights left), is above its own bound. One row for each source goes through one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("bound", (mix.most * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = mix.share * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / weights).withColumn("full", F.col("bound") <= F.col("level") * F.col("weight"))
    # the first source that is not full sets the level of all after it
    first = F.min(F.when(~F.col("full"), F.col("bound") / F.col("weight"))).over(every)
    level = F.min(F.when((F.col("bound") / F.col("weight") == first) & ~F.col("full"), F.col("level"))).over(every)
    per = per.withColumn("common", level)
    return per.select("source", "source_size", F.when(F.col("full"), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("common") * F.col("weight"))).alias("target"))


def _beside(df: DataFrame, per_source: DataFrame, mix: Mix, key: str = "source") -> DataFrame:
    """Joins one row for each source; null is a source."""
    other = per_source.withColumnRenamed("source", "_source")
    other = F.broadcast(other) if small(per_source, mix.broadcast_sources) else other
    return df.join(other, F.col(key).eqNullSafe(F.col("_source")), "left").drop("_source")


def _rate(tilt: Column, size: Column, mean: Column, full: Column, most: int) -> Column:
    x = tilt * size / mean
    return F.when(full | (x >= F.log(F.lit(float(most)))), F.lit(float(most))).otherwise(F.exp(x))


def tilts(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target, mean, full, tilt) of each source."""
    hist = durable(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    per = targets(sizes, mix).join(hist.groupBy(F.col("source").alias("_s")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    per = per.withColumn("full", (F.col("target") >= mix.most * F.col("source_size")) | F.col("mean").isNull())
    per = per.withColumn("mean", F.coalesce("mean", F.lit(1.0)))
    state = durable(per.withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double")).withColumn("off", F.lit(1.0)))
    for _ in range(mix.iterations):
        df = _beside(hist.withColumnRenamed("source", "s"), state.filter(~F.col("full")), mix, "s").filter(F.col("tilt").isNotNull())
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), F.lit(False), mix.most)
        z = F.col("size") / F.col("mean")
        got = df.groupBy(F.col("s").alias("_s")).agg(
            F.sum(_exact(rate * F.col("size") * F.col("n"))).cast("double").alias("got"),
            F.sum(_exact(F.when(rate < mix.most, rate * z * F.col("size") * F.col("n")).otherwise(0.0))).cast("double").alias("slope"),
        )
        new = state.join(got, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("got") - F.col("target")
        new = new.withColumn("low", F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high"))) & (F.abs(newton - F.col("tilt")) < 4)
        halved = F.when(F.col("low").isNull(), F.col("high") - F.greatest(F.lit(1.0), F.abs("high"))).when(F.col("high").isNull(), F.col("low") + F.greatest(F.lit(1.0), F.abs("low"))).otherwise((F.col("low") + F.col("high")) / 2)
        new = new.withColumn("off", F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)))
        new = new.withColumn("tilt", F.when(F.col("off") <= mix.tolerance, F.col("tilt")).otherwise(F.round(F.when(inside, newton).otherwise(halved), 12)))
        state = durable(new.select(*state.columns))
        # a bracket narrower than the tilt's own digits cannot be halved further
        wide = F.coalesce(F.col("high") - F.col("low"), F.lit(1.0)) > 1e-11
        if not state.filter((F.col("off") > mix.tolerance) & wide).take(1):
            break
    else:
        raise ArithmeticError(f"the tilts have not settled after {mix.iterations} steps")
    return state.select("source", "source_size", "target", "mean", "full", "tilt")


def _height(doc: Column, size: Column, tilt: Column, mean: Column, full: Column, mix: Mix) -> Column:
    """Rate plus a hash in [0, 1): copies are its whole part once the threshold of the source is added."""
    u = F.pmod(F.xxhash64(doc, F.lit(mix.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.round(_rate(tilt, size, mean, full, mix.most), 9) + u


def thresholds(sizes: DataFrame, per: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """per with delta: what to add to each height so that whole copies of a source hold about target words.

    Words taken grow by a document's size where delta passes a whole number less its height. Rounds of binned
    sums, each inside the bin that the last one ended in, find where they pass the target; each gathers at most
    `bins` rows for each source, whatever a source's size.
    """
    df = _beside(sizes.filter("size > 0"), per, mix)
    e = _height(F.col("doc_id"), F.col("size"), F.col("tilt"), F.col("mean"), F.col("full"), mix)
    flips = df.filter(~F.col("full")).select("source", "size", e.alias("e")).select("source", "size", F.explode(F.array(*[F.lit(float(k)) - F.col("e") for k in range(1, mix.most + 1)])).alias("at"))
    state = per.filter(~F.col("full")).select("source", "target", F.lit(float(-mix.most - 1)).alias("low"), F.lit(float(mix.most + 2)).alias("width"), F.lit(0).cast("decimal(38,0)").alias("base"))
    state = durable(state)
    for _ in range(mix.rounds):
        step = F.col("width") / mix.bins
        inside = _beside(flips, state, mix).withColumn("bin", F.floor((F.col("at") - F.col("low")) / step)).filter((F.col("bin") >= 0) & (F.col("bin") < mix.bins))
        binned = inside.groupBy("source", "bin").agg(F.sum(F.col("size").cast("decimal(38,0)")).alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        found = binned.withColumn("upto", upto).withColumnRenamed("source", "_s")
        near = state.drop("words").join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
        over = F.col("base") + F.col("upto") >= F.col("target")
        # the bin in which the target is passed, else the last one
        near = near.groupBy("source", "target", "low", "width", "base").agg(F.min(F.when(over, F.struct("bin", "upto", "words"))).alias("hit"), F.max(F.struct("bin", "upto", "words")).alias("last"))
        near = near.withColumn("hit", F.coalesce("hit", "last"))
        state = durable(near.select("source", "target", F.coalesce(F.col("low") + F.col("hit.bin") * step, F.col("low")).alias("low"), F.when(F.col("hit").isNotNull(), step).otherwise(F.col("width")).alias("width"), F.coalesce((F.col("base") + F.col("hit.upto") - F.col("hit.words")).cast("decimal(38,0)"), F.col("base")).alias("base"), F.coalesce(F.col("hit.words"), F.lit(0)).cast("decimal(38,0)").alias("words")))
    # the last bin holds next to no documents: it is taken whole or not at all, whichever is nearer
    take = (F.col("base") + F.col("words") - F.col("target")) <= (F.col("target") - F.col("base"))
    delta = state.select(F.col("source").alias("_s"), F.when(take, F.col("low") + F.col("width")).otherwise(F.col("low")).alias("delta"))
    return durable(per.join(delta, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def copies(doc: Column, size: Column, mix: Mix = Mix(), names: dict[str, str] | None = None) -> Column:
    """Copies of a document, next to the columns of thresholds(), which may go by other names."""
    tilt, mean, full, delta = (F.col((names or {}).get(c, c)) for c in ("tilt", "mean", "full", "delta"))
    e = _height(doc, size, tilt, mean, full, mix)
    flipped = [F.when(delta > F.lit(float(k)) - e, 1).otherwise(0) for k in range(1, mix.most + 1)]
    return F.when(size <= 0, 0).when(full, mix.most).otherwise(sum(flipped, F.lit(0)))


def plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) of every row, and for each source its target, tilt and threshold."""
    sizes = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return sizes, thresholds(sizes, tilts(sizes, mix), mix)


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs (doc_id, text, source).

    A null or empty text has size 0 and is never taken. A null source is a source of its own, last in order.
    Rows with equal doc_id and size are taken alike; a null doc_id hashes as a value of its own. An empty table
    gives an empty table. Other columns of docs are not read.
    """
    sizes, per = plan(docs, mix)
    df = _beside(sizes, per, mix)
    df = df.withColumn("copies", copies(F.col("doc_id"), F.col("size"), mix))
    return df.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs as the mix takes them: rows without a copy go, others come once for each copy. Columns stay as they are.

    Null and empty texts go; a null source is a source; rows of one id and size go or stay together; an empty table stays
    empty; columns may have any names.
    """
    _, per = plan(docs, mix)
    names = {c: fresh(docs, f"mix_{c}") for c in ("tilt", "mean", "full", "delta", "size", "copy", "source")}
    other = per.select(F.col("source").alias(names["source"]), *[F.col(c).alias(names[c]) for c in ("tilt", "mean", "full", "delta")])
    other = F.broadcast(other) if small(per, mix.broadcast_sources) else other
    df = docs.join(other, F.col("source").eqNullSafe(F.col(names["source"])), "left").withColumn(names["size"], n_words(F.col("text")))
    n = copies(F.col("doc_id"), F.col(names["size"]), mix, names)
    df = df.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(True), n.cast("int"))))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
