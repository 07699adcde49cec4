"""How filters overlap: what each removes first, again and alone, in every order of them.

A document is reduced to a mask with one bit for each filter that it fails. Counts of masks hold all that any order needs, so
orders are not run over documents: they are visited by swaps of two neighbours, each of which changes only what the two
swapped steps remove, and Shapley sums grow along that walk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import durable, spread_join
from orrery.llm.learning import pieces

#: Letters of the filters, by bit.
FILTERS = "ABCDE"
_COUNTS = ("all", "good", "toxic")


def swaps(n: int) -> Iterator[tuple[list[int], int]]:
    """Every permutation of range(n) and the place of the swap that led to it from the one before (-1 for the first)."""
    order, heading = list(range(n)), [-1] * n
    yield order, -1
    while True:
        # the largest item that looks at a smaller neighbour moves over it; larger ones turn round
        for item in reversed(range(n)):
            at = order.index(item)
            to = at + heading[item]
            if 0 <= to < n and order[to] < item:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        for larger in range(item + 1, n):
            heading[larger] = -heading[larger]
        yield order, min(at, to)


def walked(cells: np.ndarray, n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Orders, removed[order, step, count] and shapley[filter] of cells[mask, count] for n filters.

    shapley: what a filter removes, summed over all orders by the first count.
    """
    masks = np.arange(1 << n)

    def first_to_fail(item: int, before: int) -> np.ndarray:
        return cells[(masks >> item & 1 == 1) & (masks & before == 0)].sum(0)

    names, removed, shapley = [], np.zeros((math.factorial(n), n, cells.shape[1]), np.int64), np.zeros(n, np.int64)
    now = np.zeros((n, cells.shape[1]), np.int64)
    for k, (order, at) in enumerate(swaps(n)):
        for step in range(n) if at < 0 else (at, at + 1):
            now[step] = first_to_fail(order[step], sum(1 << i for i in order[:step]))
        names.append("".join(FILTERS[i] for i in order))
        removed[k] = now
        shapley[order] += now[:, 0]
    return names, removed, shapley


def measures(text: bytes) -> tuple[int, int, int, bool]:
    """Words, distinct words, letters A-Z, and whether a symbol of #$%&*| occurs."""
    words = text.split()
    return len(words), len(set(words)), len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(text.translate(None, b"#$%&*|")) < len(text)


def failing(docs: DataFrame) -> DataFrame:
    """doc_id, part, key (of the text) and mask of filters A to D for every row of docs (doc_id, text, lang)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.select("doc_id", "part", F.length("text").alias("points"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, points = batch.column("text").to_pylist(), batch.column("points").to_pylist()
            for part in pieces(texts):
                masks, keys = [], []
                for t, n in zip(texts[part], points[part]):
                    words, distinct, capitals, symbol = measures(t)
                    masks.append((words < 200) | (100 * distinct < 50 * words) << 1 | (100 * capitals > 3 * n) << 2 | symbol << 3)
                    keys.append(xxhash.xxh3_128_digest(t))
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())], names=["doc_id", "part", "key", "mask"])

    return df.mapInArrow(run, "doc_id long, part string, key binary, mask int")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, all, good, toxic: documents of each part by what they fail, and those of them labelled good or toxic."""
    rows = failing(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("lookup"), F.col("quality").alias("q"), F.col("toxic").alias("t")).filter("lookup is not null")
    marks = marks.groupBy("lookup").agg(F.max((F.col("q") == 1).cast("int")).alias("good"), F.max((F.col("t") == 1).cast("int")).alias("toxic"))
    # repeated rows are counted before the join; a row without doc_id looks up nothing, and its own text spreads such rows
    rows = rows.groupBy("doc_id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n"))
    lookup, known = F.coalesce("doc_id", F.xxhash64("key")), F.col("doc_id").isNotNull()
    rows = rows.withColumn("lookup", lookup).withColumn("known", known).join(marks.withColumn("known", F.lit(True)), ["lookup", "known"], "left")
    # one row a text, part and label: groups of copies shrink before the smallest id of each text is sought
    own = rows.groupBy("key", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    own = own.agg(F.sum("n").alias("n"), F.min(F.when(F.col("known"), F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("nameless"))
    own = durable(own)
    smallest = own.groupBy("key").agg(F.min("least.doc_id").alias("smallest"))
    own = spread_join(own, smallest, "key")
    first = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("smallest"), F.col("least.n")).otherwise(0)
    either = F.array(F.struct("mask", first.alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - first).alias("n")))
    cells = own.select("part", "good", "toxic", F.explode(either).alias("c")).groupBy("part", "c.mask")
    return cells.agg(F.sum("c.n").alias("all"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs (doc_id, text, lang): a null text counts as empty, a null lang as the part "". Repeated rows are rows; rows of one
    doc_id and text have no smaller one and pass E, as does a row without doc_id, which is also no smaller one to others and
    has no label. labels (doc_id, quality, toxic): of repeated ids a mark in any row counts, nulls mark nothing. An empty table
    gives no part and no row. Texts of any length count whole; other columns are not read.
    """
    n = len(FILTERS)
    fields = [("part", "string"), ("filter_order", "string"), ("step", "int"), *[(c, "long") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.arange(1 << n)
        for batch in batches:
            for row in batch.to_pylist():
                cells = np.zeros((1 << n, len(_COUNTS)), np.int64)
                for c in row["cells"]:
                    cells[c["mask"]] = [c[x] for x in _COUNTS]
                orders, removed, shapley = walked(cells, n)
                item = np.array([[FILTERS.index(x) for x in o] for o in orders])
                fails = np.array([cells[masks >> i & 1 == 1, 0].sum() for i in range(n)])
                kept = cells[:, 0].sum() - removed[:, :, 0].cumsum(1)
                gone = removed[:, :, 0]
                columns = [kept, gone, fails[item] - gone, cells[1 << item, 0], removed[:, :, 1], removed[:, :, 2], shapley[item]]
                steps = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))
                names = pa.array([row["part"]] * len(steps)), pa.array(np.repeat(orders, n).tolist())
                yield pa.RecordBatch.from_arrays([*names, pa.array(steps), *[pa.array(c.ravel()) for c in columns]], names=[f for f, _ in fields])

    parts = mask_cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("cells"))
    return parts.mapInArrow(run, ", ".join(f"{f} {kind}" for f, kind in fields))
