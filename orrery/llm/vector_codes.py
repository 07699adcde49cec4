"""Codes for vectors: every part of a vector is named by the nearest entry of a codebook.

Vectors become integers, and equal parts at one position become one row that weighs as many as it stands for. Lloyd rounds run
over these distinct rows alone; only the codebooks, of a fixed size, go between driver and tasks. Codes and errors of distinct
rows are then joined back to vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import durable, spread_join


@dataclass(frozen=True)
class Codes:
    """scale: of components before they are floored. parts of a vector, entries of each codebook (256 at most), Lloyd rounds."""

    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    #: Integers beyond this are brought to it, so that errors stay in 64 bits.
    most: int = 1 << 26


def integers(vectors: DataFrame, s: Codes) -> DataFrame:
    """row, vec_id, label, parts (array of the parts' integers) of vectors whose components are all there and finite."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * s.scale, F.lit(float(-s.most))), F.lit(float(s.most)))).cast("int"))
    df = vectors.filter(x.isNotNull()).filter(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), whole.alias("v"))
    longest = df.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).first()["n"]
    width = -(-longest // s.parts)
    padded = F.concat("v", F.array_repeat(F.lit(0), F.lit(width * s.parts) - F.size("v")))
    return df.withColumn("parts", F.transform(F.sequence(F.lit(0), F.lit(s.parts - 1)), lambda i: F.slice(padded, i * width + 1, width))).drop("v")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower of equals, and its squared distance, exactly."""
    at, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    if not rows.shape[1]:
        return at, error
    largest = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = 4 * rows.shape[1] * largest * largest < 1 << 53
    for start in range(0, len(rows), 4096):
        x = rows[start : start + 4096]
        if exact:
            c = book.astype(np.float64)
            d = (c * c).sum(1) - 2 * (x.astype(np.float64) @ c.T)
        else:
            d = (book * book).sum(1) - 2 * (x @ book.T)
        best = d.argmin(1)
        at[start : start + 4096] = best
        error[start : start + 4096] = ((x - book[best]) ** 2).sum(1)
    return at, error


def _sums(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """position, entry, n, sum (array) of the distinct rows that each entry is nearest to, by weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            position, weight, rows = batch.column("position").to_numpy(), batch.column("weight").to_numpy(), _matrix(batch.column("part"))
            for p in range(len(books)):
                mine = position == p
                at, _ = nearest(rows[mine], books[p])
                np.add.at(n[p], at, weight[mine])
                np.add.at(total[p], at, rows[mine] * weight[mine][:, None])
        for p in range(len(books)):
            used = np.flatnonzero(n[p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[p][used]), pa.array(total[p][used].tolist(), pa.list_(pa.int64()))], names=["position", "entry", "n", "sum"]
            )

    partial = distinct.mapInArrow(run, "position int, entry int, n long, sum array<long>")
    width = books[0].shape[1]
    per = partial.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sum")[i]).alias(f"s{i}") for i in range(width)])
    return per.select("position", "entry", "n", F.array(*[F.col(f"s{i}") for i in range(width)]).alias("sum"))


def codebooks(vectors: DataFrame, distinct: DataFrame, s: Codes) -> list[np.ndarray]:
    """A codebook for each position, from the parts of the smallest vec_ids by Lloyd rounds over distinct rows."""
    first = vectors.filter("vec_id is not null").orderBy("vec_id", "parts").limit(s.entries).select("parts").collect()
    books = [np.array([r["parts"][p] for r in first], np.int64) for p in range(s.parts)]
    for _ in range(s.rounds if first else 0):
        for r in _sums(distinct, books).collect():  # at most entries rows a position
            books[r["position"]][r["entry"]] = np.array(r["sum"], np.int64) // r["n"]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, s: Codes = Codes()) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every vector that takes part, and the codebooks.

    vectors (vec_id, embedding, label): rows whose vector is null or holds a null or non-finite component are left out. Vectors
    shorter than the longest end in zeros, as does a length that the parts do not divide; components beyond `most` after
    scaling count as that. Repeated rows are rows, also among the first entries, where rows of one vec_id go by their parts. A
    row without vec_id gives no first entry and is coded as others are; with no vec_id at all there is no entry and no code
    (null). An empty table gives no row and empty codebooks. Other columns are not read.
    """
    rows = durable(integers(vectors, s).withColumn("row", F.monotonically_increasing_id()))
    parts = rows.select("row", F.posexplode("parts").alias("position", "part"))
    distinct = durable(parts.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")))
    books = codebooks(rows, distinct, s)
    if not len(books[0]):
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            position, matrix = batch.column("position").to_numpy(), _matrix(batch.column("part"))
            at, error = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64)
            for p in range(s.parts):
                mine = position == p
                at[mine], error[mine] = nearest(matrix[mine], books[p])
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), pa.array(at.astype(np.int32)), pa.array(error)], names=["position", "part", "entry", "part_error"])

    coded = distinct.select("position", "part").mapInArrow(run, "position int, part array<int>, entry int, part_error long")
    key = lambda: F.struct("position", "part")
    back = spread_join(durable(parts.select("row", key().alias("of"))), durable(coded.select(key().alias("of"), "entry", "part_error")), "of")
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("of.position", "entry"))), lambda x: F.lpad(F.lower(F.hex(x["entry"])), 2, "0")), "")
    codes = back.groupBy("row").agg(digits.alias("code"), F.sum("part_error").alias("error"))
    return rows.select("row", "vec_id", "label").join(codes, "row").select("vec_id", "label", "code", "error"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """coded (label, error, ...) with label_error: the errors of all rows of a label, nulls together."""
    coded = durable(coded)
    per = coded.groupBy(F.struct("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return spread_join(coded.withColumn("of", F.struct("label")), per, "of").drop("of")
