"""Bounded samples of labelled text, and batches of bounded size for scoring whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_texts(docs: DataFrame, chosen: DataFrame, rows: int | None, chars: int, values: list[str]) -> pd.DataFrame:
    """Texts of at most `rows` rows of chosen (doc_id and values), in hash order; with None chosen is bounded already.

    A text longer than `chars` characters gives a stretch of that length, from a place that goes by its id. So rows * chars
    bounds what the driver gets and what is broadcast. Rows without doc_id or text teach nothing; of rows of one doc_id the
    first text in order teaches, with the smallest of each value; an empty table gives no text.
    """
    first = chosen.filter(F.col("doc_id").isNotNull())
    if rows is not None:
        # a hash threshold well above what is needed, so that not the ids of the whole table are grouped
        share = min(1.0, 8 * rows / max(1, first.count()))
        if share < 1:
            first = first.filter(F.xxhash64("doc_id") < int(-(2**63) + share * 2**64))
    first = first.groupBy("doc_id").agg(*[F.min(v).alias(v) for v in values])
    if rows is not None:
        first = first.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = [c for c in docs.columns if c.lower() == "doc_id"][0]
    texts = docs.select(F.col(own).alias("doc_id"), F.col("text").alias("text")).filter(F.length("text") > 0)
    begin = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    out = texts.join(F.broadcast(first), "doc_id").select("doc_id", F.substring(F.col("text"), begin.cast("int"), F.lit(chars)).alias("text"), *values)
    # rows of one doc_id may repeat without end, so the first text of each is found before anything comes to the driver
    out = out.groupBy("doc_id", *values).agg(F.min("text").alias("text")).select("doc_id", "text", *values).toPandas()
    return out.sort_values("doc_id", kind="stable").reset_index(drop=True)


def pieces(texts: list[str], most: int = 2 << 20) -> Iterator[slice]:
    """Slices of texts that hold about `most` characters each; a longer text comes alone."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A column of texts; a null text counts as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def scored(docs: DataFrame, score: Callable[[], Callable[[list[str]], list]], text: str, fields: list[tuple[str, str]]) -> DataFrame:
    """docs without its text column, with what score()(texts) returns for each field (name, type).

    Columns named like a field, in upper or lower case, are replaced.
    """
    added = [f for f, _ in fields]
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), *map(str.lower, added))]
    df = docs.select(*[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = score()
        for batch in batches:
            texts = texts_of(batch, "text_")
            batch = batch.drop_columns(["text_"])
            for part in pieces(texts):
                got = [pa.array(x) for x in f(texts[part])]
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, *got], names=[*rows.schema.names, *added])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[:-1]] + [f"{f} {kind}" for f, kind in fields])
    out = df.mapInArrow(run, schema)
    return out.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)], *added)


def filtered(docs: DataFrame, keep: Callable[[], Callable[[list[str]], np.ndarray]], text: str) -> DataFrame:
    """Rows of docs for which keep()(texts) is true, as they are; a null text counts as empty, an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = keep()
        for batch in batches:
            texts = texts_of(batch, text)
            for part in pieces(texts):
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(f(texts[part])))

    return docs.mapInArrow(run, docs.schema)
