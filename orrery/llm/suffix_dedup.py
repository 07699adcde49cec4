"""Passages that occur more than once, by sorting suffixes.

The suffixes of all texts are never brought to one place. A suffix counts by its first `length` bytes, its window. A window is
dealt by the smallest hash of the k-byte strings in it, so equal windows always meet, and windows that follow one another
mostly share that key and travel as one stretch of text. Keys that occur once are dropped before any text moves, and equal
stretches of one key become one that weighs as many. What meets is sorted deep and shallow: a multikey quicksort orders windows
by their first bytes, and blind tries order the groups that are still equal there. Windows that are equal to the end and weigh
two or more together are repeated. A key with more than `block` stretches is dealt again by longer strings, in the end by whole
windows, so that no task gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import durable, small, spread_join

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that are compared at once.
_WORD = 8


@dataclass(frozen=True)
class Passages:
    """length: bytes of a repeated string. keys: lengths of the strings whose smallest hash deals a window, tried in turn.

    block: stretches of one key in one task. shallow: bytes that the quicksort looks at before tries take over. stretch: most
    windows of a stretch. batch: windows sorted together. Up to broadcast_ids keys of texts are sent to every executor instead
    of shuffling texts.
    """

    length: int = 400
    keys: tuple[int, ...] = (200, 300, 370, 400)
    block: int = 1024
    shallow: int = 16
    stretch: int = 4096
    batch: int = 1 << 17
    broadcast_ids: int = 1_000_000

    @staticmethod
    def of(length: int, **given: int) -> Passages:
        """Settings for another length, its keys in proportion."""
        return Passages(length, tuple(dict.fromkeys(max(1, length * k // 8) for k in (4, 6, 7, 8))), **given)


class _Hashes:
    """Hashes of all k-byte strings of a text, by sums of powers modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, text: np.ndarray, k: int) -> np.ndarray:
        n = len(text)
        if len(self.up) < n + 1:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def smallest(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w that follow one another."""
    if w == 1:
        return h
    n = len(h)
    blocks = np.concatenate([h, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead, back = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def stretches(text: bytes, length: int, k: int, most: int, hashes: _Hashes) -> tuple[np.ndarray, ...]:
    """key, first window, end of windows, and whether the key's string occurs twice, of each stretch of windows that share a key."""
    out, block = [], 1 << 20
    for start in range(0, len(text) - length + 1, block):
        part = np.frombuffer(text, np.uint8, min(block + length - 1, len(text) - start), start)
        h, w = hashes.of(part, k), length - k + 1
        key = smallest(h, w)
        cut = key[1:] != key[:-1]
        first = np.r_[0, np.flatnonzero(cut) + 1]
        end = np.r_[first[1:], len(key)]
        if (end - first).max() > most:
            first = np.concatenate([np.arange(a, b, most) for a, b in zip(first.tolist(), end.tolist())])
            end = np.minimum(np.r_[first[1:], len(key)], first + most)
        # equal windows of one stretch bring its key's string twice
        size = end - first + w - 1
        begin = np.cumsum(size) - size
        same = h[np.arange(size.sum()) + np.repeat(first - begin, size)] == np.repeat(key[first], size)
        out.append((key[first].view(np.int64), first + start, end + start, np.add.reduceat(same, begin, dtype=np.int64) > 1))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _multikey(words: np.ndarray, order: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """order (places of windows) sorted by their first `shallow` bytes, and where groups of equals begin.

    All segments are split at once in each round: by a pivot into less, equal and greater, of which only the equal go on to
    their next bytes. Segments of up to 32 are ordered directly.
    """
    begin, size, depth = np.zeros(1, np.int64), np.array([len(order)]), np.zeros(1, np.int64)
    done = [np.zeros(0, np.int64)]
    while len(begin):
        over = (size < 2) | (depth >= shallow)
        done.append(begin[over])
        begin, size, depth = begin[~over], size[~over], depth[~over]
        if not len(begin):
            break
        little = size <= 32
        seg = np.repeat(np.arange(len(begin)), size)
        first = np.cumsum(size) - size
        at = np.arange(len(seg)) - first[seg] + begin[seg]
        value = words[order[at] + depth[seg]]
        pivot = words[order[begin + size // 2] + depth]
        # for a little segment every distinct value is a class of its own
        side = np.where(value < pivot[seg], 0, np.where(value == pivot[seg], 1, 2))
        by = np.lexsort((np.where(little[seg], value, np.uint64(0)), np.where(little[seg], 0, side), seg))
        order[at] = order[at[by]]
        value, side = value[by], side[by]
        new = np.r_[True, (seg[1:] != seg[:-1]) | np.where(little[seg[1:]], value[1:] != value[:-1], side[1:] != side[:-1])]
        start = np.flatnonzero(new)
        equal = little[seg[start]] | (side[start] == 1)
        size = np.diff(np.r_[start, len(seg)])
        begin, depth = at[start], depth[seg[start]] + np.where(equal, _WORD, 0)
    return order, np.sort(np.concatenate(done))


def _tries(words: np.ndarray, order: np.ndarray, begin: np.ndarray, shallow: int, length: int) -> np.ndarray:
    """Order the groups of order that begin at `begin`, equal so far, by blind tries; gives the class of each place.

    Each round takes a leaf of every group's trie and finds, without looking at any other pair, where each suffix leaves the
    path to that leaf: suffixes that leave at one byte by one letter are a subtree, which a later round orders. Subtrees by
    smaller letters stand before the leaf, the sooner they leave the earlier; the others after it, the sooner the later.
    """
    cls = np.zeros(len(order), np.int64)
    cls[begin] = 1
    cls = np.cumsum(cls)
    size = np.diff(np.r_[begin, len(order)])
    depth = np.full(len(begin), shallow)
    more = size > 1
    begin, size, depth = begin[more], size[more], depth[more]
    fresh = int(cls[-1]) + 1 if len(cls) else 0
    while len(begin):
        seg = np.repeat(np.arange(len(begin)), size)
        at = np.arange(len(seg)) - (np.cumsum(size) - size)[seg] + begin[seg]
        mine, leaf = order[at], order[begin][seg]
        leaves = np.full(len(seg), length)
        letter = np.zeros(len(seg), np.int64)
        side = np.ones(len(seg), np.int8)
        open_ = np.flatnonzero(mine != leaf)
        j = depth[seg]
        while len(open_):
            # the last word of a window may hold bytes behind its end
            x, y = words[mine[open_] + j[open_]], words[leaf[open_] + j[open_]]
            apart = np.flatnonzero(x != y)
            if len(apart):
                a, x, y = open_[apart], x[apart], y[apart]
                bit = 63 - np.floor(np.log2((x ^ y).astype(np.float64))).astype(np.int64)
                # rounding to a float may carry into the next power of two
                bit = np.where((x ^ y) >> (np.uint64(63) - np.minimum(bit, 63).astype(np.uint64)) == 0, bit + 1, bit)
                leave = j[a] + bit // 8
                inside = leave < length
                a, leave, shift = a[inside], leave[inside], ((7 - bit[inside] // 8) * 8).astype(np.uint64)
                leaves[a], letter[a] = leave, (x[inside] >> shift & np.uint64(255)).astype(np.int64)
                side[a] = np.where(x[inside] < y[inside], 0, 2)
            j[open_] += _WORD
            open_ = open_[(leaves[open_] == length) & (j[open_] < length)]
        by = np.lexsort((letter, np.where(side == 0, leaves, -leaves), side, seg))
        order[at] = order[at[by]]
        leaves, letter, side = leaves[by], letter[by], side[by]
        new = np.r_[True, (seg[1:] != seg[:-1]) | (side[1:] != side[:-1]) | (leaves[1:] != leaves[:-1]) | (letter[1:] != letter[:-1])]
        start = np.flatnonzero(new)
        cls[at] = fresh + np.cumsum(new) - 1
        fresh += len(start)
        size = np.diff(np.r_[start, len(seg)])
        more = (size > 1) & (leaves[start] < length)
        begin, size, depth = at[start][more], size[more], leaves[start][more] // _WORD * _WORD
    return cls


def sorted_windows(text: np.ndarray, places: np.ndarray, s: Passages) -> tuple[np.ndarray, np.ndarray]:
    """places of text in the order of the `length` bytes that begin there, and a class of each, one for equal windows.

    Every window ends inside text.
    """
    padded = np.concatenate([text, np.zeros(_WORD, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, _WORD).copy().view(">u8").ravel().astype(np.uint64)
    shallow = min(s.shallow, s.length) // _WORD * _WORD
    order, begin = _multikey(words, places.astype(np.int64), shallow)
    return order, _tries(words, order, begin, shallow, s.length) if len(order) else np.zeros(0, np.int64)


def repeated_windows(chunks: list[bytes], weights: np.ndarray, s: Passages) -> list[np.ndarray]:
    """For each chunk, whether each of its windows weighs two or more together with its equals."""
    size = np.array([len(c) for c in chunks])
    windows = size - s.length + 1
    chunk = np.repeat(np.arange(len(chunks)), windows)
    place = np.arange(len(chunk)) - (np.cumsum(windows) - windows)[chunk] + (np.cumsum(size) - size)[chunk]
    text = np.frombuffer(b"".join(chunks), np.uint8)
    order, cls = sorted_windows(text, place, s)
    back = np.searchsorted(place, order)
    _, cls = np.unique(cls, return_inverse=True)
    heavy = np.bincount(cls, weights[chunk[back]]) >= 2
    hit = np.zeros(len(chunk), bool)
    hit[back] = heavy[cls]
    return np.split(hit, np.cumsum(windows)[:-1])


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return edge[::2], edge[1::2]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, bytes and key (MD5) of the text of every row of docs."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"))
    return df.withColumn("key", F.unhex(F.md5("bytes")))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def signatures(rows: DataFrame, s: Passages) -> DataFrame:
    """doc_id, key, stretches (arrays deal, first, end, twice) of rows (doc_id, bytes, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = [stretches(t, s.length, s.keys[0], s.stretch, hashes) for t in (b.as_py() for b in batch.column("bytes"))]
            columns = [_lists([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], names=["doc_id", "key", "deal", "first", "end", "twice"])

    return rows.mapInArrow(run, "doc_id long, key binary, deal array<long>, first array<long>, end array<long>, twice array<boolean>")


def _cut(rows: DataFrame, s: Passages) -> DataFrame:
    """key, first, stretch (its digest), deal, bytes, weight of the stretches of rows (key, bytes, found, weight); bytes mostly once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for key, text, found, weight in zip(*(batch.column(c) for c in ("key", "bytes", "found", "weight"))):
                key, text, weight, out = key.as_py(), text.as_py(), weight.as_py(), []
                for f in found.as_py():
                    part = text[f["first"] : f["end"] + s.length - 1]
                    digest = xxhash.xxh3_128_digest(f["deal"].to_bytes(8, "little", signed=True) + part)
                    out.append((f["first"], digest, f["deal"], None if digest in seen else part))
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(digest)
                first, digest, deal, part = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(out), pa.binary()), pa.array(first, pa.int64()), pa.array(digest, pa.binary()), pa.array(deal, pa.int64()), pa.array(part, pa.binary()), pa.array([weight] * len(out), pa.int64())],
                    names=["key", "first", "stretch", "deal", "bytes", "weight"],
                )

    return rows.mapInArrow(run, "key binary, first long, stretch binary, deal long, bytes binary, weight long")


def _dealt_again(chunks: DataFrame, k: int, s: Passages) -> DataFrame:
    """above (a stretch), offset, stretch, deal, bytes, weight: stretches of chunks dealt by longer strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for above, text, weight in zip(*(batch.column(c) for c in ("stretch", "bytes", "weight"))):
                above, text, weight = above.as_py(), text.as_py(), weight.as_py()
                deal, first, end, _ = stretches(text, s.length, k, s.stretch, hashes)
                parts = [text[a : b + s.length - 1] for a, b in zip(first.tolist(), end.tolist())]
                # the strings' length goes in, so that stretches of two levels are never taken for one
                digest = [xxhash.xxh3_128_digest(int(d).to_bytes(8, "little", signed=True) + k.to_bytes(4, "little") + p) for d, p in zip(deal, parts)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([above] * n, pa.binary()), pa.array(first), pa.array(digest, pa.binary()), pa.array(deal), pa.array(parts, pa.binary()), pa.array([weight] * n, pa.int64())],
                    names=["above", "offset", "stretch", "deal", "bytes", "weight"],
                )

    return chunks.select("stretch", "bytes", "weight").mapInArrow(run, "above binary, offset long, stretch binary, deal long, bytes binary, weight long")


def _sorted(chunks: DataFrame, s: Passages) -> DataFrame:
    """stretch, first, end of the runs of repeated windows of chunks (deal, part, stretch, bytes, weight), by deal and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int]] = []
        windows, last = 0, None

        def ready() -> pa.RecordBatch:
            cuts = [runs(f) for f in repeated_windows([h[1] for h in held], np.array([h[2] for h in held], float), s)]
            names = [h[0] for h, c in zip(held, cuts) for _ in range(len(c[0]))]
            first, end = (np.concatenate([c[i] for c in cuts]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["stretch", "first", "end"])

        for batch in batches:
            for deal, part, stretch, text, weight in zip(*(batch.column(c).to_pylist() for c in ("deal", "part", "stretch", "bytes", "weight"))):
                if windows >= s.batch and (deal, part) != last:
                    yield ready()
                    held, windows = [], 0
                held.append((stretch, text, min(weight, 2)))
                windows, last = windows + len(text) - s.length + 1, (deal, part)
        if held:
            yield ready()

    dealt = chunks.select("deal", "part", "stretch", "bytes", "weight").repartition("deal", "part").sortWithinPartitions("deal", "part")
    return dealt.mapInArrow(run, "stretch binary, first long, end long")


def _ranges(hits: DataFrame) -> DataFrame:
    """hits (stretch, first, end) with all ranges of a stretch in one row, at most one for each two of its windows."""
    return hits.groupBy("stretch").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))


def _repeated(chunks: DataFrame, level: int, s: Passages) -> DataFrame:
    """stretch, first, end of the repeated windows of chunks (stretch, deal, bytes, weight)."""
    large = durable(chunks.groupBy("deal").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > s.block))
    if not large.take(1):
        return _sorted(chunks.withColumn("part", F.lit(0).cast("long")), s)
    counted = chunks.join(F.broadcast(large), "deal", "left") if small(large, s.broadcast_ids) else spread_join(chunks, large, "deal", "left")
    if level == len(s.keys) - 1:
        # windows of one key are equal here, but for clashes of hashes: any part of a group tells that they are repeated
        return _sorted(counted.withColumn("part", F.pmod(F.xxhash64("stretch"), F.coalesce(F.floor(F.col("n") / s.block), F.lit(1)))), s)
    few = _sorted(counted.filter("n is null").withColumn("part", F.lit(0).cast("long")), s)
    again = durable(_dealt_again(counted.filter("n is not null"), s.keys[level + 1], s))
    below = durable(again.groupBy("stretch").agg(F.first("deal").alias("deal"), F.max("bytes").alias("bytes"), F.sum("weight").alias("weight")))
    found = spread_join(again.select("above", "offset", "stretch"), _ranges(_repeated(below, level + 1, s)), "stretch")
    found = found.select(F.col("above").alias("stretch"), "offset", F.explode("ranges").alias("r"))
    return few.unionByName(found.select("stretch", (F.col("offset") + F.col("r.first")).alias("first"), (F.col("offset") + F.col("r.end")).alias("end")))


def _joined(ranges: DataFrame) -> DataFrame:
    """key, spans: ranges (key, ranges) that overlap or touch made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column("ranges").to_pylist():
                spans: list[dict[str, int]] = []
                for r in sorted(found, key=lambda r: r["begin"]):
                    if spans and r["begin"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], r["end"])
                    else:
                        spans.append(r)
                out.append(spans)
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, kind)], names=["key", "spans"])

    return ranges.mapInArrow(run, "key binary, spans array<struct<begin:long,end:long>>")


def repeats(docs: DataFrame, s: Passages = Passages()) -> tuple[DataFrame, DataFrame]:
    """(key, spans) of every distinct text with a repeated string of `length` bytes, and (key, weight, owner) of all texts.

    A text's key is its MD5; spans are its bytes that such strings cover, in order, none touching another.
    """
    rows = keyed(docs)
    texts = signatures(rows, s).groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("owner"), F.first(F.struct("deal", "first", "end", "twice")).alias("s"))
    texts = durable(texts)
    entries = texts.select("key", "owner", "weight", F.explode(F.arrays_zip("s.deal", "s.first", "s.end", "s.twice")).alias("e"))
    entries = entries.select("key", "owner", "weight", "e.deal", "e.first", "e.end", "e.twice")
    deals = durable(entries.groupBy("deal").agg(F.count(F.lit(1)).alias("rows_"), F.sum("weight").alias("w"), F.max("twice").alias("t")).filter("w > 1 or t"))
    left = spread_join(entries, deals.select("deal"), "deal", counts=deals.select("deal", "rows_"))
    found = durable(left.groupBy(F.col("key").alias("of")).agg(F.first("owner").alias("owner"), F.first("weight").alias("weight"), F.collect_list(F.struct("deal", "first", "end")).alias("found")))
    # one row of each text is cut; its id goes along, so that copies of one text do not come to one task
    same = (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    picked = rows.join(F.broadcast(found.select("of", "owner")), same, "left_semi") if small(found, s.broadcast_ids) else rows
    cut = durable(_cut(picked.join(found, same).select("key", "bytes", "found", "weight"), s))
    # rows of one id and text are cut alike
    members = durable(cut.groupBy("key", "first", "stretch").agg(F.first("deal").alias("deal"), F.first("weight").alias("weight")))
    weights = members.groupBy("stretch").agg(F.first("deal").alias("deal"), F.sum("weight").alias("weight"))
    chunks = durable(weights.join(cut.filter("bytes is not null").groupBy("stretch").agg(F.max("bytes").alias("bytes")), "stretch"))
    hits = spread_join(members, durable(_ranges(_repeated(chunks, 0, s))), "stretch")
    hits = hits.select("key", "first", F.explode("ranges").alias("r"))
    spans = hits.select("key", F.struct((F.col("first") + F.col("r.first")).alias("begin"), (F.col("first") + F.col("r.end") + (s.length - 1)).alias("end")).alias("r"))
    return _joined(spans.groupBy("key").agg(F.collect_list("r").alias("ranges"))), texts.select("key", "weight", "owner")


def removed(docs: DataFrame, s: Passages = Passages()) -> DataFrame:
    """doc_id, n_bytes, spans (what goes: begin, end) and kept (the remaining bytes) of every row of docs (doc_id, text).

    Every byte goes that a string of `length` bytes covers which also begins anywhere else, in another text or the same.
    Repeated rows are texts of their own, so all bytes of a text of `length` or more that comes twice go. A null text counts as
    empty; a text shorter than `length` stays whole, a longer one is read whole, however long; a row without doc_id counts as
    any other. An empty table gives an empty table; other columns are not read.
    """
    spans, texts = repeats(docs, s)
    spans, rows = durable(spans), keyed(docs)
    keys = F.broadcast(spans.select("key")) if small(spans, s.broadcast_ids) else spans.select("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, found in zip(batch.column("bytes"), batch.column("spans")):
                text, at, out = text.as_py(), 0, []
                for r in found.as_py():
                    out.append(text[at : r["begin"]])
                    at = r["end"]
                kept.append(b"".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("spans"), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = "array<struct<begin:long,end:long>>"
    n = F.octet_length("bytes").cast("long").alias("n_bytes")
    hit = spread_join(rows.join(keys, "key", "left_semi"), spans, "key", counts=texts.select("key", F.col("weight").alias("rows_")))
    hit = hit.select("doc_id", n, "spans", "bytes").mapInArrow(run, f"doc_id long, n_bytes long, spans {kind}, kept binary")
    rest = rows.join(keys, "key", "left_anti").select("doc_id", n, F.array().cast(kind).alias("spans"), F.col("bytes").alias("kept"))
    return rest.unionByName(hit)
