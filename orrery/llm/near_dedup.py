"""Near-duplicate documents by HyperMinHash.

Each set of word shingles becomes registers that hold, for the smallest hash in each bucket, its count of leading zeros and
some mantissa bits. Bands of registers bring sets together; an estimate of the Jaccard index, corrected for registers that
agree by chance, leaves those worth an exact comparison of full sets. Equal sets are one node from the start.

Within a band's group every node meets the group's head first, the member that shares most bands with others: near copies of
one text are connected by one comparison each. Groups that are not connected by then are dealt into blocks. In a block the
registers tell which nodes may be near one of another component, and only those meet once more, with full sets. Nothing is
written out that grows with the square of a group: blocks give nodes first and then a spanning forest of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import durable, fresh, small
from orrery.llm.learning import pieces, texts_of

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Near:
    """shingle: words each. percent: least Jaccard index, in hundredths. bands * rows registers of 6 + mantissa bits.

    deviations: of the estimate, below which a pair is not compared (at exactly 0.8 and 250 used registers a chance of about
    2e-8; sharing no band at all has one of 3e-9). block: nodes of a block's side, where `long` shingles count as one node more.
    Up to broadcast_ids ids are sent to every executor instead of shuffling texts.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 50
    rows: int = 5
    mantissa: int = 10
    deviations: float = 6.0
    block: int = 1024
    long: int = 2048
    broadcast_ids: int = 1_000_000


class _Words(dict):
    """Hashes of words, forgotten when there are too many."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    h = (h ^ (h >> np.uint64(32))) * _C
    return h ^ (h >> np.uint64(32))


def shingles(text: str, n: int, known: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; with fewer words, of the whole sequence. Only A-Z fold."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(known.__getitem__, words)), np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size if size < n else 0, np.uint64)
    for k in range(size):
        out = _mix(out * _A + h[k : len(h) - size + 1 + k] + np.uint64(k + 1))
    return np.unique(out)


def registers(hashes: np.ndarray, s: Near) -> np.ndarray:
    """For each bucket's smallest hash, leading zeros and mantissa; 0 for an empty bucket."""
    n = s.bands * s.rows
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, bucket.astype(np.int64), np.minimum(_mix(hashes * _B), np.uint64(0xFFFFFFFFFFFFFF00)))
    fraction, exponent = np.frexp(low.astype(np.float64))
    zeros = np.minimum(64 - exponent + 1, (1 << (16 - s.mantissa)) - 1)
    reg = (zeros << s.mantissa) + ((fraction - 0.5) * 2 * (1 << s.mantissa)).astype(np.int64).clip(0, (1 << s.mantissa) - 1)
    return np.where(low == np.iinfo(np.uint64).max, 0, reg).astype(np.uint16)


def _hops(n: int, tries: int = 64) -> np.ndarray:
    """For each register, where it looks for a value in turn; the same for every document."""
    j, t = np.arange(1, n + 1, dtype=np.uint64)[:, None], np.arange(1, tries + 1, dtype=np.uint64)[None]
    return (_mix(j * _A + _mix(t * _B)) % np.uint64(n)).astype(np.int64)


def filled(reg: np.ndarray, hops: np.ndarray) -> np.ndarray:
    """reg with each empty register taking that of the first filled one on its own path.

    Small sets leave most registers empty, and bands of empty ones would bring together whatever shares one common shingle.
    Filled this way two registers still agree with the chance of the Jaccard index.
    """
    full = np.flatnonzero(reg)
    out, open_ = reg.copy(), np.flatnonzero(reg == 0)
    for t in range(hops.shape[1]):
        if not len(open_):
            return out
        out[open_] = reg[hops[open_, t]]
        open_ = open_[out[open_] == 0]
    out[open_] = reg[full[np.searchsorted(full, open_) % len(full)]]
    return out


def band_keys(reg: np.ndarray, s: Near, hops: np.ndarray) -> np.ndarray:
    """A hash of each band's registers, empty ones filled first; none for a set without a shingle."""
    if not reg.any():
        return np.zeros(0, np.int64)
    rows = filled(reg, hops).reshape(s.bands, s.rows).astype(np.uint64)
    key = np.arange(1, s.bands + 1, dtype=np.uint64)
    for k in range(s.rows):
        key = _mix(key * _A + rows[:, k] + np.uint64(1))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, s: Near) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard index by the share of agreeing registers, less those that agree by chance, and its standard deviation."""
    used = ((a > 0) | (b > 0)).sum(-1)
    agree = ((a == b) & (a > 0)).sum(-1)
    chance = 0.169919487159739 / (1 << s.mantissa)
    p = s.percent / 100
    return (agree / np.maximum(used, 1) - chance) / (1 - chance), np.sqrt(p * (1 - p) / np.maximum(used, 1))


def _likely(a: list[bytes], b: list[bytes], s: Near) -> tuple[np.ndarray, np.ndarray]:
    n = s.bands * s.rows
    x, y = (np.frombuffer(b"".join(r), np.uint16).reshape(-1, n) for r in (a, b))
    got, deviation = estimate(x, y, s)
    return got, got >= s.percent / 100 - s.deviations * deviation


def signatures(docs: DataFrame, s: Near) -> DataFrame:
    """doc_id, n, key (of the whole set), reg, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hops = _Words(), _hops(s.bands * s.rows)
        for batch in batches:
            texts, ids = texts_of(batch, "text"), batch.column("doc_id")
            for part in pieces(texts):
                n, key, reg, bands = [], [], [], []
                for t in texts[part]:
                    h = shingles(t, s.shingle, known)
                    n.append(len(h))
                    key.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else b"")
                    r = registers(h, s)
                    reg.append(r.tobytes() if len(h) else b"")
                    bands.append(band_keys(r, s, hops))
                ends = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, part.stop - part.start), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(reg, pa.binary()), lists], names=["doc_id", "n", "key", "reg", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n long, key binary, reg binary, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, s: Near) -> DataFrame:
    """id and full set of every text of the documents in ids (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            texts, ids_ = texts_of(batch, "text"), batch.column("id")
            for part in pieces(texts):
                sets = [shingles(t, s.shingle, known).view(np.int64) for t in texts[part]]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                out = pa.RecordBatch.from_arrays([ids_.slice(part.start, part.stop - part.start), lists], names=["id", "set"])
                yield out.filter(pa.array(np.diff(ends) > 0))

    ids = F.broadcast(ids) if small(ids, s.broadcast_ids) else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    return texts.join(ids, "id", "left_semi").mapInArrow(run, "id long, set array<long>")


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one task (g, i, j), which follow one another and may go over the border of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("g", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _in_tasks(rows: DataFrame) -> DataFrame:
    """Rows (g, i, j, ...) of a task side by side in one partition; a task's size is bounded by what deals the rows."""
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def _arrays(task: pa.Table, *names: str) -> list[np.ndarray]:
    return [task.column(n).to_numpy() for n in names]


def _suspects(task: pa.Table, s: Near, hops: np.ndarray) -> np.ndarray:
    """Places of the task's rows that may be near a row of the other side and of another component.

    A pair counts in the first band that it shares and in no other.
    """
    ids, comp, n, left, right = _arrays(task, "id", "component", "n", "left", "right")
    reg = np.frombuffer(b"".join(task.column("reg").to_pylist()), np.uint16).reshape(len(ids), -1)
    at = task.column("at")[0].as_py()
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    hit = np.zeros(len(ids), bool)
    known: dict[int, np.ndarray] = {}

    def band_rows(i: int) -> np.ndarray:
        if i not in known:
            known[i] = filled(reg[i], hops).reshape(s.bands, s.rows)
        return known[i]

    step = max(1, 8192 // max(1, len(b)))
    for start in range(0, len(a), step):
        part = a[start : start + step]
        open_ = (comp[part, None] != comp[None, b]) & (100 * np.minimum(n[part, None], n[None, b]) >= s.percent * np.maximum(n[part, None], n[None, b]))
        open_ &= ~(right[part, None] & left[None, b] & (part[:, None] >= b[None]))
        x, y = np.nonzero(open_)
        x, y = part[x], b[y]
        if len(x):
            got, deviation = estimate(reg[x], reg[y], s)
            near = np.flatnonzero(got >= s.percent / 100 - s.deviations * deviation)
            for i, j in zip(x[near].tolist(), y[near].tolist()):
                if hit[i] and hit[j]:
                    continue
                if not (band_rows(i)[:at] == band_rows(j)[:at]).all(1).any():
                    hit[i] = hit[j] = True
    return np.flatnonzero(hit)


def _forest(task: pa.Table, s: Near) -> tuple[list[int], list[int]]:
    """Links between rows of the two sides whose full sets are near, one for each time that two components meet."""
    ids, root, left, right = _arrays(task, "id", "component", "left", "right")
    root = root.copy()
    sets = task.column("set").combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    n = np.diff(sets.offsets.to_numpy())
    values, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(n)))
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    mark = np.zeros(len(values), np.uint8)
    out: tuple[list[int], list[int]] = ([], [])
    for x in a.tolist():
        open_ = (root[b] != root[x]) & (100 * np.minimum(n[b], n[x]) >= s.percent * np.maximum(n[b], n[x]))
        if right[x]:
            open_ &= ~(left[b] & (b <= x))
        y = b[open_]
        if not len(y):
            continue
        own = codes[ends[x] : ends[x + 1]]
        mark[own] = 1
        starts = np.concatenate(([0], np.cumsum(n[y])))
        other = codes[np.repeat(ends[y] - starts[:-1], n[y]) + np.arange(starts[-1])]
        both = np.add.reduceat(mark[other], starts[:-1], dtype=np.int64)
        mark[own] = 0
        for z in y[100 * both >= s.percent * (n[x] + n[y] - both)].tolist():
            if root[z] != root[x]:
                out[0].append(int(ids[x]))
                out[1].append(int(ids[z]))
                root[root == root[z]] = root[x]
    return out


def _verified(rows: DataFrame, s: Near) -> DataFrame:
    """Links (a, b) of tasks of rows (g, i, j, id, component, left, right, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _tasks(batches):
            a, b = _forest(task, s)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _in_tasks(rows).mapInArrow(run, "a long, b long")


def _dealt(member: DataFrame, s: Near) -> DataFrame:
    """Rows (g, id, component, n, ...) of groups, dealt into tasks (i, j) of two blocks each: adds i, j, left, right.

    The largest component of a group is dealt into blocks of its own, which meet only blocks of the other components; those
    meet one another too. A row comes once for each block it meets, and a block has a bounded size.
    """
    weight = 1 + F.floor(F.col("n") / s.long)
    per = member.groupBy("g", "component").agg(F.sum(weight).alias("c"))
    main = per.groupBy("g").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("big"), F.sum("c").alias("all"))
    df = member.join(main, "g")
    of_main = F.col("component") == F.col("main")
    blocks = F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("big")) / s.block)).cast("int")
    wide = F.ceil(F.col("big") / s.block).cast("int")
    df = df.withColumn("block", F.when(of_main, -1 - F.pmod(F.xxhash64("id"), wide)).otherwise(F.pmod(F.xxhash64("id"), blocks)).cast("int"))
    others, mains = F.sequence(F.lit(0), blocks - 1), F.sequence(F.lit(0), wide - 1)
    block = F.col("block")
    with_main = F.transform(others, lambda x: F.struct(x.alias("i"), block.alias("j")))
    with_others = F.transform(others, lambda x: F.struct(F.least(x, block).alias("i"), F.greatest(x, block).alias("j")))
    to_main = F.transform(mains, lambda x: F.struct(block.alias("i"), (-1 - x).alias("j")))
    df = df.withColumn("task", F.explode(F.when(of_main, with_main).otherwise(F.concat(with_others, to_main))))
    df = df.withColumn("left", block == F.col("task.i")).withColumn("right", block == F.col("task.j"))
    return df.select("task.i", "task.j", *[c for c in df.columns if c not in ("main", "big", "all", "block", "task", "i", "j")])


def _star_links(docs: DataFrame, pairs: DataFrame, s: Near) -> tuple[DataFrame, DataFrame]:
    """Links among pairs (a: head, b) by full sets, and the sets. A head meets its nodes in tasks of bounded size."""
    pairs = pairs.select("a", "b")
    sets = durable(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), s))
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).select("a", F.ceil(F.col("c") / s.block).cast("int").alias("parts"))
    nodes = pairs.join(per, "a").select(F.col("a").alias("g"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("i"), F.col("b").alias("id"), F.lit(False).alias("left"))
    heads = per.select(F.col("a").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("a").alias("id"), F.lit(True).alias("left"))
    rows = heads.unionByName(nodes).join(sets, "id")
    rows = rows.select("g", "i", F.lit(0).alias("j"), "id", F.col("id").alias("component"), "left", (~F.col("left")).alias("right"), "set")
    return durable(_verified(rows, s)), sets


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of links (a, b): the smallest id that can be reached.

    Each round takes the smallest label of neighbours and then the label of the label, so rounds grow with the
    logarithm of the longest chain.
    """
    edges = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = durable(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = edges.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = state.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = state.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = durable(new.join(up, "component", "left").select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component")))
        state = new.select("id", "component")
        if not new.filter("component < old").take(1):
            return state


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """state (id, component) after links (a, b) between any ids."""
    a = state.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = state.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    between = links.join(a, "a").join(b, "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    up = components(between).select(F.col("id").alias("component"), F.col("component").alias("up"))
    return durable(state.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")))


def _estimated(pairs: DataFrame, nodes: DataFrame, s: Near) -> DataFrame:
    """pairs (a, b) whose sizes and registers allow a link."""
    a = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("reg").alias("ra"))
    b = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("reg").alias("rb"))
    df = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= s.percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, keep = _likely(batch.column("ra").to_pylist(), batch.column("rb").to_pylist(), s)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return df.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _block_links(docs: DataFrame, member: DataFrame, nodes: DataFrame, state: DataFrame, sets: DataFrame, s: Near) -> DataFrame:
    """Links (a, b) between nodes that share a band and are in different components of state; sets: those known already."""
    df = member.join(state, "id")
    open_ = df.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band")
    df = df.join(open_, "band").join(nodes.select("id", "n", "reg"), "id").withColumnRenamed("band", "g")
    rows = _dealt(df.select("g", "id", "component", "n", "at", "reg"), s)
    size = s.bands * s.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hops = _hops(size)
        for task in _tasks(batches):
            if len(found := _suspects(task, s, hops)):
                yield from task.select(["g", "id", "component", "n"]).take(pa.array(found)).to_batches()

    suspects = durable(_in_tasks(rows).mapInArrow(run, "g long, id long, component long, n long").distinct())
    ids = suspects.select("id").distinct()
    missing = ids.join(sets.select("id").distinct(), "id", "left_anti")
    rest = durable(full_sets(docs, durable(missing), s))
    tasks = _dealt(suspects, s).join(sets.unionByName(rest), "id")
    return _verified(tasks.select("g", "i", "j", "id", "component", "left", "right", "set"), s)


def classes(docs: DataFrame, s: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    A null or empty text, or one of white space alone, has no shingle and is linked with nothing. Rows of one doc_id are
    one document, linked by any of their texts; a row without doc_id takes no part, has no component_id and is kept. A text
    of any length goes through as a whole. An empty table gives an empty table; other columns are not read.
    """
    sig = durable(signatures(docs, s))
    whole = sig.filter("n > 0 and doc_id is not null")
    nodes = whole.groupBy("key").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n", "reg", "bands")])
    nodes = durable(nodes)
    bands = nodes.select("id", F.posexplode("bands").alias("at", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    member = durable(bands.join(shared, "band").select("band", "id", "at", "c"))
    # who shares most bands with others stands nearest to what a group has in common
    pop = member.groupBy("id").agg(F.sum("c").alias("pop"))
    heads = member.join(pop, "id").groupBy("band").agg(F.max(F.struct("pop", (-F.col("id")).alias("m"))).alias("h"))
    star = member.join(heads.select("band", (-F.col("h.m")).alias("a")), "band").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    links, sets = _star_links(docs, durable(_estimated(star, nodes, s)), s)
    rows = whole.select("doc_id", "key").join(nodes.select("key", "id"), "key").select("doc_id", "id")
    several = rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z").select("doc_id", "a")
    links = links.unionByName(rows.join(several, "doc_id").filter("a <> id").select("a", F.col("id").alias("b")).distinct())
    state = nodes.select("id").distinct().join(components(links), "id", "left")
    state = durable(state.select("id", F.coalesce("component", "id").alias("component")))
    state = _merged(state, durable(_block_links(docs, member.select("band", "id", "at"), nodes, state, sets, s)))
    by_key = nodes.select("key", "id").join(state, "id").select("key", "component")
    out = sig.select("doc_id", "n", "key").join(by_key, "key", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, s: Near = Near()) -> DataFrame:
    """Rows of docs without those of which an equal or near document stays; of repeated rows of one doc_id the first text stays.

    Rows without doc_id stay, as do null and empty texts. Columns stay as they are, whatever their names; an empty table
    gives an empty table.
    """
    found = durable(classes(docs.select("doc_id", "text"), s))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("doc_id")).distinct()
    gone = F.broadcast(gone) if small(gone, s.broadcast_ids) else gone
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(gone, "doc_id", "left_anti").select(*columns)
    again = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if not again.take(1):
        return out
    again = F.broadcast(again) if small(again, s.broadcast_ids) else again
    row = fresh(docs, "nd_row")
    order = Window.partitionBy("doc_id").orderBy("text")
    twice = out.join(again, "doc_id", "left_semi").select(*columns).withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1)
    return out.join(again, "doc_id", "left_anti").select(*columns).unionByName(twice.select(*columns))
