"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn and then user and assistant turns in alternation, ending with the assistant.
Dynamic programming over that automaton chooses, for every turn, whether it stays, is merged into the turn before it, gets
another role, or needs an empty turn in front of it, at the least total cost.

A conversation may be of any length: turns are taken in stretches of bounded size, a stretch is summed up as a table of costs
from state to state, and the tables are put together before each stretch is solved for good. Of ways of equal cost the one is
taken that at every turn, from the first on, takes the earliest of the moves that lead to the least total cost. What follows
a stretch is known as the cost left from each state, so the way does not depend on where stretches begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orrery.llm.common import durable

ROLES = ("system", "user", "assistant")
#: States: before the first turn, and after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles of the empty turns to insert between a state and a role that may not follow it.
INSERTS = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    """Costs of the repairs, whole numbers. A stretch has at most `stretch` turns and about `stretch_chars` characters."""

    merge: int = 1
    relabel: int = 3
    insert: int = 2
    stretch: int = 2048
    stretch_chars: int = 4 << 20


def moves(role: str | None, c: Costs) -> list[tuple[int, int, int, tuple]]:
    """(state, next state, cost, (relabelled, merged, inserted)) for one turn; cheapest first, then in a fixed order."""
    out = []
    for state in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            relabel = ROLES[to - 1] != role
            price = c.relabel * relabel
            if state == to:
                out.append((state, to, price + c.merge, (relabel, True, ())))
            if (state, to) in INSERTS:
                ins = INSERTS[state, to]
                out.append((state, to, price + c.insert * len(ins), (relabel, False, ins)))
    return sorted(out, key=lambda m: (m[2], m[3][1], m[0], m[1]))


def ending(state: int, c: Costs) -> int:
    """Cost of ending in a state: a conversation that has turns ends with the assistant."""
    return {START: 0, ASSISTANT: 0, USER: c.insert, SYSTEM: 2 * c.insert}[state]


def table(roles: list[str | None], c: Costs) -> np.ndarray:
    """Least cost from each state before a stretch of turns to each state after it."""
    cost = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(cost, 0)
    step: dict = {}
    for r in roles:
        if r not in step:
            step[r] = np.full((4, 4), FAR, np.int64)
            for a, b, price, _ in moves(r, c):
                step[r][a, b] = min(step[r][a, b], price)
        cost = np.minimum((cost[:, :, None] + step[r][None]).min(1), FAR)
    return cost


def solve(roles: list[str | None], begin: int, rest: list[int], c: Costs) -> list[tuple[int, tuple]]:
    """Role and repairs of each turn on the cheapest way from begin, with rest to pay after the last turn in each state."""
    best = costs_left(roles, rest, c)
    known = {r: moves(r, c) for r in set(roles)}
    out, state = [], begin
    for i, r in enumerate(roles):
        _, to, _, how = next(m for m in known[r] if m[0] == state and m[2] + best[i + 1, m[1]] == best[i, state])
        out.append((to, how))
        state = to
    return out


def costs_left(roles: list[str | None], rest: list[int], c: Costs) -> np.ndarray:
    """Least cost from each state before each turn to the end of the conversation."""
    best = np.full((len(roles) + 1, 4), FAR, np.int64)
    best[len(roles)] = np.minimum(rest, FAR)
    known = {r: moves(r, c) for r in set(roles)}
    for i in range(len(roles) - 1, -1, -1):
        for a, b, price, _ in known[roles[i]]:
            best[i, a] = min(best[i, a], best[i + 1, b] + price)
    return best


def ends_of(roles: list[str | None], rest: list[int], c: Costs) -> list[int]:
    """For each state before a stretch, the state after it on the way that solve() takes."""
    best = costs_left(roles, rest, c)
    known = {r: moves(r, c) for r in set(roles)}
    at = list(range(4))
    for i, r in enumerate(roles):
        go = {}
        for a, b, price, _ in known[r]:
            if a not in go and price + best[i + 1, b] == best[i, a]:
                go[a] = b
        at = [go.get(a, a) for a in at]
    return at


def _open(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


def rendered(to: int, how: tuple, text: str, first: bool) -> str:
    """What a turn adds to the conversation's text. A turn is closed when the next one opens."""
    _, merged, inserted = how
    if merged:
        return f"\n{text}"
    gap = "" if first else "<|end|>\n"
    for role in inserted:
        gap += f"{_open(role)}<|end|>\n"
    return f"{gap}{_open(to)}{text}"


def tail(state: int) -> str:
    """What closes a conversation that ends in a state, with the empty turns it still needs."""
    return {START: "", ASSISTANT: "<|end|>\n", USER: f"<|end|>\n{_open(ASSISTANT)}<|end|>\n", SYSTEM: f"<|end|>\n{_open(USER)}<|end|>\n{_open(ASSISTANT)}<|end|>\n"}[state]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows that follow one another with equal keys; a run may go over the border of two batches."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and any(row[k] != run[0][k] for k in keys):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def repaired(turns: DataFrame, c: Costs = Costs()) -> DataFrame:
    """conv_id, turn, position, role, new_role, relabelled, merged, inserted (empty turns before and, at the end, after), cost, rendered.

    One row for each turn; the rendered parts of a conversation, joined in order of position, are its repaired text. Turns
    go in order of (turn, role, xxhash64 of the text, text), nulls first, so ties and repeated rows have a place, and rows are
    the same however turns are dealt over partitions. Ranges are found from hashes and not from texts, so no text goes to the
    driver, and equal rows, which may stand for one another, are split as well. A null or unknown role costs a relabelling whatever it becomes, a null text is empty,
    a text may be of any length, and rows whose conv_id is null are one conversation. An empty table gives an empty table;
    other columns are not read.
    """
    df = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("hash", F.xxhash64("text"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("hash")]
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # partitions are ranges of turns, and not whole conversations: a long one goes over many
    df = df.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "spread").sortWithinPartitions(*keys, "text").drop("hash", "spread")
    kind, turn = dict(turns.dtypes)["conv_id"], dict(turns.dtypes)["turn"]
    conv_type, turn_type = (to_arrow_type(turns.schema[k].dataType) for k in ("conv_id", "turn"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, rows, chars, last = TaskContext.get().partitionId(), 0, 0, 0, None
        for batch in batches:
            pieces, places = [], []
            for conv, n in zip(batch.column("conv_id").to_pylist(), batch.column("chars").to_pylist()):
                if rows and (conv != last or rows >= c.stretch or chars + n > c.stretch_chars):
                    piece, rows, chars = piece + 1, 0, 0
                pieces.append(piece)
                places.append(rows)
                rows, chars, last = rows + 1, chars + n, conv
            added = [pa.array([part] * len(pieces), pa.int64()), pa.array(pieces, pa.int64()), pa.array(places, pa.int64())]
            kept = batch.drop_columns(["chars"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *added], names=[*kept.schema.names, "part", "piece", "place"])

    schema = f"conv_id {kind}, turn {turn}, role string, text string, part long, piece long, place long"
    df = durable(df.withColumn("chars", F.length("text")).mapInArrow(cut, schema))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["part", "piece"]):
            r = run[0]
            row = {"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"], "n": len(run), "cost": table([x["role"] for x in run], c).ravel().tolist()}
            yield pa.RecordBatch.from_pylist([row], schema=table_schema)

    table_schema = pa.schema([("conv_id", conv_type), ("part", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("cost", pa.list_(pa.int64()))])
    # stretches follow one another inside each written partition, so this pass moves nothing
    tables = durable(df.select("conv_id", "part", "piece", "role").mapInArrow(sums, f"conv_id {kind}, part long, piece long, n long, cost array<long>"))
    many = tables.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("conv_id").alias("c"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    closing = [ending(x, c) for x in range(4)]

    def rests(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """What is left to pay after each stretch of one conversation, and how many turns stand before it."""
        pdf = pdf.sort_values(["part", "piece"]).reset_index(drop=True)
        rest = [np.array(closing, np.int64)]
        for m in reversed(pdf.cost.tolist()):
            rest.append(np.minimum((np.asarray(m, np.int64).reshape(4, 4) + rest[-1][None]).min(1), FAR))
        before = pdf.n.cumsum() - pdf.n
        return pd.DataFrame({"p": pdf.part, "k": pdf.piece, "rest": [r.tolist() for r in rest[-2::-1]], "before": before, "last": [False] * (len(pdf) - 1) + [True]})

    long = durable(tables.join(many, same, "left_semi").groupBy("conv_id").applyInPandas(rests, "p long, k long, rest array<long>, before long, last boolean"))
    at = (F.col("part") == F.col("p")) & (F.col("piece") == F.col("k"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["part", "piece"]):
            r = run[0]
            row = {"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"], "ends": ends_of([x["role"] for x in run], r["rest"], c)}
            yield pa.RecordBatch.from_pylist([row], schema=ends_schema)

    ends_schema = pa.schema([("conv_id", conv_type), ("part", pa.int64()), ("piece", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def begins(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state before each stretch of one conversation."""
        pdf = pdf.sort_values(["part", "piece"])
        state, out = START, []
        for m in pdf.ends:
            out.append(state)
            state = int(m[state])
        return pd.DataFrame({"p": pdf.part, "k": pdf.piece, "begin": out})

    # most conversations are one stretch; for longer ones only the few numbers of each stretch are brought together
    roles = df.select("conv_id", "role", "part", "piece", "place").join(long.select("p", "k", "rest"), at).drop("p", "k")
    roles = roles.repartition(parts, "part", "piece").sortWithinPartitions("part", "piece", "place")
    states = roles.mapInArrow(ends, f"conv_id {kind}, part long, piece long, ends array<int>").groupBy("conv_id").applyInPandas(begins, "p long, k long, begin int")
    short = tables.join(many, same, "left_anti").select(F.col("part").alias("p"), F.col("piece").alias("k"), F.lit(START).alias("begin"), F.array(*[F.lit(x).cast("long") for x in closing]).alias("rest"), F.lit(0).cast("long").alias("before"), F.lit(True).alias("last"))
    ways = short.unionByName(long.join(states, ["p", "k"]))
    df = df.join(ways, at).drop("p", "k")
    # a stretch stays whole: this is a repartitioning by its key, which is never split
    df = df.repartition(parts, "part", "piece").sortWithinPartitions("part", "piece", "place")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["part", "piece"]):
            begin, rest, before, last = (run[0][k] for k in ("begin", "rest", "before", "last"))
            rows = []
            for i, (x, (to, how)) in enumerate(zip(run, solve([x["role"] for x in run], begin, rest, c))):
                end = last and i == len(run) - 1
                inserted = len(how[2]) + ({USER: 1, SYSTEM: 2}.get(to, 0) if end else 0)
                text = rendered(to, how, x["text"], before + i == 0) + (tail(to) if end else "")
                price = c.relabel * how[0] + c.merge * how[1] + c.insert * inserted
                rows.append({"conv_id": x["conv_id"], "turn": x["turn"], "position": before + i, "role": x["role"], "new_role": ROLES[to - 1], "relabelled": bool(how[0]), "merged": bool(how[1]), "inserted": inserted, "cost": price, "rendered": text})
            yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    out_schema = pa.schema([("conv_id", conv_type), ("turn", turn_type), ("position", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("relabelled", pa.bool_()), ("merged", pa.bool_()), ("inserted", pa.int32()), ("cost", pa.int64()), ("rendered", pa.string())])
    return df.mapInArrow(finish, f"conv_id {kind}, turn {turn}, position long, role string, new_role string, relabelled boolean, merged boolean, inserted int, cost long, rendered string")
