"""Views of a directed graph: what can be reached, cycles, layers, trees of calls, and its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.lineage import LIGHT, durable, light
from orrery.operators import graph

#: Rounds after which what was found so far is written down, as a long walk would make the plan long.
CUT = 16


def _steps(edges: DataFrame, front: DataFrame, direction: str) -> DataFrame:
    """(start, node): where edges (a, b) lead from a front (start, node), taken in the sense of a walk: out, in or both.

    Few rows of a front go to the edges, which then stay where they are.
    """
    near = light(front.select("start", "node"))
    go = lambda x, y: edges.join(near.select("start", F.col("node").alias(x)), x).select("start", F.col(y).alias("node"))
    return {"out": lambda: go("a", "b"), "in": lambda: go("b", "a"), "both": lambda: go("a", "b").unionByName(go("b", "a"))}[direction]().distinct()


def traverse(edges: DataFrame, start: DataFrame, direction: str = "out", depth: int = 3, written: bool = False) -> DataFrame:
    """(start, node, depth): what each start (node) reaches over edges (a, b), at its least depth; a negative depth has no limit.

    Each round joins only what was new in the round before; a walk ends where a round finds nothing. written: edges are durable
    already, each pair once.
    """
    steps = edges if written else durable(edges.select("a", "b").distinct())
    front = durable(start.select(F.col("node").alias("start"), "node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))
    rounds, seen = [front], front.select("start", "node")
    d = 0
    while d != depth:
        d += 1
        front = durable(_steps(steps, front, direction).join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if not front.take(1):
            break
        rounds.append(front)
        seen = seen.unionByName(front.select("start", "node"))
        if d % CUT == 0:
            seen, rounds = durable(seen), [durable(_union(rounds))]
    return _union(rounds)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends have both a way in and a way out, again and again: no other edge is part of a cycle."""
    n = edges.count()
    while n:
        # an edge goes on where one leads to its beginning and one leads on from its end
        into, out = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        left = durable(edges.join(into, "a", "left_semi").join(out, "b", "left_semi").select("a", "b"))
        before, n = n, left.count()
        edges = left
        if n == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches it."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    state = durable(nodes.withColumn("colour", F.col("node")))
    while True:
        into = edges.join(state.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("c"))
        new = state.join(into, "node", "left").select("node", F.col("colour").alias("old"), F.least("colour", "c").alias("colour"))
        # the colour of a colour reaches the node as well
        far = state.select(F.col("node").alias("colour"), F.col("colour").alias("far"))
        new = durable(new.join(far, "colour", "left").select("node", "old", F.least("colour", "far").alias("colour")))
        state = new.select("node", "colour")
        if not new.filter("colour < old").take(1):
            return state


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of edges (a, b): the smallest node of those that reach it and are reached by it.

    Rounds of colours forward and reach backward: whoever leads a colour back to the node that gave it is in one component with
    it. Every round ends at least one component of each colour, and ends of no cycle go first, all at once.
    """
    all_nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    left = _trimmed(durable(edges.select("a", "b").filter("a <> b").distinct()))
    found = []
    while left.take(1):
        colour = _coloured(left)
        a, b = (colour.select(F.col("node").alias(x), F.col("colour").alias(f"c{x}")) for x in ("a", "b"))
        inside = durable(left.join(a, "a").join(b, "b").filter("ca = cb").select("a", "b", F.col("ca").alias("c")))
        mine = durable(colour.filter("node = colour").select("node", F.col("colour").alias("component")))
        front = mine
        while True:  # backward from what gave the colour, within the colour
            back = inside.join(front.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component").distinct()
            front = durable(back.join(mine.select("node"), "node", "left_anti"))
            if not front.take(1):
                break
            mine = durable(mine.unionByName(front))
        found.append(mine)
        gone = mine.select("node")
        left = _trimmed(durable(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")))
    if not found:
        return all_nodes.withColumn("component", F.col("node"))
    return all_nodes.join(_union(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _peeled(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, layer) of the ends of edges (a, b), and the edges of cycles and of all that they lead to, or None.

    Each round leaves edges whose beginning something left leads to. What an edge of round r leads to stands below layer r, so
    a node's layer is that of the last round in which an edge leads to it, plus one. Layers of ends of the edges given back
    are not final.
    """
    left, n, r = edges, -1, 0
    seen = [edges.select(F.col("a").alias("node"), F.lit(0).alias("layer"))]
    while True:
        seen.append(left.select(F.col("b").alias("node"), F.lit(r + 1).alias("layer")))
        r += 1
        to = left.select(F.col("b").alias("a")).distinct()
        left = durable(left.join(F.broadcast(to) if 0 <= n <= LIGHT else to, "a", "left_semi").select("a", "b"))
        before, n = n, left.count()
        if n == 0 or n == before:
            break
        if r % CUT == 0:
            seen = [durable(_union(seen).groupBy("node").agg(F.max("layer").alias("layer")))]
    return _union(seen).groupBy("node").agg(F.max("layer").alias("layer")), left if n else None


def layers(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, component, layer): edges (a, b) lead down; a component's layer is the longest way to it from the top.

    Nodes of one cycle stand in one layer. What no cycle leads to has its layer by _peeled(), so strong components, and rounds
    that take what nothing left leads to, are only of the rest. of: strong_components(), where known. Edges are read again
    in every part, so they should be durable.
    """
    own = edges.select("a", "b").filter("a <> b")
    placed, rest = _peeled(own)
    alone = edges.filter("not coalesce(a <> b, false)").select(F.explode(F.array("a", "b")).alias("node"), F.lit(0).alias("layer")).filter("node is not null")
    placed = placed.unionByName(alone).groupBy("node").agg(F.max("layer").alias("layer"))
    if rest is None:
        return placed.select("node", F.col("node").alias("component"), "layer")
    placed = durable(placed)
    # every end of what is left is one that an edge of it leads to
    nodes = durable(rest.select(F.col("b").alias("node")).distinct())
    of = durable(strong_components(rest) if of is None else of.join(nodes, "node", "left_semi"))
    a, b = (of.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
    left = durable(rest.join(a, "a").join(b, "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    above = own.join(b, "b").join(nodes.select(F.col("node").alias("a")), "a", "left_anti").join(placed.select(F.col("node").alias("a"), "layer"), "a")
    above = above.groupBy(F.col("cb").alias("component")).agg((F.max("layer") + 1).alias("layer"))
    todo = durable(of.select("component").distinct().join(above, "component", "left").na.fill(0, ["layer"]))
    done, r = [], 0
    while todo.take(1):
        under = left.select(F.col("b").alias("component")).distinct()
        top = durable(todo.join(under, "component", "left_anti"))
        done.append(top)
        pushed = left.join(top.select(F.col("component").alias("a"), "layer"), "a").groupBy(F.col("b").alias("component")).agg((F.max("layer") + 1).alias("pushed"))
        todo = durable(todo.join(top, "component", "left_anti").join(pushed, "component", "left").select("component", F.greatest("layer", "pushed").alias("layer")))
        left = durable(left.join(top.select(F.col("component").alias("a")), "a", "left_anti").select("a", "b"))
        r += 1
        if r % CUT == 0:
            done = [durable(_union(done))]
    below = of.join(_union(done), "component").select("node", "component", F.col("layer").alias("below"))
    return placed.join(below, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("below", "layer").alias("layer"))


def layer_edges(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(source_layer, target_layer, way, edges): edges (a, b) between layers (node, layer): down, over (more than one down), up, or level."""
    a, b = (placed.select(F.col("node").alias(x), F.col("layer").alias(f"{y}_layer")) for x, y in (("a", "source"), ("b", "target")))
    by = F.col("target_layer") - F.col("source_layer")
    way = F.when(by == 1, "down").when(by > 1, "over").when(by == 0, "level").otherwise("up")
    return edges.join(a, "a").join(b, "b").groupBy("source_layer", "target_layer", way.alias("way")).agg(F.count(F.lit(1)).alias("edges"))


def call_flow(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(start, node, depth, path, closes): every way of calls (a, b) from each start (node), down to `depth` calls.

    A way that comes back to a node of its own is shown once more, closed, and goes no further; a negative depth ends there alone.
    """
    steps = durable(edges.select("a", "b").distinct())
    front = durable(start.filter("node is not null").select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("closes")).distinct())
    rounds, d = [front], 0
    while d != depth:
        d += 1
        step = front.filter("not closes").join(steps, F.col("node") == F.col("a"))
        front = durable(step.select("start", F.col("b").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("b")).alias("path"), F.array_contains("path", F.col("b")).alias("closes")))
        if not front.take(1):
            break
        rounds.append(front)
        if d % CUT == 0:
            rounds = [durable(_union(rounds))]
    return _union(rounds)


def dependency_view(edges: DataFrame, scope: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth, in_scope) within `depth` steps of a scope (node), in either direction, and edges (a, b, n) between them."""
    both = edges.select("a", "b").filter("a <> b")
    near = graph.hops(both, scope, depth)
    a, b = (near.select(F.col("node").alias(x)) for x in ("a", "b"))
    inside = both.join(a, "a", "left_semi").join(b, "b", "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return near.select("node", "depth", (F.col("depth") == 0).alias("in_scope")), inside


def statistics(nodes: DataFrame, edges: DataFrame, most: int = 10, name: Column | None = None) -> DataFrame:
    """(figure, key, value) of nodes (id, type, language, parsed) and edges (a, b, kind).

    Numbers of nodes and edges, by type, language and kind, the mean degree in and out over all nodes, the parts that hang
    together, and the `most` nodes with most edges, ties to the smaller id. name: what a node is called, if not its id.
    All sums come from one job, whose steps read the same columns and so share what they shuffle; only sums are written. With a
    column part in both, by which ids are told apart as well and which no edge leaves, edges move once for their parts.
    """
    row = lambda figure, key, value: (F.lit(figure).alias("figure"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    n, none = F.count(F.lit(1)), F.lit(None)
    within = ["part"] if "part" in edges.columns else []
    ends = edges.select(*within, F.explode(F.array("a", "b")).alias("id"), (F.col("a") != F.col("b")).alias("linked"))
    degree = ends.groupBy(*within, "id").agg(n.alias("n"), F.bool_or("linked").alias("linked"))
    known = nodes.join(degree, [*within, "id"], "left")
    called = F.col("id") if name is None else name
    parts = graph.parts_within(edges) if within else graph.connected(edges.filter("a <> b")).agg(F.countDistinct("component").alias("parts"))
    number = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    known = known.select(called.cast("string").alias("key"), "type", "language", "n", number("parsed").alias("parsed"), (1 - number("linked")).alias("parts"))
    top = known.orderBy(F.desc("n"), "key").limit(most).drop("type")
    groups = known.groupBy(F.col("type").alias("key"), "language").agg(n.alias("n"), F.sum("parsed").alias("parsed"), F.sum("parts").alias("parts"))
    sums = None
    for what, df in (("node", groups), ("edge", edges.groupBy(F.col("kind").alias("key")).agg(n.alias("n"))), ("parts", parts), ("top", top)):
        df = df.withColumn("what", F.lit(what))
        sums = df if sums is None else sums.unionByName(df, allowMissingColumns=True)
    sums = durable(sums)
    of = lambda what, c: F.coalesce(F.sum(F.when(F.col("what") == what, F.col(c))), F.lit(0))
    sizes = sums.agg(of("node", "n").alias("nodes"), of("edge", "n").alias("edges"), of("node", "parsed").alias("parsed"), (of("node", "parts") + of("parts", "parts")).alias("parts"))
    mean = F.when(F.col("nodes") > 0, F.col("edges") / F.col("nodes")).otherwise(0.0)
    whole = F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), v.cast("double").alias("value")) for k, v in (
        ("total_nodes", F.col("nodes")), ("total_edges", F.col("edges")), ("parsed_count", F.col("parsed")), ("inferred_count", F.col("nodes") - F.col("parsed")), ("avg_in_degree", mean), ("avg_out_degree", mean),
        ("connected_component_count", F.col("parts")),
    )]))
    out = sizes.select(whole.alias("w")).select("w.figure", none.cast("string").alias("key"), "w.value")
    for figure, what, key in (("nodes_by_type", "node", "key"), ("nodes_by_language", "node", "language"), ("edges_by_type", "edge", "key")):
        out = out.unionByName(sums.filter((F.col("what") == what) & F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n")).select(*row(figure, F.col(key), F.col("n"))))
    return out.unionByName(sums.filter("what = 'top' and n is not null").select(*row("most_connected", F.col("key"), F.col("n"))))
