"""Graph operators over relations (id, source, target, kind, status, line) and symbols (id, module)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.lineage import durable, light
from orrery.operators import spans


def violations(relations: DataFrame) -> DataFrame:
    """Rows that break the contract of relations: none are to be found."""
    s, t, c = F.col("status"), F.col("target"), F.col("confidence")
    bad = ((s == "resolved") & (t.isNull() | c.isNotNull())) | ((s == "unresolved") & (t.isNotNull() | F.col("target_reference").isNull())) | ((s == "partial") & F.col("target_reference").isNull()) | (c < 0) | (c > 1)
    return relations.filter(bad | ~s.isin("resolved", "partial", "unresolved") | ~F.col("kind").isin("contains", "imports", "calls", "inherits"))


def resolved(relations: DataFrame) -> DataFrame:
    return relations.filter((F.col("status") == "resolved") & F.col("target").isNotNull())


def lifted(relations: DataFrame, symbols: DataFrame, modules: DataFrame, group: str) -> DataFrame:
    """relations with source_group and target_group: of the modules that both symbols stand in."""
    side = symbols.join(modules.select("module", F.col(group).alias("g")), "module").select("id", "module", "g")
    a = side.select(F.col("id").alias("source"), F.col("module").alias("source_module"), F.col("g").alias("source_group"))
    b = side.select(F.col("id").alias("target"), F.col("module").alias("target_module"), F.col("g").alias("target_group"))
    return relations.join(a, "source").join(b, "target")


def aggregate_edges(edges: DataFrame, ids: int = 20) -> DataFrame:
    """Edges between groups by kind: relations, distinct symbol pairs, sources and targets, and the first ids.

    Ids are cut after each task's own sort as well, so no task holds all ids of a large edge.
    """
    between = edges.filter("source_group <> target_group")
    keys = ["source_group", "target_group", "kind"]
    counts = between.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("relation_count"),
        F.countDistinct("source", "target").alias("pair_count"),
        F.countDistinct("source").alias("source_count"),
        F.countDistinct("target").alias("target_count"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    first = between.select(*keys, "id").withColumn("r", rank).filter(F.col("r") <= ids).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("first_ids"))
    return counts.join(first, keys)


def internal_counts(edges: DataFrame) -> DataFrame:
    return edges.filter("source_group = target_group").groupBy(F.col("source_group").alias("group_id"), "kind").agg(F.count(F.lit(1)).alias("relation_count"))


def neighbours(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Dependencies and dependents of each of entities (entity); partial relations count."""
    known = relations.filter(F.col("target").isNotNull())
    of = entities.select(F.col("entity").alias("of")).filter("of is not null").distinct()
    out = known.join(of, F.col("source") == F.col("of")).select("of", F.lit("dependency").alias("side"), F.col("target").alias("entity"), "kind", "status")
    into = known.join(of, F.col("target") == F.col("of")).select("of", F.lit("dependent").alias("side"), F.col("source").alias("entity"), "kind", "status")
    return out.unionByName(into).groupBy("of", "side", "entity", "kind", "status").agg(F.count(F.lit(1)).alias("n"))


def hops(edges: DataFrame, start: DataFrame, k: int, directed: bool = False, written: bool = False) -> DataFrame:
    """(node, depth) of what k steps over edges (a, b) reach from start (node); each node at its least depth.

    Few rows of a front go to the edges, which then stay where they are. written: edges are durable already.
    """
    steps = edges if written else durable(edges.select("a", "b").distinct())
    seen = durable(start.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, k + 1):
        near = light(front.select("node"))
        go = lambda x, y: steps.join(near.select(F.col("node").alias(x)), x).select(F.col(y).alias("node"))  # noqa: B023, E731
        step = (go("a", "b") if directed else go("a", "b").unionByName(go("b", "a"))).distinct()
        front = durable(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def verified_paths(paths: DataFrame, relations: DataFrame) -> DataFrame:
    """(path_id, hops, matched, verified): a path holds if each of its hops is a resolved relation of the path's kind."""
    steps = paths.select("path_id", "kind", F.posexplode("nodes").alias("at", "source"))
    steps = steps.withColumn("target", F.lead("source").over(Window.partitionBy("path_id").orderBy("at"))).filter("target is not null")
    known = resolved(relations).select("source", "target", "kind", F.lit(True).alias("hit")).distinct()
    out = steps.join(known, ["source", "target", "kind"], "left").groupBy("path_id").agg(F.count(F.lit(1)).alias("hops"), F.count("hit").alias("matched"))
    return out.withColumn("verified", F.col("hops") == F.col("matched"))


def containment(paths: DataFrame, depth: int = 6) -> DataFrame:
    """(prefix, level, members, direct, children) of every directory above paths (path), down to `depth` levels."""
    parts = F.split("path", "/")
    dirs = paths.select("path", parts.alias("p")).select("path", F.size("p").alias("n"), F.explode(F.sequence(F.lit(0), F.least(F.size("p") - 1, F.lit(depth)))).alias("level"), "p")
    rows = dirs.select(F.when(F.col("level") == 0, F.lit(".")).otherwise(F.array_join(F.slice("p", 1, F.col("level")), "/")).alias("prefix"), "level", (F.col("n") - 1 == F.col("level")).alias("here"), F.when(F.col("n") - 1 > F.col("level"), F.element_at("p", F.col("level") + 1)).alias("child"))
    return rows.groupBy("prefix", "level").agg(F.count(F.lit(1)).alias("members"), F.count_if("here").alias("direct"), F.countDistinct("child").alias("children"))


def branch_points(tree: DataFrame) -> DataFrame:
    """Directories that stay when chains of single children are folded: those with two things or more inside, and the root."""
    return tree.filter((F.col("level") == 0) | (F.when(F.col("direct") > 0, 1).otherwise(0) + F.col("children") >= 2))


def representatives(ancestors: DataFrame, collapsed: DataFrame) -> DataFrame:
    """(node, shown): the nearest collapsed ancestor, the node itself included, else the node. ancestors: (node, ancestor, distance)."""
    hit = ancestors.join(collapsed.select(F.col("node").alias("ancestor")), "ancestor")
    top = hit.groupBy("node").agg(F.min_by("ancestor", "distance").alias("shown"))
    return ancestors.select("node").distinct().join(top, "node", "left").select("node", F.coalesce("shown", "node").alias("shown"))


def affinity(edges: DataFrame) -> DataFrame:
    """(group_id, a, b): distinct undirected module pairs with a resolved relation inside one group."""
    inner = edges.filter("source_group = target_group and source_module <> target_module")
    return inner.select(F.col("source_group").alias("group_id"), F.least("source_module", "target_module").alias("a"), F.greatest("source_module", "target_module").alias("b")).distinct()


def bridges_and_parts(pairs: list[tuple], vertices: list) -> tuple[set, list[set]]:
    """Bridges of an undirected simple graph, and its parts once they are cut. Without recursion, for chains of any length."""
    near: dict = {v: [] for v in vertices}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    order: dict = {}
    low: dict = {}
    bridges: set = set()
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        trail = [(root, None, iter(sorted(near[root])))]
        while trail:
            v, parent, rest = trail[-1]
            for w in rest:
                if w == parent:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    trail.append((w, v, iter(sorted(near[w]))))
                    break
            else:
                trail.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > order[parent]:
                        bridges.add((min(v, parent), max(v, parent)))
    parts, seen = [], set()
    for root in sorted(near):
        if root in seen:
            continue
        part, todo = set(), [root]
        while todo:
            v = todo.pop()
            if v not in part:
                part.add(v)
                todo += [w for w in near[v] if w not in part and (min(v, w), max(v, w)) not in bridges]
        seen |= part
        parts.append(part)
    return bridges, parts


def clusters(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(group_id, a, b, bridge, cluster): every pair, whether it is a bridge, and the cluster of its ends (its smallest member).

    One task takes one group: groups are leaves of the module tree and pairs are distinct, so a group is bounded by its
    modules and not by the relations between them.
    """
    kind = dict(pairs.dtypes)

    def run(key, pdf):
        rows = list(zip(pdf.a, pdf.b))
        cut, parts = bridges_and_parts(rows, sorted({v for r in rows for v in r}))
        of = {v: min(p) for p in parts if len(p) >= least for v in p}
        return pdf.assign(bridge=[r in cut for r in rows], cluster=[of.get(a) if of.get(a) == of.get(b) else None for a, b in rows]).astype({"cluster": "Int64" if "int" in kind["a"] else object})

    return pairs.groupBy("group_id").applyInPandas(run, f"group_id {kind['group_id']}, a {kind['a']}, b {kind['b']}, bridge boolean, cluster {kind['a']}")


def members(pairs_with_clusters: DataFrame) -> DataFrame:
    """(group_id, module, cluster) of the modules that clusters() puts into a cluster."""
    ends = pairs_with_clusters.filter("cluster is not null")
    return ends.select("group_id", F.explode(F.array("a", "b")).alias("module"), "cluster").distinct()


def cluster_table(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(group_id, cluster, display_name, size, internal, boundary) of members() inside, over edges between modules of one group.

    A relation is internal with both ends in the cluster and on its boundary with one; both ends lie in the same group.
    display_name counts clusters in order of group and smallest member.
    """
    df = edges.filter("source_group = target_group and source_module <> target_module").select("id", F.col("source_group").alias("group_id"), "source_module", "target_module")
    side = lambda end: inside.select("group_id", F.col("module").alias(f"{end}_module"), F.col("cluster").alias(f"{end}_cluster"))
    df = df.join(side("source"), ["group_id", "source_module"], "left").join(side("target"), ["group_id", "target_module"], "left")
    ends = F.array_distinct(F.array_compact(F.array("source_cluster", "target_cluster")))
    same = F.col("source_cluster").eqNullSafe(F.col("target_cluster"))
    counts = df.select("group_id", F.explode(ends).alias("cluster"), same.alias("same")).groupBy("group_id", "cluster").agg(F.count_if("same").alias("internal"), F.count_if(~F.col("same")).alias("boundary"))
    sizes = inside.groupBy("group_id", "cluster").agg(F.count(F.lit(1)).alias("size"))
    # one row for each cluster, so numbering them in one task is small next to the modules
    number = F.row_number().over(Window.orderBy("group_id", "cluster"))
    out = sizes.join(counts, ["group_id", "cluster"], "left").withColumn("display_name", F.concat(F.lit("Structural cluster "), number))
    return out.select("group_id", "cluster", "display_name", "size", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("boundary", F.lit(0)).alias("boundary"))


def cluster_edges(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(source_cluster, target_cluster, kind, relation_count, pair_count) between clusters of any groups; a cluster is (group, smallest member)."""
    name = F.concat_ws(":", "group_id", "cluster")
    side = lambda end: inside.select(F.col("module").alias(f"{end}_module"), name.alias(f"{end}_cluster"))
    df = edges.join(side("source"), "source_module").join(side("target"), "target_module").filter("source_cluster <> target_cluster")
    pairs = df.groupBy("source_cluster", "target_cluster", "kind", "source_module", "target_module").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("source_cluster", "target_cluster", "kind").agg(F.sum("n").alias("relation_count"), F.count(F.lit(1)).alias("pair_count"))


def residuals(modules: DataFrame, pairs: DataFrame, inside: DataFrame, least: int = 3) -> DataFrame:
    """(group_id, module, reason, region_reason) of modules (group_id, module) in no cluster."""
    size = modules.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    paired = pairs.select("group_id").distinct().withColumn("paired", F.lit(True))
    cored = inside.select("group_id").distinct().withColumn("cored", F.lit(True))
    touched = pairs.select("group_id", F.explode(F.array("a", "b")).alias("module")).distinct().withColumn("touched", F.lit(True))
    df = modules.join(inside.select("group_id", "module"), ["group_id", "module"], "left_anti").join(touched, ["group_id", "module"], "left")
    df = df.join(size, "group_id").join(paired, "group_id", "left").join(cored, "group_id", "left")
    reason = (
        F.when(F.col("size") < least, "region_too_small")
        .when(F.col("paired").isNull(), "no_internal_resolved_relation")
        .when(F.col("cored").isNull(), "no_useful_non_bridge_relation_core")
        .when(F.col("touched").isNull(), "no_internal_resolved_relation")
        .otherwise("only_bridge_connected_or_below_minimum_core")
    )
    region = F.when(F.col("size") < least, "region_too_small").when(F.col("paired").isNull(), "no_internal_resolved_relations").otherwise("insufficient_relation_core")
    return df.select("group_id", "module", reason.alias("reason"), region.alias("region_reason"))


def region_reasons(residual: DataFrame) -> DataFrame:
    """(group_id, reason, members): why modules of a group are left over, and how many, by residuals()."""
    return residual.groupBy("group_id", F.col("region_reason").alias("reason")).agg(F.count(F.lit(1)).alias("members"))


def group_rows(modules: DataFrame, inside: DataFrame, residual: DataFrame) -> DataFrame:
    """(id, parent, kind, members) of the whole group tree: containers, leaves, clusters, what is left over, and modules.

    modules: (module, leaf, container). What is left over is wrapped only beside clusters or where a leaf is too small to
    have any; else its modules stand in the leaf itself.
    """
    count = F.count(F.lit(1)).alias("members")
    containers = modules.groupBy(F.col("container").alias("id")).agg(count).select("id", F.lit(None).cast("string").alias("parent"), F.lit("structural_container").alias("kind"), "members")
    leaves = modules.groupBy(F.col("leaf").alias("id"), F.col("container").alias("parent")).agg(count).select("id", "parent", F.lit("structural_leaf").alias("kind"), "members")
    cluster = F.concat_ws(":", "group_id", "cluster")
    clusters_ = inside.groupBy(cluster.alias("id"), F.col("group_id").alias("parent")).agg(count).select("id", "parent", F.lit("relation_cluster").alias("kind"), "members")
    wrapped = inside.select("group_id").union(residual.filter("reason = 'region_too_small'").select("group_id")).distinct().withColumn("wrapped", F.lit(True))
    rest = residual.join(wrapped, "group_id", "left")
    over = F.concat_ws(":", "group_id", F.lit("residual"))
    left_over = rest.filter("wrapped").groupBy(over.alias("id"), F.col("group_id").alias("parent")).agg(count).select("id", "parent", F.lit("relation_residual").alias("kind"), "members")
    one = F.lit(1).cast("long").alias("members")
    of_cluster = inside.select(F.col("module").cast("string").alias("id"), cluster.alias("parent"), F.lit("module").alias("kind"), one)
    of_rest = rest.select(F.col("module").cast("string").alias("id"), F.when(F.col("wrapped"), over).otherwise(F.col("group_id")).alias("parent"), F.lit("module").alias("kind"), one)
    out = containers
    for part in (leaves, clusters_, left_over, of_cluster, of_rest):
        out = out.unionByName(part)
    return out


def cluster_evidence(edges: DataFrame, inside: DataFrame, modules: DataFrame, most: int = 100) -> DataFrame:
    """(cluster_id, source, target, kind): the first `most` directed pairs of member paths in each cluster, which a reader is shown."""
    side = lambda end: inside.join(modules.select("module", "path"), "module").select(F.col("module").alias(f"{end}_module"), F.concat_ws(":", "group_id", "cluster").alias(f"{end}_id"), F.col("path").alias(end))
    df = edges.select("source_module", "target_module", "kind").distinct().join(side("source"), "source_module").join(side("target"), "target_module").filter("source_id = target_id")
    df = df.select(F.col("source_id").alias("cluster_id"), "source", "target", "kind").distinct()
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("source", "target", "kind"))
    return df.withColumn("r", rank).filter(F.col("r") <= most).drop("r")


def subtree(tree: DataFrame, root: str) -> DataFrame:
    """Rows of tree (path, ...) strictly below root, by their paths."""
    return tree.filter(F.col("path").startswith(f"{root}/"))


def scope_edges(edges: DataFrame, root: str) -> DataFrame:
    """Edges (source_path, target_path, ...) that lie inside a subtree with both ends."""
    return edges.filter(F.col("source_path").startswith(f"{root}/") & F.col("target_path").startswith(f"{root}/"))


def visible(ancestors: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nodes of which every proper ancestor (node, ancestor, distance > 0) is expanded (node)."""
    above = ancestors.filter("distance > 0")
    shut = above.join(expanded.select(F.col("node").alias("ancestor")), "ancestor", "left_anti").select("node").distinct()
    return ancestors.select("node").distinct().join(shut, "node", "left_anti")


def children(tree: DataFrame, parent: str | None) -> DataFrame:
    """Rows of tree (id, parent, ...) whose parent is the given one; none for the roots."""
    return tree.filter(F.col("parent").isNull() if parent is None else F.col("parent") == parent)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over edges (a, b), both ends counted."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) by smallest label: each node points to its smallest neighbour, pointers are followed to their ends, and edges shrink to these.

    A round at least halves the nodes that have edges left, and following doubles its reach each time, so rounds grow with the
    logarithm of a chain, and each is smaller than the last.
    """
    known = edges.select("a", "b").filter("a is not null and b is not null")
    left = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    levels = []
    while True:
        state = durable(left.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
        if levels and not state.take(1):
            break
        while True:
            up = state.select(F.col("node").alias("component"), F.col("component").alias("up"))
            far = durable(state.join(up, "component").select("node", F.col("component").alias("old"), F.col("up").alias("component")))
            state = far.select("node", "component")
            if not far.filter("component < old").take(1):
                break
        levels.append(state)
        a, b = (state.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
        left = left.join(a, "a").join(b, "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        left = durable(left)
    out = levels.pop()
    while levels:
        ends = out.select(F.col("node").alias("component"), F.col("component").alias("end"))
        out = levels.pop().join(ends, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
    return out


def parts_within(edges: DataFrame) -> DataFrame:
    """(parts) of each task: how many connected parts the edges (part, a, b) make where none leaves its part; a loop makes none.

    Nothing is written, and edges are moved once, by part. A task holds the nodes of one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        n = 0

        def end(x):
            if x not in up:
                up[x] = x
                return x, 1
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x, 0

        for batch in batches:
            for first, a, b in zip(*(batch.column(c).to_pylist() for c in ("first", "a", "b"))):
                if first:
                    up.clear()
                if a is None or b is None or a == b:
                    continue
                (a, new), (b, other) = end(a), end(b)
                n += new + other
                if a != b:
                    up[a] = b
                    n -= 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["parts"])

    # the window brings a part's edges together, and its mark tells where one begins
    first = F.row_number().over(Window.partitionBy("part").orderBy("a", "b")) == 1
    return edges.select(first.alias("first"), "a", "b").mapInArrow(run, "parts long")


def overlapping(anchors: DataFrame, symbols: DataFrame, most: int = 8) -> DataFrame:
    """(anchor, symbol): symbols of the same path whose lines overlap an anchor's, at most `most` in their own order."""
    a = anchors.select("path", F.col("id").alias("anchor"), F.col("start_line").alias("a1"), F.col("end_line").alias("a2"))
    s = symbols.select("path", F.col("id").alias("symbol"), F.col("start_line").alias("b1"), F.col("end_line").alias("b2"))
    hit = spans.overlaps(a, s, ["path"]).select("anchor", "symbol")
    return hit.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy("symbol"))).filter(F.col("r") <= most).select("anchor", "symbol", F.col("r").alias("rank"))


def innermost(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """(point, span): the shortest of symbols (path, id, start_line, end_line) around a line of points (path, point, line); ties to the smaller id."""
    s = symbols.select("path", "id", F.col("start_line").alias("b1"), F.col("end_line").alias("b2"))
    hit = spans.overlaps(points.select("path", "point", F.col("line").alias("a1"), F.col("line").alias("a2")), s, ["path"])
    return hit.groupBy("point").agg(F.min_by("id", F.struct(F.col("b2") - F.col("b1"), F.col("id"))).alias("span"))
