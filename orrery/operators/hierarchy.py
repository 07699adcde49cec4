"""The tree of directories that a map shows, and the map itself: its nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import stable_id
from orrery.lineage import durable

#: Sections that make a branch, levels of the tree, sample files of a node, and the names of what is shown.
LEAST, LEVELS, SHOWN = 2, 6, 5
ROOT_FILES, DIRECT = "Repository root files", " (direct files)"
GROUP, EDGE = "structural-group", "edge"
REGION_TEXT = ("Repository region '", "', containing ", " module(s) across its nested sections. Grouped by real directory containment only -- no architectural category was inferred.")
SECTION_TEXT = ("Repository section '", "', containing ", " module(s). Grouped by real directory containment only -- no architectural category was inferred.")
ROOT_TEXT = " module(s) directly at the repository root (not inside any subdirectory)."
DIRECT_TEXT = (" module(s) directly inside '", "' (not inside any further subdirectory).")


def _prefix(parts: Column, depth: Column) -> Column:
    return F.array_join(F.slice(parts, 1, depth), "/")


def directories(components: DataFrame, levels: int = LEVELS) -> DataFrame:
    """prefix, depth, members (below at any depth), direct, subdirs of every directory over components (path) that a tree may show.

    The tree begins at most `levels` down and has as many levels, so nothing deeper is counted.
    """
    parts = F.split("path", "/")
    df = components.select(parts.alias("p"), F.explode(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(2 * levels)))).alias("depth"))
    child = F.when(F.col("depth") < F.size("p") - 1, F.element_at("p", F.col("depth") + 1))
    by_child = df.groupBy(_prefix(F.col("p"), F.col("depth")).alias("prefix"), "depth", child.alias("child")).agg(F.count(F.lit(1)).alias("n"))
    return by_child.groupBy("prefix", "depth").agg(F.sum("n").alias("members"), F.sum(F.when(F.col("child").isNull(), F.col("n")).otherwise(0)).alias("direct"), F.count("child").alias("subdirs"))


def _samples(components: DataFrame, levels: int, shown: int) -> DataFrame:
    """prefix, bucket, samples: the first paths under each directory, and of those right in it.

    A path that is not among the first right where it lies is among the first of no directory above, so it goes before paths
    are repeated for these. Paths are dealt anew for that, as a task would sort all paths of a large file.
    """
    parts = F.split("path", "/")
    inner = F.least(F.size(parts) - 1, F.lit(2 * levels))
    own = components.select("path", _prefix(parts, inner).alias("own"), (F.size(parts) - 1 == inner).alias("right_in")).repartition("path")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("own", "right_in").orderBy("path"))).filter(F.col("r") <= shown)
    df = own.select("path", parts.alias("p"), F.explode(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(2 * levels)))).alias("depth"))
    both = F.when(F.col("depth") == F.size("p") - 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    df = df.select("path", _prefix(F.col("p"), F.col("depth")).alias("prefix"), F.explode(both).alias("bucket"))
    # ranks are cut in each task before rows move, so the root brings a few rows and not all files
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("prefix", "bucket").orderBy("path"))).filter(F.col("r") <= shown)
    return df.groupBy("prefix", "bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("samples"))


def tree(components: DataFrame, run: str = "run", least: int = LEAST, levels: int = LEVELS, shown: int = SHOWN) -> DataFrame:
    """id, parent, label, level, kind, members, samples, description of the groups of components (path, kind).

    No group at all where a component is no module, or where the root has fewer than `least` sections. A directory that holds
    one directory and no file is folded into that one, up to `levels`; a branch with files of its own gets a bucket for them,
    as the root does. kind is region for what has groups inside, else section, or files for a bucket. Paths are distinct.
    """
    sections = F.col("subdirs") + F.when(F.col("direct") > 0, 1).otherwise(0)
    one = F.lit(1).alias("one")
    dirs = durable(directories(components, levels))
    whole = dirs.filter("depth = 0").select(one, F.col("members").alias("all_"))
    flat = components.agg(F.count_if(~F.coalesce(F.col("kind") == "module", F.lit(False))).alias("others")).select(one, "others")
    dirs = dirs.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")  # one row
    root = dirs.filter(F.col("members") == F.col("all_")).filter(F.col("depth") <= levels).filter((F.col("direct") > 0) | (F.col("subdirs") > 1))
    root = root.withColumn("sections", sections).agg(F.min(F.struct("depth", "prefix", "direct", "sections")).alias("root")).select(one, "root").join(flat, "one")
    root = root.filter((F.col("root.sections") >= least) & (F.col("others") == 0)).select("one", "root")
    at = dirs.join(F.broadcast(root), "one").withColumn("level", F.col("depth") - F.col("root.depth"))
    branch = (sections >= least) & (F.col("level") < levels)
    kept = at.filter(F.col("level").between(1, levels)).filter((F.col("level") == levels) | (F.col("direct") > 0) | (F.col("subdirs") > 1)).withColumn("branch", branch)
    kept = durable(kept)
    group = lambda prefix: stable_id(GROUP, F.lit(run), F.lit("path"), prefix)
    # every kept directory looks up all directories above it, of which the deepest that is kept is its parent
    parts = F.split("prefix", "/")
    above = kept.filter("level > 1").select("prefix", F.explode(F.sequence(F.col("root.depth") + 1, F.col("depth") - 1)).alias("up")).withColumn("above", _prefix(parts, F.col("up")))
    nearest = above.join(kept.select(F.col("prefix").alias("above")), "above").groupBy("prefix").agg(F.max_by("above", "up").alias("above"))
    say = lambda t: F.concat(F.lit(t[0]), F.col("prefix"), F.lit(t[1]), F.col("members"), F.lit(t[2]))
    groups = kept.join(nearest, "prefix", "left").select(
        group(F.col("prefix")).alias("id"), F.when(F.col("above").isNotNull(), group(F.col("above"))).alias("parent"), F.col("prefix").alias("label"), "level",
        F.when(F.col("branch"), "region").otherwise("section").alias("kind"), "members", F.when(F.col("branch"), say(REGION_TEXT)).otherwise(say(SECTION_TEXT)).alias("description"),
        "prefix", F.lit(False).alias("bucket"),
    )
    holders = kept.filter("branch and direct > 0").select("prefix", "level", "direct", F.lit(False).alias("top"))
    holders = holders.unionByName(root.filter("root.direct > 0").select("root.prefix", F.lit(0).alias("level"), "root.direct", F.lit(True).alias("top")))
    n = F.col("direct").cast("string")
    buckets = holders.select(
        stable_id(GROUP, F.lit(run), F.lit("direct-files"), F.col("prefix")).alias("id"), F.when(~F.col("top"), group(F.col("prefix"))).alias("parent"),
        F.when(F.col("prefix") == "", ROOT_FILES).otherwise(F.concat("prefix", F.lit(DIRECT))).alias("label"), (F.col("level") + 1).alias("level"), F.lit("files").alias("kind"), F.col("direct").alias("members"),
        F.when(F.col("prefix") == "", F.concat(n, F.lit(ROOT_TEXT))).otherwise(F.concat(n, F.lit(DIRECT_TEXT[0]), F.col("prefix"), F.lit(DIRECT_TEXT[1]))).alias("description"), "prefix", F.lit(True).alias("bucket"),
    )
    out = groups.unionByName(buckets).join(_samples(components, levels, shown), ["prefix", "bucket"])
    return out.select("id", "parent", "label", "level", "kind", "members", "samples", "description")


def shown_nodes(groups: DataFrame, components: DataFrame, root: str, name: str) -> DataFrame:
    """id, parent, label, level, children: the map's root and its groups, or its components (id, label) where there is no group.

    Which of both it is, the data say, in one plan. children: of the root what stands right under it, of a group its modules.
    """
    any_group = groups.agg(F.count(F.lit(1)).alias("groups")).select(F.lit(1).alias("one"), "groups")
    flat = components.withColumn("one", F.lit(1)).join(F.broadcast(any_group), "one").filter("groups = 0")  # one row
    rows = groups.select("id", "parent", "label", "level", F.col("members").alias("children"))
    rows = rows.unionByName(flat.select("id", F.lit(None).cast("string").alias("parent"), "label", F.lit(1).alias("level"), F.lit(0).cast("long").alias("children")))
    top = rows.agg(F.count_if(F.col("parent").isNull()).alias("children"))
    return rows.unionByName(top.select(F.lit(root).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(name).alias("label"), F.lit(0).alias("level"), "children"))


def shown_edges(nodes: DataFrame, relationships: DataFrame, root: str, run: str = "run") -> DataFrame:
    """id, source, target, kind, label, confidence: relationships (source, target, label, verified) between nodes right under the root.

    Where there is none, the root contains each of these nodes instead. A relation between groups is never made up from those
    of their members.
    """
    top = nodes.filter("level >= 1 and parent is null").select("id")
    a, b = top.select(F.col("id").alias("source")), top.select(F.col("id").alias("target"))
    known = relationships.join(a, "source", "left_semi").join(b, "target", "left_semi")
    words = F.concat_ws("_", F.filter(F.split(F.lower("label"), r"\s+"), lambda w: w != ""))
    known = known.select(
        stable_id(EDGE, F.lit(run), F.col("source"), F.col("target"), F.col("label")).alias("id"), "source", "target",
        F.when(words == "", "dependency").otherwise(words).alias("kind"), "label", F.when(F.col("verified"), 0.8).otherwise(0.45).alias("confidence"),
    )
    any_known = known.agg(F.count(F.lit(1)).alias("known")).select(F.lit(1).alias("one"), "known")
    inside = top.withColumn("one", F.lit(1)).join(F.broadcast(any_known), "one").filter("known = 0")  # one row
    inside = inside.select(stable_id(EDGE, F.lit(run), F.lit(root), F.col("id")).alias("id"), F.lit(root).alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit("contains").alias("label"), F.lit(None).cast("double").alias("confidence"))
    return known.unionByName(inside)
