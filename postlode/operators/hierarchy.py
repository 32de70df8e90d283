"""Parent-child rows as full hierarchies: path, depth, root and descendants of every node, with cycles told apart.

Paths grow level by level from the roots: the frontier, that is the nodes found last, is joined with the rows below it. A join
for each single level would cost one pass over the rows per level, so the rows below are first composed to segments of 1 to
``stride`` levels (each node has at most one ancestor at each distance, so there are at most stride segments to a node); one
round then adds ``stride`` levels. Rounds end when the frontier is empty. What no round reaches hangs on a cycle. Those nodes
are followed by pointer doubling: after n rounds each knows its ancestor 2^n steps up and the least id on the way; the nodes
that are still ancestors of something once their number no longer falls are the members of cycles.

Segments are shuffled once, by their top, and kept; a round shuffles only its frontier to them, so over all rounds each node moves
about once. Below a top with more than HOT rows they are salted and the frontier's row for that top is repeated. Each round is cut
off by a checkpoint in the shared folder, so losing an executor costs at most one round and the lost part of the segments.

Defined results for odd input
-----------------------------
* Rows are (tree, node) records; of several rows with one key the one with the largest order value speaks, and repeated rows
  change nothing. A removed record is not there: its children become roots.
* A null parent or one that is not there makes a root. A node that is its own parent is a cycle of one.
* Nodes that reach no root still have descendants (unreached_pairs, unreached_counts). The members of a cycle are all below one
  another: a member's descendants are the other members and all that hangs below any of them, each once and never itself, at the
  least number of steps. A node below a cycle has the subtree below it, and the whole cycle above it. Their depth is null.
* Null keys are no records and give no rows. Empty tables give an empty result. Null and blank names are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlode.session import checkpointed

#: Most segments below one top that stay together; the rows of more are spread by a salt.
HOT = 200_000


def current_nodes(rows: DataFrame, tree: str, node: str, parent: str, order: str, removed: str, name: str | None = None) -> DataFrame:
    """The present records as (tree, node, parent[, name]), of each record the row with the largest order value."""
    value = F.struct(F.col(order), F.coalesce(F.col(removed), F.lit(False)).alias("gone"), F.col(parent).alias("parent"), *([F.col(name).alias("name")] if name else []))
    return (
        rows.where(F.col(tree).isNotNull() & F.col(node).isNotNull())
        .groupBy(F.col(tree).alias("tree"), F.col(node).alias("node"))
        .agg(F.max(value).alias("v"))
        .where("not v.gone")
        .select("tree", "node", "v.parent", *(["v.name"] if name else []))
    )


def _segments(edges: DataFrame, stride: int, carried: list[str]) -> DataFrame:
    """Rows (tree, top, node, steps, carried...): node lies steps (1 to stride) below top; carried arrays hold the way from below top to node."""
    known, longest = edges.select("tree", F.col("parent").alias("top"), "node", F.lit(1).alias("steps"), *(F.array(c).alias(f"way_{c}") for c in carried)), 1
    while longest < stride:
        upper = known.where(F.col("steps") == longest).select("tree", "top", F.col("node").alias("mid"), *(F.col(f"way_{c}").alias(f"up_{c}") for c in carried))
        lower = known.where(F.col("steps") <= stride - longest).withColumnRenamed("top", "mid")
        joined = lower.join(upper, ["tree", "mid"]).select("tree", "top", "node", (F.col("steps") + longest).alias("steps"), *(F.concat(f"up_{c}", f"way_{c}").alias(f"way_{c}") for c in carried))
        known, longest = checkpointed(known.unionByName(joined)), min(stride, 2 * longest)
    return known


def _placed(segments: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The segments in place for all rounds, partitioned and sorted by (tree, top, salt), and the tops that are salted: (tree, top, salts),
    None without any."""
    hot = segments.groupBy("tree", "top").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("tree", "top", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    hot = checkpointed(hot)
    n = hot.count()
    parts = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    keys = ["tree", "top"]
    if n:
        # one row for HOT rows of the input at least; broadcast while that is a small table
        marked = segments.join(F.broadcast(hot) if n <= 100_000 else hot, keys, "left")
        segments = marked.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
        keys = [*keys, "salt"]  # without hot tops there is no salt: a constant among the keys would have the rows shuffled again
    return segments.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY), hot if n else None


def hierarchy(nodes: DataFrame, stride: int = 8) -> tuple[DataFrame, DataFrame]:
    """From (tree, node, parent[, name]) the pair (reached, unreached).

    reached: tree, node, root, depth (1 for a root), id_path[, name_path] as arrays from the root down. unreached: tree, node,
    cycle_min (the least node on the cycle it ends in) and on_cycle.
    """
    carried = ["node"] + (["name"] if "name" in nodes.columns else [])
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("has_parent"))
    nodes = checkpointed(nodes.join(there, ["tree", "parent"], "left"))
    edges, roots = nodes.where("has_parent"), nodes.where("has_parent is null")
    segments, hot = _placed(_segments(edges, stride, carried))
    paths = [F.array(c).alias(f"way_{c}") for c in carried]
    frontier = roots.select("tree", "node", F.col("node").alias("root"), *paths)
    levels = [frontier.withColumn("depth", F.lit(1))]
    depth = 1
    while True:
        tops = frontier.withColumnRenamed("node", "top").withColumnsRenamed({f"way_{c}": f"up_{c}" for c in carried})
        if hot is not None:
            tops = tops.join(hot, ["tree", "top"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        grown = checkpointed(
            tops.join(segments, ["tree", "top"] if hot is None else ["tree", "top", "salt"])
            .select("tree", "node", "root", *(F.concat(f"up_{c}", f"way_{c}").alias(f"way_{c}") for c in carried), (F.col("steps") + depth).alias("depth"))
        )
        levels.append(grown)
        depth += stride
        frontier = grown.where(F.col("depth") == depth).drop("depth")
        if frontier.isEmpty():
            break
    segments.unpersist()
    reached = reduce(DataFrame.unionByName, levels).select("tree", "node", "root", "depth", *(F.col(f"way_{c}").alias(f"{'id' if c == 'node' else c}_path") for c in carried))
    return reached, _cycles(edges, reached)


def _cycles(edges: DataFrame, reached: DataFrame) -> DataFrame:
    left = edges.select("tree", "node", "parent").join(reached.select("tree", "node"), ["tree", "node"], "left_anti")
    # far: the ancestor so many steps up; least: the least id of the nodes from node on, node included, far excluded
    hops = checkpointed(left.select("tree", "node", F.col("parent").alias("far"), F.col("node").alias("least")))
    before = None
    while True:
        # ends: the nodes that are an ancestor of something so many steps up. They only get fewer; once their number and the sum of the
        # least ids they know stay, they are the members of cycles, and each knows the least id of its cycle
        ends = hops.select("tree", F.col("far").alias("node")).distinct()
        now = hops.join(ends, ["tree", "node"], "left_semi").agg(F.count("*").alias("n"), F.sum(F.col("least").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            break
        before = now
        up = hops.select("tree", F.col("node").alias("far"), F.col("far").alias("farther"), F.col("least").alias("beyond"))
        hops = checkpointed(hops.join(up, ["tree", "far"]).select("tree", "node", F.col("farther").alias("far"), F.least("least", "beyond").alias("least")))
    members = hops.select("tree", F.col("far").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    least = hops.join(members, ["tree", "node"], "left_semi").select("tree", F.col("node").alias("far"), F.col("least").alias("cycle_min"))
    return hops.join(least, ["tree", "far"]).join(members, ["tree", "node"], "left").select("tree", "node", "cycle_min", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def ancestor_pairs(reached: DataFrame) -> DataFrame:
    """(tree, ancestor, node, distance) for each node and each node above it on its path."""
    up = F.expr("slice(id_path, 1, size(id_path) - 1)")
    return reached.where("depth > 1").select("tree", "node", "depth", F.posexplode(up).alias("at", "ancestor")).select("tree", "ancestor", "node", (F.col("depth") - 1 - F.col("at")).alias("distance"))


def descendant_counts(reached: DataFrame) -> DataFrame:
    """For every reached node the number of nodes below it, of its direct children, and how deep the tree below it goes."""
    below = ancestor_pairs(reached).groupBy("tree", F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"), F.sum(F.when(F.col("distance") == 1, 1).otherwise(0)).alias("children"), F.max("distance").alias("height"))
    zero = F.lit(0).cast("bigint")
    return reached.select("tree", "node", "depth").join(below, ["tree", "node"], "left").select("tree", "node", "depth", F.coalesce("descendants", zero).alias("descendants"), F.coalesce("children", zero).alias("children"), F.coalesce("height", F.lit(0)).alias("height"))


def opened_cycles(nodes: DataFrame, unreached: DataFrame, stride: int = 8) -> DataFrame:
    """The unreached nodes as trees, each cycle cut open above its least node: tree, node, cycle_min, on_cycle, depth and id_path from
    the least node down, size (members of the cycle) and place (members on the path, less one: the place of the last one on it)."""
    unreached = checkpointed(unreached)
    cut = nodes.select("tree", "node", "parent").join(unreached, ["tree", "node"]).select("tree", "node", F.when(F.col("node") != F.col("cycle_min"), F.col("parent")).alias("parent"), F.col("on_cycle").alias("name"))
    paths, _ = hierarchy(cut, stride)
    sizes = unreached.where("on_cycle").groupBy("tree", "cycle_min").agg(F.count("*").alias("size"))
    marked = paths.select("tree", "node", F.col("root").alias("cycle_min"), F.element_at("name_path", -1).alias("on_cycle"), "depth", "id_path", (F.size(F.filter("name_path", lambda x: x)) - 1).alias("place"))
    return checkpointed(marked.join(sizes, ["tree", "cycle_min"]))


def unreached_pairs(opened: DataFrame) -> DataFrame:
    """ancestor_pairs() of opened_cycles(): those on the path, and the members past the place where it leaves the cycle, which are
    above by way of the least node's parent."""
    members = opened.where("on_cycle").select("tree", "cycle_min", F.col("node").alias("ancestor"), F.col("place").alias("at"))
    around = opened.join(members, ["tree", "cycle_min"]).where("at > place").select("tree", "ancestor", "node", (F.col("depth") - 1 + F.col("size") - F.col("at")).cast("int").alias("distance"))
    return ancestor_pairs(opened).unionByName(around)


def unreached_counts(opened: DataFrame) -> DataFrame:
    """descendant_counts() of opened_cycles(), with a null depth. Members are counted by cycle, not by pairs."""
    # pairs of two members are not needed, and none of a member with a node below: these are all nodes of the cycle
    inner = opened.where("not on_cycle").withColumn("id_path", F.expr("slice(id_path, place + 2, size(id_path))")).withColumn("depth", F.size("id_path"))
    below = descendant_counts(inner).drop("depth")
    cycle = ["tree", "cycle_min"]
    all_below = opened.groupBy(*cycle).agg((F.count("*") - 1).alias("descendants"))
    deepest = opened.groupBy(*cycle, "place").agg((F.max("depth") - 1).alias("reach"))
    # children of a member: those below the cycle that leave it there, one step down, and the next member unless that is itself
    hanging = opened.where("not on_cycle and depth = place + 2").groupBy(*cycle, "place").agg(F.count("*").alias("hanging"))
    order = Window.partitionBy(*cycle).orderBy("place")
    from_here = F.max("reach").over(order.rowsBetween(0, Window.unboundedFollowing)) - F.col("place")
    around = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1)) + F.col("size") - F.col("place")
    members = (
        opened.where("on_cycle").select("tree", "node", "cycle_min", "place", "size")
        .join(deepest, [*cycle, "place"]).join(hanging, [*cycle, "place"], "left").join(all_below, cycle)
        .select("tree", "node", "descendants", (F.coalesce("hanging", F.lit(0)) + (F.col("size") > 1).cast("bigint")).alias("children"), F.greatest(from_here, around).cast("int").alias("height"))
    )
    return below.unionByName(members).select("tree", "node", F.lit(None).cast("int").alias("depth"), "descendants", "children", "height")


def joined_path(path: str, ids: str, missing: str = "Recovered Folder ") -> Column:
    """A path of names as text, parts joined by /. A / or \\ in a name gets a \\ before it; a null or empty name is missing + its id."""
    part = F.zip_with(path, ids, lambda n, i: F.coalesce(F.nullif(F.regexp_replace(n, r"([/\\])", r"\\$1"), F.lit("")), F.concat(F.lit(missing), i.cast("string"))))
    return F.array_join(part, "/")
