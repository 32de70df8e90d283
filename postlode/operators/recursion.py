"""Recursive queries as frontier loops: descendants of seeds over child-to-parent rows.

Spark's recursive CTE has a row limit and no distinct union; here each step joins only the frontier with the edges, which are shuffled
once and kept, and is cut off by a checkpoint. Steps are as many as the deepest chain below a seed.

As each node has one parent, a walk down from a seed meets a node again only if it comes back to the seed itself; so that is all that is
looked for, and what was found before is never joined again.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from postlode.session import checkpointed


def descend(seeds: DataFrame, edges: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """(root, keys.., depth) of seeds (depth 0) and all nodes below them.

    seeds: keys, and root where given (else the last key). edges: keys of the child and parent, which is the last key of the
    parent; the other keys (such as the store) are shared. Either each child has one parent or each parent one child (a walk upward);
    repeated edges change nothing. A node below several seeds is listed for each, once, at its least depth. Null parents have no
    place in the result. Walks of over most steps are an error (ValueError), never cut short.
    """
    node = keys[-1]
    frontier = checkpointed((seeds if "root" in seeds.columns else seeds.withColumn("root", F.col(node))).select("root", *keys).distinct().withColumn("depth", F.lit(0)))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    links = edges.where("parent is not null").select(*keys, "parent").distinct().repartition(parts, *keys[:-1], "parent").persist(StorageLevel.DISK_ONLY)
    found, depth = [frontier], 0
    while True:
        depth += 1
        step = frontier.select("root", *keys[:-1], F.col(node).alias("parent")).join(links, [*keys[:-1], "parent"]).where(~F.col(node).eqNullSafe(F.col("root"))).select("root", *keys)
        frontier = checkpointed(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        if depth >= most:
            raise ValueError(f"a chain of more than {most} steps")
        found.append(frontier)
    links.unpersist()
    return reduce(DataFrame.unionByName, found).select("root", *keys, "depth")


def stranded(candidates: DataFrame) -> DataFrame:
    """Spooled candidates below a written or unsupported one with only spooled ones between: (store_id, item_key, depth)."""
    spooled = candidates.where("status = 'spooled'")
    done = candidates.where("status in ('written', 'unsupported')").select("store_id", F.col("item_key").alias("parent_item_key"))
    seeds = spooled.join(done, ["store_id", "parent_item_key"], "left_semi").select("store_id", "item_key")
    edges = spooled.select("store_id", "item_key", F.col("parent_item_key").alias("parent"))
    return descend(seeds, edges, ["store_id", "item_key"]).groupBy("store_id", "item_key").agg(F.min("depth").alias("depth"))


def trees(candidates: DataFrame, statuses: list[str]) -> DataFrame:
    """(root, store_id, item_key, depth) of every tree whose root has no parent, over candidates in the given states."""
    kept = candidates.where(F.col("status").isin(statuses))
    return descend(kept.where("parent_item_key is null").select("store_id", "item_key"), kept.select("store_id", "item_key", F.col("parent_item_key").alias("parent")), ["store_id", "item_key"])


def tree_sizes(tree: DataFrame) -> DataFrame:
    return tree.groupBy("store_id", "root").agg(F.count("*").alias("mails"), F.max("depth").alias("depth"))
