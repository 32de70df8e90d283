"""Problem 4: folder rows as full hierarchies.

p4_descendant_counts and p4_ancestor_pairs are those of folders that reach a root, as their SQL twins define them. p4_all_... have
every present folder: those on or below a cycle too, with a null depth. A member of a cycle has the other members and all that hangs
below any of them as descendants, each once and never itself, at the least number of steps; a folder below a cycle has its subtree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.operators import hierarchy as H
from postlode.session import checkpointed, table


def _nodes(spark: SparkSession, sf: str, name: str | None = None) -> DataFrame:
    return H.current_nodes(table(spark, sf, "folders"), "store_id", "source_id", "parent_source_id", "seq", "removed", name)


def found(spark: SparkSession, sf: str) -> DataFrame:
    reached, rest = H.hierarchy(_nodes(spark, sf))
    return reached.select(F.col("tree").alias("store_id"), F.col("node").alias("source_id"), F.col("root").alias("root_source_id"), F.array_join(F.col("id_path").cast("array<string>"), "/").alias("id_path")).unionByName(
        rest.select(F.col("tree").alias("store_id"), F.col("node").alias("source_id"), F.col("cycle_min").alias("root_source_id"), F.when(F.col("on_cycle"), "on cycle").otherwise("below cycle").alias("id_path"))
    )


def names(spark: SparkSession, sf: str) -> DataFrame:
    reached, _ = H.hierarchy(_nodes(spark, sf, "name"))
    return reached.select(F.col("tree").alias("store_id"), F.col("node").alias("source_id"), "depth", H.joined_path("name_path", "id_path").alias("folder_path"))


def descendants(spark: SparkSession, sf: str) -> DataFrame:
    reached, _ = H.hierarchy(_nodes(spark, sf))
    return H.descendant_counts(reached).select(F.col("tree").alias("store_id"), F.col("node").alias("source_id"), "depth", "descendants", "children", "height")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    reached, _ = H.hierarchy(_nodes(spark, sf))
    return H.ancestor_pairs(reached).select(F.col("tree").alias("store_id"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("source_id"), "distance")


def all_descendants(spark: SparkSession, sf: str) -> DataFrame:
    nodes = checkpointed(_nodes(spark, sf))
    reached, rest = H.hierarchy(nodes)
    counts = H.descendant_counts(reached).unionByName(H.unreached_counts(H.opened_cycles(nodes, rest)))
    return counts.select(F.col("tree").alias("store_id"), F.col("node").alias("source_id"), "depth", "descendants", "children", "height")


def all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    nodes = checkpointed(_nodes(spark, sf))
    reached, rest = H.hierarchy(nodes)
    found = H.ancestor_pairs(reached).unionByName(H.unreached_pairs(H.opened_cycles(nodes, rest)))
    return found.select(F.col("tree").alias("store_id"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("source_id"), "distance")


_SQL = r"""
WITH RECURSIVE latest AS (
  SELECT store_id, source_id, arg_max({'p': parent_source_id, 'n': name, 'g': coalesce(removed, false)}, seq) AS v FROM folders GROUP BY ALL),
f AS (SELECT store_id, source_id, v.p AS p, v.n AS name FROM latest WHERE NOT v.g),
e AS (SELECT f.*, q.source_id AS parent FROM f LEFT JOIN f q ON q.store_id = f.store_id AND q.source_id = f.p),
up AS (
  SELECT store_id, source_id, source_id AS root, 1 AS depth, [source_id] AS ids,
    [coalesce(nullif(regexp_replace(name, '([/\\])', '\\\1', 'g'), ''), 'Recovered Folder ' || source_id)] AS parts FROM e WHERE parent IS NULL
  UNION ALL
  SELECT e.store_id, e.source_id, up.root, up.depth + 1, list_append(up.ids, e.source_id),
    list_append(up.parts, coalesce(nullif(regexp_replace(e.name, '([/\\])', '\\\1', 'g'), ''), 'Recovered Folder ' || e.source_id))
  FROM up JOIN e ON e.store_id = up.store_id AND e.parent = up.source_id),
lost AS (SELECT e.store_id, e.source_id, e.parent FROM e ANTI JOIN up USING (store_id, source_id)),
walk AS (
  SELECT store_id, source_id, parent AS pos FROM lost
  UNION SELECT w.store_id, w.source_id, l.parent FROM walk w JOIN lost l ON l.store_id = w.store_id AND l.source_id = w.pos),
cyc AS (SELECT store_id, source_id FROM walk WHERE pos = source_id),
least AS (
  SELECT w.store_id, w.source_id, min(w.pos) AS root FROM walk w JOIN cyc c ON c.store_id = w.store_id AND c.source_id = w.pos GROUP BY ALL)
"""

#: Follows _SQL: the chains of the folders that reach no root, up to where they meet themselves, and the pairs of all folders.
_ALL_SQL = (
    _SQL
    + """, chain AS (
  SELECT store_id, source_id, [source_id] AS ids, parent AS nxt FROM lost
  UNION ALL SELECT c.store_id, c.source_id, list_append(c.ids, c.nxt), l.parent
  FROM chain c JOIN lost l ON l.store_id = c.store_id AND l.source_id = c.nxt WHERE NOT list_contains(c.ids, c.nxt)),
above AS (
  SELECT store_id, unnest(ids) AS a, source_id, depth - 1 - unnest(range(len(ids))) AS distance FROM up
  UNION ALL SELECT store_id, nxt, source_id, len(ids) FROM chain WHERE NOT list_contains(ids, nxt))
"""
)

QUERIES = {
    "p4_found": found, "p4_folder_paths": names, "p4_descendant_counts": descendants, "p4_ancestor_pairs": pairs,
    "p4_all_descendant_counts": all_descendants, "p4_all_ancestor_pairs": all_pairs,
}
SQL = {
    "p4_found": _SQL
    + """SELECT store_id, source_id, root AS root_source_id, array_to_string(ids, '/') AS id_path FROM up
         UNION ALL SELECT l.store_id, l.source_id, l.root, CASE WHEN c.source_id IS NULL THEN 'below cycle' ELSE 'on cycle' END
         FROM least l LEFT JOIN cyc c ON c.store_id = l.store_id AND c.source_id = l.source_id""",
    "p4_folder_paths": _SQL + "SELECT store_id, source_id, depth, array_to_string(parts, '/') AS folder_path FROM up",
    "p4_descendant_counts": _SQL
    + """, pairs AS (SELECT store_id, source_id, depth, unnest(ids) AS a, unnest(range(len(ids))) AS i FROM up),
         below AS (SELECT store_id, a, count(*) AS n, count(*) FILTER (depth - 1 - i = 1) AS k, max(depth - 1 - i) AS h FROM pairs WHERE a <> source_id GROUP BY ALL)
         SELECT up.store_id, up.source_id, up.depth, coalesce(n, 0) AS descendants, coalesce(k, 0) AS children, coalesce(h, 0) AS height
         FROM up LEFT JOIN below b ON b.store_id = up.store_id AND b.a = up.source_id""",
    "p4_ancestor_pairs": _SQL
    + """, pairs AS (SELECT store_id, source_id, depth, unnest(ids) AS a, unnest(range(len(ids))) AS i FROM up)
         SELECT store_id, a AS ancestor_id, source_id, depth - 1 - i AS distance FROM pairs WHERE i < depth - 1""",
    "p4_all_descendant_counts": _ALL_SQL
    + """, below AS (SELECT store_id, a, count(*) AS n, count(*) FILTER (distance = 1) AS k, max(distance) AS h FROM above WHERE a <> source_id GROUP BY ALL)
         SELECT e.store_id, e.source_id, up.depth, coalesce(n, 0) AS descendants, coalesce(k, 0) AS children, coalesce(h, 0) AS height
         FROM e LEFT JOIN up USING (store_id, source_id) LEFT JOIN below b ON b.store_id = e.store_id AND b.a = e.source_id""",
    "p4_all_ancestor_pairs": _ALL_SQL + "SELECT store_id, a AS ancestor_id, source_id, distance FROM above WHERE a <> source_id",
}
