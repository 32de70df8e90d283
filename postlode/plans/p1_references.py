"""Problem 1: references to records that do not exist."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.operators import references as R
from postlode.session import shared_folder, table


def _state(spark: SparkSession, sf: str) -> R.State:
    return R.initial(*(table(spark, sf, t) for t in ("folders", "messages", "attachments")))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphan_references(_state(spark, sf)).select("store_id", "seq", "field")


def report(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphan_report(_state(spark, sf))


def keys(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphan_keys(_state(spark, sf))


def in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """p1_found, the rows being taken in by four batches as they were observed: records come late, are revised and are removed."""
    tables = {t: table(spark, sf, t) for t in ("folders", "messages", "attachments")}
    history = R.History(spark, f"{shared_folder(spark)}/references-{uuid.uuid4().hex}")
    cuts = tables["messages"].select(F.expr("percentile_approx(observed_at, array(0.25, 0.5, 0.75))")).first()[0] or []
    part = F.lit(0)
    for c in cuts:
        part = part + (F.coalesce(F.col("observed_at") > F.lit(c), F.lit(False))).cast("int")
    for k in range(len(cuts) + 1):
        history.apply(*(t.where(part == k) for t in tables.values()))
    return R.orphan_references(history.state()).select("store_id", "seq", "field")


_SQL = """
WITH rec AS (
  SELECT 'folders' AS target, store_id, source_id AS key_a, CAST(-1 AS BIGINT) AS key_b, seq, coalesce(removed, false) AS gone FROM folders
  UNION ALL SELECT 'messages', store_id, message_id, -1, seq, coalesce(removed, false) FROM messages
  UNION ALL SELECT 'attachments', store_id, message_id, attachment_index, seq, coalesce(removed, false) FROM attachments),
present AS (
  SELECT target, store_id, key_a, key_b FROM rec GROUP BY ALL HAVING NOT arg_max(gone, seq)),
m AS (SELECT DISTINCT store_id, seq, observed_at, folder_id, parent_message_id, parent_attachment_index FROM messages),
refs AS (
  SELECT store_id, seq, observed_at, 'folder_id' AS field, 'folders' AS target, folder_id AS key_a, CAST(-1 AS BIGINT) AS key_b FROM m WHERE folder_id IS NOT NULL
  UNION ALL SELECT store_id, seq, observed_at, 'parent_message_id', 'messages', parent_message_id, -1 FROM m WHERE parent_message_id IS NOT NULL
  UNION ALL SELECT store_id, seq, observed_at, 'parent_attachment_index', 'attachments', parent_message_id, parent_attachment_index
    FROM m WHERE parent_message_id IS NOT NULL AND parent_attachment_index IS NOT NULL),
orphans AS (SELECT * FROM refs ANTI JOIN present USING (target, store_id, key_a, key_b))
"""

QUERIES = {"p1_found": found, "p1_found_in_batches": in_batches, "p1_orphan_report": report, "p1_orphan_keys": keys}
SQL = {
    "p1_found": _SQL + "SELECT store_id, seq, field FROM orphans",
    "p1_found_in_batches": _SQL + "SELECT store_id, seq, field FROM orphans",
    "p1_orphan_report": _SQL
    + """SELECT field, target AS referenced_table, CAST(observed_at AS DATE) AS day, count(*) AS orphan_refs,
         count(DISTINCT (store_id, key_a, key_b)) AS missing_records FROM orphans GROUP BY 1, 2, 3""",
    "p1_orphan_keys": _SQL + "SELECT store_id, target, key_a, key_b, count(*) AS refs FROM orphans GROUP BY ALL",
}
