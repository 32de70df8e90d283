"""Further queries of orders, filters, trees and rejections over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.operators import canonical as C, packing as P, recursion as R
from postlode.plans import ledger as B
from postlode.session import checkpointed, table, written


def arrival_order(spark: SparkSession, sf: str) -> DataFrame:
    return P.positioned(B.candidate_rows(spark, sf).select("store_id", "seq"), "store_id", ["seq"], {}).select("store_id", "seq", "pos")


def event_order(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of each item's events in order, as text."""
    e = B.unnumbered_events(spark, sf, B.candidates(spark, sf))
    return e.groupBy("store_id", "item_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


def offsets_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    b = B.blobs(spark, sf, B.candidates(spark, sf)).withColumn("offset", F.when(F.col("byte_len") % 10 != 0, F.col("pack_offset"))).withColumn("absent", F.col("offset").isNull())
    return P.positioned(b.select("store_id", "sha256", "offset", "absent"), "store_id", ["absent", "offset", "sha256"], {}).select("store_id", "sha256", "pos")


def spooled_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Payload bytes of each mail with all that is embedded in it."""
    c = checkpointed(B.candidates(spark, sf))
    e = B.unnumbered_events(spark, sf, c).groupBy("store_id", "item_key").agg(F.coalesce(F.sum("byte_len"), F.lit(0)).alias("bytes"))
    tree = R.trees(c, ["spooled", "written", "unsupported"])
    return tree.join(e, ["store_id", "item_key"], "left").groupBy("store_id", F.col("root").alias("item_key")).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("mails"))


def rejections(spark: SparkSession, sf: str) -> DataFrame:
    return C.propagated_rejections(checkpointed(B.candidates(spark, sf).select("store_id", "item_key", "parent_item_key", "status")))


def part_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Of each part the paths of its items are written once, each once; they are read for the parts and for the folders of whole stores."""
    parts = written(B.packing_items(spark, sf).select("store_id", "folder_path", (F.floor(F.col("seq") / 500) + 1).cast("int").alias("part_index")).distinct())
    return C.part_folders(parts, parts.select("store_id", "folder_path")).withColumn("prefix", F.array_join("prefix", "/"))


def replays(spark: SparkSession, sf: str) -> DataFrame:
    """Rows delivered, distinct rows, and rows that a replay repeats, of each table."""
    each = [table(spark, sf, t).groupBy("store_id", "seq").agg(F.count("*").alias("n")).agg(F.lit(t).alias("source_table"), F.coalesce(F.sum("n"), F.lit(0)).alias("delivered"), F.count("*").alias("distinct_rows")) for t in ("folders", "messages", "recipients", "attachments")]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.withColumn("replayed", F.col("delivered") - F.col("distinct_rows"))


QUERIES = {
    "O03_arrival_order": arrival_order,
    "O04_event_order": event_order,
    "O05_offsets_nulls_last": offsets_nulls_last,
    "A14_spooled_bytes": spooled_bytes,
    "L02_next_candidate": lambda spark, sf: B.candidate_rows(spark, sf).where("status = 'spooled'").groupBy("store_id").agg(F.min("seq").alias("seq")),
    "P01_P02_top_level_by_status": lambda spark, sf: B.candidate_rows(spark, sf).where("status in ('spooled', 'written', 'unsupported') and parent_message_id is null").groupBy("status").agg(F.count("*").alias("n")),
    "P03_P04_null_safe": lambda spark, sf: B.messages(spark, sf).groupBy(F.expr("sender_name <=> sender_email").alias("same"), (~F.col("submit_filetime").eqNullSafe(F.col("delivery_filetime"))).alias("times_differ")).agg(F.count("*").alias("n")),
    "P05_null_parity": lambda spark, sf: B.messages(spark, sf).where("(parent_message_id is null) <> (parent_attachment_index is null)").select("store_id", "seq"),
    "X16_rejection_propagation": rejections,
    "X18_part_folders": part_folders,
    "T05_replays": replays,
}
SQL = {
    "O03_arrival_order": B._CANDIDATES + "SELECT store_id, seq, row_number() OVER (PARTITION BY store_id ORDER BY seq) - 1 AS pos FROM cand",
    "O04_event_order": B._EVENTS + "SELECT store_id, item_key, string_agg(kind, ',' ORDER BY seq) AS kinds FROM ev GROUP BY 1, 2",
    "O05_offsets_nulls_last": B._EVENTS + "SELECT store_id, sha256, row_number() OVER (PARTITION BY store_id ORDER BY CASE WHEN byte_len % 10 <> 0 THEN pack_offset END NULLS LAST, sha256) - 1 AS pos FROM packed",
    "A14_spooled_bytes": B._EVENTS + B._TREES + """, eb AS (SELECT store_id, item_key, coalesce(sum(byte_len), 0) AS bytes FROM ev GROUP BY 1, 2)
      SELECT t.store_id, root AS item_key, coalesce(sum(bytes), 0) AS bytes, count(*) AS mails FROM tree t LEFT JOIN eb USING (store_id, item_key) GROUP BY 1, 2""",
    "L02_next_candidate": B._CANDIDATES + "SELECT store_id, min(seq) AS seq FROM cand WHERE status = 'spooled' GROUP BY 1",
    "P01_P02_top_level_by_status": B._CANDIDATES + "SELECT status, count(*) AS n FROM cand WHERE status IN ('spooled', 'written', 'unsupported') AND parent_message_id IS NULL GROUP BY 1",
    "P03_P04_null_safe": "SELECT sender_name IS NOT DISTINCT FROM sender_email AS same, submit_filetime IS DISTINCT FROM delivery_filetime AS times_differ, count(*) AS n FROM (SELECT DISTINCT ON (store_id, seq) * FROM messages) GROUP BY 1, 2",
    "P05_null_parity": "SELECT DISTINCT store_id, seq FROM messages WHERE (parent_message_id IS NULL) <> (parent_attachment_index IS NULL)",
    "X16_rejection_propagation": B._CANDIDATES + """, upw AS (SELECT store_id, parent_item_key AS item_key FROM cand WHERE status = 'unsupported' AND parent_item_key IS NOT NULL
        UNION SELECT c.store_id, c.parent_item_key FROM upw JOIN cand c ON c.store_id = upw.store_id AND c.item_key = upw.item_key WHERE c.parent_item_key IS NOT NULL)
      SELECT store_id, item_key, 'source_item_unsupported' AS category FROM cand WHERE status = 'unsupported'
      UNION ALL SELECT store_id, item_key, 'item_graph_dependency_rejected' FROM upw WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.store_id = upw.store_id AND c.item_key = upw.item_key AND c.status = 'unsupported')""",
    "X18_part_folders": B._PACK_ITEMS.replace("SELECT c.store_id, c.item_key, coalesce(location", "SELECT c.store_id, c.seq, c.item_key, coalesce(location") + """, pr AS (SELECT store_id, CAST(floor(seq / 500) + 1 AS INT) AS part_index, unnest(range(1, len(folder_path) + 1)) AS k, folder_path FROM pitem),
      al AS (SELECT store_id, unnest(range(1, len(folder_path) + 1)) AS k, folder_path FROM pitem WHERE store_id IN (SELECT store_id FROM pr WHERE part_index = 1))
      SELECT store_id, part_index, array_to_string(folder_path[1:k], '/') AS prefix FROM (SELECT DISTINCT store_id, part_index, folder_path[1:k] AS folder_path, k FROM pr UNION SELECT DISTINCT store_id, 1, folder_path[1:k], k FROM al)""",
    "T05_replays": " UNION ALL ".join(f"SELECT '{t}' AS source_table, count(*) AS delivered, count(DISTINCT (store_id, seq)) AS distinct_rows, count(*) - count(DISTINCT (store_id, seq)) AS replayed FROM {t}" for t in ("folders", "messages", "recipients", "attachments")),
}
