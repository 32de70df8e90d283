"""Queries of reports, set differences, JSON access and the event stream over the mailbox and star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.functions.mapi import signature_column
from postlode.operators import ledger as L, packing as P, reports as R
from postlode.plans import ledger as B
from postlode.session import table


def _distinct(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name).dropDuplicates(["store_id", "seq"])


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return R.inventory(*(_distinct(spark, sf, t) for t in ("folders", "messages", "recipients", "attachments")))


def split(spark: SparkSession, sf: str) -> DataFrame:
    parts = P.parts_table(P.pack(B.packing_items(spark, sf), B.PART_LIMIT))
    return R.split_report(L.job_summary(B.candidate_rows(spark, sf)), parts)


def recovery_json(spark: SparkSession, sf: str) -> DataFrame:
    return R.as_json(L.job_summary(B.candidate_rows(spark, sf)), "recover")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def fingerprints(spark: SparkSession, sf: str, which: str) -> DataFrame:
    """Message fingerprints: class, subject, sender, ticks and the ordered recipients, as one hash a message."""
    m = B.messages(spark, sf).where(which)
    r = _distinct(spark, sf, "recipients").groupBy("store_id", "message_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("recipient_index", "recipient_type", "display_name", "email_address")))).alias("rcpt"))
    parts = ["message_class", "subject", "sender_name", "sender_email", F.col("submit_filetime").cast("string"), "rcpt"]
    return m.join(r, ["store_id", "message_id"], "left").select(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\x00")) for p in parts)), 256).alias("fingerprint"))


def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints that occur among normal messages more or less often than among the others."""
    return L.multiset_difference(fingerprints(spark, sf, "provenance = 'normal'"), fingerprints(spark, sf, "provenance <> 'normal'"), ["fingerprint"]).groupBy((F.col("missing") > 0).alias("only_normal")).agg(F.count("*").alias("fingerprints"))


QUERIES = {
    "A09_A10_inventory": inventory,
    "A15_A17_split_report": split,
    "K14_recovery_json": recovery_json,
    "A24_state_digest": lambda spark, sf: R.state_digest(L.blob_totals(B.blobs(spark, sf, B.candidates(spark, sf)))),
    "J15_reconciliation": reconciliation,
    "U03_A04_distinct_json_values": lambda spark, sf: events(spark, sf).select(F.get_json_object("props", "$.k").alias("k")).distinct(),
    "F36_P07_json_types": lambda spark, sf: events(spark, sf).groupBy("event_type").agg(F.count_if(F.expr("schema_of_variant(try_parse_json(props)) like 'OBJECT%'")).alias("objects"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_sum")),
    "S30_F09_text_bytes": lambda spark, sf: table(spark, sf, "documents").groupBy("source").agg(F.count("text").alias("texts"), F.count_if(F.is_valid_utf8("text")).alias("valid_utf8"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("peak"), F.sum(F.ceil(F.octet_length("text") / 65536)).alias("chunks")),
    "A23_K05_document_hashes": lambda spark, sf: table(spark, sf, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")),
    "U05_skip_units": lambda spark, sf: _distinct(spark, sf, "messages").select("store_id", "folder_id").distinct().join(_distinct(spark, sf, "folders").select("store_id", F.col("source_id").alias("folder_id")), ["store_id", "folder_id"], "left_anti"),
    "U06_sorted_sets": lambda spark, sf: _distinct(spark, sf, "messages").where("not supported").groupBy("store_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("message_class", F.lit("-")))), ",").alias("classes")),
    "F39_part_names": lambda spark, sf: table(spark, sf, "orders").select(F.col("o_orderkey").alias("i")).distinct().select("i", F.format_string("part-%04d.pst", "i").alias("filename")),
    "S10_block_signatures": lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", signature_column("l_orderkey * 64", "l_partkey * 65537").alias("signature")),
    "T12_daily_events": lambda spark, sf: events(spark, sf).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")),
}
_N = "count(*) FILTER"
SQL = {
    "A09_A10_inventory": f"""SELECT * FROM (SELECT count(*) AS folders FROM (SELECT DISTINCT store_id, seq FROM folders)),
      (SELECT count(*) AS messages, {_N} (len(embedded_path) > 0) AS embedded_messages, {_N} (associated) AS associated_messages, {_N} (NOT supported) AS unsupported_messages, {_N} (provenance = 'normal') AS normal_messages,
        {_N} (provenance = 'recovered') AS recovered_messages, {_N} (provenance = 'orphan') AS orphan_messages, {_N} (provenance = 'fragment') AS fragment_messages FROM (SELECT DISTINCT ON (store_id, seq) * FROM messages)),
      (SELECT count(*) AS recipients FROM (SELECT DISTINCT store_id, seq FROM recipients)),
      (SELECT count(*) AS attachments, coalesce(sum(data_size), 0) AS attachment_bytes, coalesce(max(data_size), 0) AS largest_attachment, {_N} (data_size IS NULL) AS incomplete_attachments FROM (SELECT DISTINCT ON (store_id, seq) * FROM attachments))""",
    "U03_A04_distinct_json_values": "SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events",
    "F36_P07_json_types": "SELECT event_type, count(*) FILTER (json_type(props) = 'OBJECT') AS objects, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum FROM events GROUP BY 1",
    "S30_F09_text_bytes": "SELECT source, count(text) AS texts, count(text) AS valid_utf8, coalesce(sum(strlen(text)), 0) AS bytes, coalesce(max(strlen(text)), 0) AS peak, CAST(sum(ceil(strlen(text) / 65536)) AS BIGINT) AS chunks FROM documents GROUP BY 1",
    "A23_K05_document_hashes": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "U05_skip_units": "SELECT DISTINCT store_id, folder_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM folders f WHERE f.store_id = m.store_id AND f.source_id = m.folder_id)",
    "U06_sorted_sets": "SELECT store_id, array_to_string(list_sort(list(DISTINCT coalesce(message_class, '-'))), ',') AS classes FROM messages WHERE NOT supported GROUP BY 1",
    "F39_part_names": "SELECT DISTINCT o_orderkey AS i, 'part-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0') || '.pst' AS filename FROM orders",
    "S10_block_signatures": "SELECT l_orderkey, l_linenumber, CAST(xor(xor(l_orderkey * 64, l_partkey * 65537) & 4294967295 >> 16, xor(l_orderkey * 64, l_partkey * 65537) & 65535) AS INT) AS signature FROM lineitem".replace("xor(l_orderkey * 64, l_partkey * 65537) & 4294967295 >> 16", "((xor(l_orderkey * 64, l_partkey * 65537) & 4294967295) >> 16)"),
    "T12_daily_events": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
}
