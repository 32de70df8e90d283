"""Queries of parts: publishing, committing, and their records compared column by column."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlode.operators import parts as P
from postlode.plans import ledger as B
from postlode.session import checkpointed, shared_folder, written


def _part() -> Column:
    return (F.floor(F.col("seq") / 50) + 1).cast("int").alias("part_index")


#: What a part's record in a report and its record in the ledger must have alike.
COLUMNS = ["filename", "byte_len", "sha256", "folder_count", "message_count", "oversize", "partial", "omitted_folders", "omitted_properties", "omitted_attachments"]


def _spooled(spark: SparkSession, sf: str) -> DataFrame:
    return B.keyed(spark, sf).where("status = 'spooled'").select("store_id", _part(), "item_key", "provenance", "message_class")


def published(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest after the spooled items were published in parts of 50 numbers each, in two publications, and committed nothing twice."""
    folder, items = P.Folder(spark, f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"), written(_spooled(spark, sf))
    for rest in (0, 1):
        some = items.where(F.col("part_index") % 2 == rest)
        folder.publish(some, some.groupBy(*P.KEY).agg(F.count("*").alias("items"), F.lit(0).alias("oversize")).withColumn("filename", F.format_string("part-%04d", "part_index")))
    damaged = folder.damaged().withColumn("damaged", F.lit(True))
    return folder.manifest().join(damaged, P.KEY, "left").select(*P.KEY, "filename", "items", F.coalesce("damaged", F.lit(False)).alias("damaged"), (F.col("publication") - 1).alias("odd"))


def committed(spark: SparkSession, sf: str) -> DataFrame:
    """How many candidates each state has once parts are committed, and how many items were refused, by rule."""
    c = checkpointed(B.candidates(spark, sf))
    item = lambda where, p=None: c.where(where).select("store_id", _part() if p is None else p, "item_key")
    items = item("status = 'spooled'").unionByName(item("status = 'written' and seq % 83 = 0")).unionByName(item("status = 'spooled' and seq % 89 = 0", F.lit(0).alias("part_index"))).unionByName(c.select("store_id").distinct().select("store_id", F.lit(1).alias("part_index"), F.lit("missing:item").alias("item_key")))
    after, refused = P.committed(c, items)
    return after.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("status").alias("of"), F.col("status").alias("what"), "n").unionByName(refused.groupBy("rule").agg(F.count("*").alias("n")).select(F.lit("refused").alias("of"), F.col("rule").alias("what"), "n"))


def part_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose record in the report is not that of the ledger, with the columns that differ. The report has one part in five with a
    mail too many, one in eleven without a name, and one in thirteen not at all."""
    c = B.candidates(spark, sf).where("status = 'written'")
    ledger = c.groupBy("store_id", _part()).agg(
        F.max("item_key").alias("last"), F.sum("seq").alias("byte_len"), F.countDistinct("folder_id").alias("folder_count"), F.count("*").alias("message_count"), (F.count_if(F.col("completeness") == "partial") > 0).alias("partial"),
        F.count_if(F.col("folder_id").isNull()).alias("omitted_folders"), F.count_if(F.col("message_class").isNull()).alias("omitted_properties"), F.count_if(F.col("completeness") == "damaged").alias("omitted_attachments"),
    ).select("*", F.format_string("part-%04d", "part_index").alias("filename"), F.sha2("last", 256).alias("sha256"), F.when(F.col("part_index") % 7 == 0, 1).otherwise(0).alias("oversize"))
    ledger = checkpointed(ledger)
    n = F.col("part_index")
    report = ledger.where(n % 13 != 0).withColumns({"message_count": F.when(n % 5 == 0, F.col("message_count") + 1).otherwise(F.col("message_count")), "filename": F.when(n % 11 != 0, F.col("filename"))})
    return P.differing(ledger, report, P.KEY, COLUMNS)


QUERIES = {"K09_K10_I11_published_parts": published, "K11_committed_parts": committed, "J16_I14_part_zip": part_zip}
_OF = B._CANDIDATES + ", part_of AS (SELECT *, CAST(floor(seq / 50) + 1 AS INT) AS part_index FROM cand)"
SQL = {
    "K09_K10_I11_published_parts": _OF + " SELECT store_id, part_index, 'part-' || lpad(CAST(part_index AS VARCHAR), CAST(greatest(4, length(CAST(part_index AS VARCHAR))) AS INT), '0') AS filename, count(*) AS items, false AS damaged, part_index % 2 AS odd FROM part_of WHERE status = 'spooled' GROUP BY 1, 2",
    "K11_committed_parts": _OF
    + """ SELECT 'status' AS of, CASE WHEN status = 'spooled' AND seq % 89 <> 0 THEN 'written' ELSE status END AS what, count(*) AS n FROM cand GROUP BY 1, 2
        UNION ALL SELECT 'refused', rule, count(*) FROM (
          SELECT CASE WHEN status = 'written' THEN 'not spooled' ELSE 'in several places' END AS rule FROM cand WHERE (status = 'written' AND seq % 83 = 0) OR (status = 'spooled' AND seq % 89 = 0)
          UNION ALL SELECT 'no candidate' FROM (SELECT DISTINCT store_id FROM cand)) GROUP BY 2""",
    "J16_I14_part_zip": _OF
    + """, p AS (SELECT DISTINCT store_id, part_index FROM part_of WHERE status = 'written')
        SELECT store_id, part_index, CASE WHEN part_index % 13 = 0 THEN 'missing' WHEN part_index % 55 = 0 THEN 'filename,message_count' WHEN part_index % 5 = 0 THEN 'message_count' ELSE 'filename' END AS rule
        FROM p WHERE part_index % 13 = 0 OR part_index % 5 = 0 OR part_index % 11 = 0""",
}
