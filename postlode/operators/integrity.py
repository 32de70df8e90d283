"""Integrity rules of the ledger: each returns the rows that break it; an empty result is a pass.

All take the ledger tables by name and work on null-safe comparisons; absent rows are found by anti-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from postlode.operators.ledger import is_sha256, null_parity_differs

Tables = dict[str, DataFrame]
_ITEM = ["store_id", "item_key"]


def pending(t: Tables) -> DataFrame:
    return t["candidates"].where("status = 'pending'").select("store_id", F.col("item_key").alias("offender"))


def blob_parity(t: Tables) -> DataFrame:
    return t["candidate_events"].where(null_parity_differs("blob_sha256", "byte_len")).select("store_id", F.concat_ws("#", "item_key", "sequence").alias("offender"))


def event_length(t: Tables) -> DataFrame:
    b = t["blobs"].select("store_id", F.col("sha256").alias("blob_sha256"), F.col("byte_len").alias("stored"))
    return t["candidate_events"].where("blob_sha256 is not null").join(b, ["store_id", "blob_sha256"], "left").where("not (byte_len <=> stored)").select("store_id", F.concat_ws("#", "item_key", "sequence").alias("offender"))


def unreferenced_blob(t: Tables) -> DataFrame:
    used = t["candidate_events"].select("store_id", F.col("blob_sha256").alias("sha256"))
    return t["blobs"].join(used, ["store_id", "sha256"], "left_anti").select("store_id", F.col("sha256").alias("offender"))


def written_without_part(t: Tables) -> DataFrame:
    return t["candidates"].where("status = 'written'").join(t["part_items"], _ITEM, "left_anti").select("store_id", F.col("item_key").alias("offender"))


def part_item_not_written(t: Tables) -> DataFrame:
    return t["part_items"].join(t["candidates"].where("status = 'written'"), _ITEM, "left_anti").select("store_id", F.col("item_key").alias("offender"))


def empty_part(t: Tables) -> DataFrame:
    return t["parts"].join(t["part_items"], ["store_id", "part_index"], "left_anti").select("store_id", F.col("part_index").cast("string").alias("offender"))


def oversize_part(t: Tables) -> DataFrame:
    top = t["candidates"].where("parent_item_key is null").select(*_ITEM)
    n = t["part_items"].join(top, _ITEM).groupBy("store_id", "part_index").agg(F.count("*").alias("n"))
    return t["parts"].where("oversize = 1").join(n, ["store_id", "part_index"], "left").where("coalesce(n, 0) <> 1").select("store_id", F.col("part_index").cast("string").alias("offender"))


def pack_overlap(t: Tables) -> DataFrame:
    """Blobs that start before the end of the one before them. Ends are compared along the pack in ranges of 64 Mi bytes, so that no
    window spans a whole store: an overlap shows within a range or against the largest end of all earlier ranges."""
    b = t["blobs"].where("pack_offset is not null and byte_len > 0").select("store_id", "sha256", "pack_offset", (F.col("pack_offset") + F.col("byte_len")).alias("end"), F.floor(F.col("pack_offset") / (1 << 26)).alias("range"))
    order = W.partitionBy("store_id", "range").orderBy("pack_offset", "sha256")
    ends = b.groupBy("store_id", "range").agg(F.max("end").alias("e"))
    earlier = ends.select("store_id", "range", F.max("e").over(W.partitionBy("store_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    inside = b.withColumn("previous", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    return inside.join(earlier, ["store_id", "range"]).where("pack_offset < greatest(previous, before)").select("store_id", F.col("sha256").alias("offender"))


def blob_identity(t: Tables) -> DataFrame:
    """Blobs with a hash that isn't one, a negative length, or more than one row."""
    return t["blobs"].groupBy("store_id", "sha256").agg(F.count("*").alias("n"), F.min("byte_len").alias("least")).where(~is_sha256("sha256") | (F.col("n") > 1) | (F.coalesce(F.col("least"), F.lit(-1)) < 0)).select("store_id", F.coalesce("sha256", F.lit("-")).alias("offender"))


def rejections(t: Tables) -> DataFrame:
    """Unsupported candidates without exactly one rejection event, and others with any."""
    n = t["candidate_events"].where("kind = 'output_unrepresentable'").groupBy(*_ITEM).agg(F.count("*").alias("n"))
    return t["candidates"].join(n, _ITEM, "left").where("coalesce(n, 0) <> case when status = 'unsupported' then 1 else 0 end").select("store_id", F.col("item_key").alias("offender"))


def foreign_keys(t: Tables) -> DataFrame:
    """Events of no candidate, items of no part or candidate, and parents that aren't there."""
    keys = t["candidates"].select(*_ITEM)
    parents = t["candidates"].where("parent_item_key is not null").select("store_id", F.col("parent_item_key").alias("item_key"))
    parts = [t["candidate_events"].select(*_ITEM).distinct(), t["part_items"].select(*_ITEM), parents.distinct()]
    return reduce(DataFrame.unionByName, [p.join(keys, _ITEM, "left_anti") for p in parts]).select("store_id", F.col("item_key").alias("offender")).distinct()


def duplicate_items(t: Tables) -> DataFrame:
    return t["part_items"].groupBy(*_ITEM).count().where("count > 1").select("store_id", F.col("item_key").alias("offender"))


def ownership(t: Tables) -> DataFrame:
    """Candidates whose parent key and attachment index aren't set together, whose path is empty though embedded or the other way
    round, or that share a slot (parent, index) with another."""
    c = t["candidates"]
    half = c.where(null_parity_differs("parent_item_key", "parent_attachment_index")).select(*_ITEM)
    path = c.where("(parent_item_key is null) <> (embedded_path_json = '[]')").select(*_ITEM)
    slots = c.where("parent_item_key is not null").groupBy("store_id", "parent_item_key", "parent_attachment_index").agg(F.count("*").alias("n")).where("n > 1")
    shared = c.join(slots, ["store_id", "parent_item_key", "parent_attachment_index"], "left_semi").select(*_ITEM)
    return half.unionByName(path).unionByName(shared).select("store_id", F.col("item_key").alias("offender")).distinct()


def unknown_kinds(t: Tables) -> DataFrame:
    from postlode.schema import EVENT_KINDS

    return t["candidate_events"].where(~F.coalesce(F.col("kind").isin(EVENT_KINDS), F.lit(False))).select("store_id", F.concat_ws("#", "item_key", "sequence").alias("offender"))


RULES = {
    "I01_pending": pending, "I02_blob_parity": blob_parity, "I03_event_length": event_length, "I04_unreferenced_blob": unreferenced_blob,
    "I05_written_without_part": written_without_part, "I06_part_item_not_written": part_item_not_written, "I07_empty_part": empty_part,
    "I08_oversize_part": oversize_part, "I09_pack_overlap": pack_overlap, "I10_blob_identity": blob_identity, "I12_rejections": rejections,
    "I13_foreign_keys": foreign_keys, "I16_ownership": ownership, "I17_duplicate_items": duplicate_items, "X_unknown_event_kinds": unknown_kinds,
}


def report(t: Tables) -> DataFrame:
    """(rule, offenders) of all rules, those that pass included."""
    each = [rule(t).select(F.lit(name).alias("rule"), F.col("offender")) for name, rule in RULES.items()]
    names = t["candidates"].sparkSession.createDataFrame([(n,) for n in RULES], "rule string")
    found = reduce(DataFrame.unionByName, each).groupBy("rule").agg(F.count("*").alias("offenders"))
    return names.join(F.broadcast(found), "rule", "left").select("rule", F.coalesce("offenders", F.lit(0).cast("bigint")).alias("offenders"))  # a row per rule


def counters_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns in which two one-row frames differ: (name, left_value, right_value)."""
    long = lambda d, v: d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias(v)) for c in d.columns))).alias("s")).select("s.*")
    return long(a, "left_value").join(long(b, "right_value"), "name", "full").where("not (left_value <=> right_value)")
