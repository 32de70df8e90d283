"""The candidate ledger: keys, parents, deduplication, events, blobs, and the joins and aggregates over them.

Nulls: keys built from null ids hold a dash; comparisons of ids are null-safe where the ledger's are. Rows that share a key are
told apart by seq, never by arrival. Empty tables give empty results, totals over them are 0. Columns that an operator doesn't
name pass through or are dropped as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postlode.schema import PROVENANCE, rank


# --- keys, parents, duplicates --------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, keys: list[str], name: str, block: int = 1 << 16) -> DataFrame:
    """Adds name: 1, 2, ... within each key by seq, nulls in keys being equal.

    A key may hold a third of all rows. seq is unique within a store, so a window over a key and a block of seq holds at most block
    rows; counts of the blocks, folded before they are shuffled, are added up per key and joined back.
    """
    k = rows.withColumn("_k", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).withColumn("_b", F.floor(F.col("seq") / block))
    counts = k.groupBy("_k", "_b").agg(F.count("*").alias("_n"))
    before = counts.select("_k", "_b", F.coalesce(F.sum("_n").over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    local = F.row_number().over(W.partitionBy("_k", "_b").orderBy("seq"))
    return k.withColumn("_r", local).join(before, ["_k", "_b"]).withColumn(name, (F.col("_r") + F.col("_s")).cast("int")).drop("_k", "_b", "_r", "_s")


def with_occurrence(rows: DataFrame) -> DataFrame:
    """Adds occurrence: how many earlier rows (by seq) have the same store, provenance, node and recovery index, nulls being equal."""
    return numbered(rows, ["store_id", "provenance", "source_node_id", "recovery_index"], "occurrence").withColumn("occurrence", F.col("occurrence") - 1)


def item_key(provenance="provenance", node="source_node_id", index="recovery_index", occurrence="occurrence") -> Column:
    """provenance:node:index:occurrence, a dash standing for null."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.concat_ws(":", F.col(provenance), part(node), part(index), F.col(occurrence).cast("string"))


def last_before(rows: DataFrame, keys: list[str], seq: str, value: str, into: str, block: int = 1 << 16) -> DataFrame:
    """Adds into: the non-null value of the row before it (by seq) within each key, nulls in keys being equal; null without one.

    A key may hold a third of all rows. A window spans a key and a block of seq, which has at most block rows; the last value of each
    block is one row, and those are carried over the blocks of a key and joined back.
    """
    k = rows.withColumn("_k", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).withColumn("_b", F.floor(F.col(seq) / block))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    ends = k.where(F.col(value).isNotNull()).groupBy("_k", "_b").agg(F.max_by(value, seq).alias("_e"))
    blocks = k.select("_k", "_b").distinct().join(ends, ["_k", "_b"], "left")
    carried = blocks.select("_k", "_b", last("_e", W.partitionBy("_k").orderBy("_b")).alias("_c"))
    return k.withColumn("_l", last(value, W.partitionBy("_k", "_b").orderBy(seq))).join(carried, ["_k", "_b"]).withColumn(into, F.coalesce("_l", "_c")).drop("_k", "_b", "_l", "_c")


def with_parent(candidates: DataFrame) -> DataFrame:
    """Adds parent_item_key: of a row with a parent_message_id, the latest earlier candidate (by seq) of the same store, provenance and
    recovery index whose embedded path is the row's path without its last index, and that is not pending; null without one. A row whose
    path is empty or ends in another index than parent_attachment_index has none."""
    same = ["store_id", "provenance", "recovery_index"]
    own = candidates.select(*same, "seq", F.coalesce("embedded_path", F.array().cast("array<int>")).alias("way"), F.when(F.col("status") != "pending", F.col("item_key")).alias("item_key"))
    embedded = candidates.where("parent_message_id is not null and size(embedded_path) > 0 and element_at(embedded_path, -1) <=> parent_attachment_index")
    asking = embedded.select(*same, "seq", F.slice("embedded_path", 1, F.size("embedded_path") - 1).alias("way"), F.lit(None).cast("string").alias("item_key"))
    # a row may ask under the same path that others answer for; it never answers itself, as its own path is longer
    both = own.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))
    found = last_before(both, [*same, "way"], "seq", "item_key", "parent_item_key").where("asks and parent_item_key is not null").select("store_id", "seq", "parent_item_key")
    return candidates.join(found, ["store_id", "seq"], "left")


def first_wins(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, issues): of top-level rows with the same non-zero node, the first by provenance and seq is kept, later ones are issues.
    Node 0, null nodes and embedded rows are always kept."""
    open_ = F.coalesce(F.col("source_node_id") == 0, F.lit(True)) | (F.col("embedded_depth") > 0)
    exempt, checked = candidates.where(open_), candidates.where(~open_)
    first = checked.groupBy("store_id", "source_node_id").agg(F.min(F.struct(rank("provenance", PROVENANCE).alias("r"), "seq")).alias("f")).select("store_id", "source_node_id", F.col("f.seq").alias("_first"))
    judged = checked.join(first, ["store_id", "source_node_id"])
    kept, later = (judged.where(c).select(*candidates.columns) for c in ("seq = _first", "seq <> _first"))
    return exempt.unionByName(kept), later


def numbered_events(events: DataFrame) -> DataFrame:
    """Adds sequence: 1, 2, ... per item in the order of seq."""
    return numbered(events, ["store_id", "item_key"], "sequence")


def stored_blobs(payloads: DataFrame) -> DataFrame:
    """(store_id, sha256, byte_len, references, conflicting, storage_class) of (store_id, sha256, byte_len): one row per content; it
    conflicts if its lengths differ. Payload bytes stay out of this shuffle."""
    size = F.col("byte_len")
    return (
        payloads.where("sha256 is not null").groupBy("store_id", "sha256").agg(F.min(size).alias("byte_len"), F.count("*").alias("references"), (F.coalesce(F.min(size), F.lit(-1)) != F.coalesce(F.max(size), F.lit(-1))).alias("conflicting"))
        .withColumn("storage_class", F.when(F.col("byte_len") <= 65536, "inline").otherwise("pack"))
    )


def with_pack_offsets(blobs: DataFrame) -> DataFrame:
    """Adds pack_offset: the running sum of lengths per store in the order of the hash.

    A store may hold a third of all blobs, so no window spans a store: blobs are range-partitioned by (store, hash prefix), summed
    per prefix, and offsets are the sum over smaller prefixes (at most 4,096 to a store) plus a window within one prefix.
    """
    b = blobs.withColumn("_p", F.substring("sha256", 1, 3))
    sums = b.groupBy("store_id", "_p").agg(F.sum("byte_len").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy("store_id").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("byte_len").over(W.partitionBy("store_id", "_p").orderBy("sha256").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("_w", within).join(sums.select("store_id", "_p", before.alias("_b")), ["store_id", "_p"]).withColumn("pack_offset", F.col("_b") + F.col("_w")).drop("_p", "_w", "_b")


# --- predicates -----------------------------------------------------------------------------------------------------------


def is_sha256(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def null_parity_differs(a: str, b: str) -> Column:
    return F.col(a).isNull() != F.col(b).isNull()


def descends_from(c: Column, root: str) -> Column:
    """Whether a dotted class lies below root, letter case ignored, with something after the dot."""
    low = F.lower(c)
    return F.coalesce(low.startswith(root.lower() + ".") & (F.length(c) > len(root) + 1), F.lit(False))


def is_or_descends_from(c: Column, root: str) -> Column:
    return F.coalesce(F.lower(c) == root.lower(), F.lit(False)) | descends_from(c, root)


def class_flags(c: Column) -> dict[str, Column]:
    """Boolean columns of a message class."""
    any_of = lambda root: is_or_descends_from(c, root)
    flags = {
        "is_contact": any_of("IPM.Contact"),
        "is_distribution_list": any_of("IPM.DistList"),
        "is_document": descends_from(c, "IPM.Document"),
        "is_appointment": any_of("IPM.Appointment"),
        "is_meeting": descends_from(c, "IPM.Schedule.Meeting"),
        "is_task": any_of("IPM.Task"),
        "is_note_item": any_of("IPM.StickyNote"),
        "is_calendar_exception": F.coalesce(F.lower(c) == "ipm.ole.class.{00061055-0000-0000-c000-000000000046}", F.lit(False)),
    }
    sent = any_of("IPM.Note") | descends_from(c, "REPORT.IPM.Note") | flags["is_meeting"]
    flags["sender_optional"] = ~sent
    return flags


def supported_class(c: Column, embedded: Column) -> Column:
    """Non-empty, and a calendar exception only if embedded."""
    return F.coalesce(F.length(c) > 0, F.lit(False)) & (~class_flags(c)["is_calendar_exception"] | embedded)


# --- aggregates -----------------------------------------------------------------------------------------------------------


def job_summary(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of all candidates and of those in each state that reports name; one row, or one per value of by."""
    hits = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return candidates.groupBy(*(by or [])).agg(F.count("*").alias("total"), hits("status", "spooled"), hits("status", "written"), hits("status", "unsupported"), hits("completeness", "partial"), hits("completeness", "damaged"), F.count_if(F.col("provenance") != "normal").alias("recovered_items"))


def rejection_counts(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """(rule, category, n): rejected candidates by the category of their one rejection event (rule counted), and those that break the
    rule: rejected ones with no event or several, and others with one. A category that is null reads as a dash."""
    e = events.where("kind = 'output_unrepresentable'").groupBy("store_id", "item_key").agg(F.count("*").alias("_n"), F.min(F.get_json_object("metadata_json", "$.category")).alias("category"))
    j = candidates.select("store_id", "item_key", "status").join(e, ["store_id", "item_key"], "left").where("status = 'unsupported' or _n is not null")
    rule = F.when(F.col("status") != "unsupported", "not rejected").when(F.col("_n").isNull(), "no event").when(F.col("_n") > 1, "several events").otherwise("counted")
    return j.select(rule.alias("rule"), F.when(rule == "counted", F.coalesce("category", F.lit("-"))).otherwise("-").alias("category")).groupBy("rule", "category").agg(F.count("*").alias("n"))


def blob_totals(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("byte_len"), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.col("pack_offset") + F.col("byte_len")), F.lit(0)).alias("pack_end"))


def capped(issues: DataFrame, order: list[str], cap: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(the first cap issues by order, one row with how many more there are). The report's cap is the feature here."""
    return issues.orderBy(*order).limit(cap), issues.agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("dropped"))


def keyset_page(rows: DataFrame, after: tuple[int, int], size: int = 1024) -> DataFrame:
    """The next size rows beyond (store_id, seq), in that order. The page is the feature."""
    return rows.where((F.col("store_id") > after[0]) | ((F.col("store_id") == after[0]) & (F.col("seq") > after[1]))).orderBy("store_id", "seq").limit(size)


# --- multisets ------------------------------------------------------------------------------------------------------------


def multiset_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, missing, surplus: how often each key is expected more or found more. Both sides are counted before they meet, so a key
    that holds a third of the rows is one row in the shuffle."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("_d"))
    a = actual.groupBy(*keys).agg((-F.count("*")).alias("_d"))
    return e.unionByName(a).groupBy(*keys).agg(F.sum("_d").alias("_d")).where("_d <> 0").select(*keys, F.greatest("_d", F.lit(0).cast("bigint")).alias("missing"), F.greatest(-F.col("_d"), F.lit(0).cast("bigint")).alias("surplus"))


def multiset_contains(needle: Column, hay: Column) -> Column:
    """Whether the array needle, with multiplicity, is within the array hay. Nulls in arrays count as values."""
    return F.forall(F.array_distinct(needle), lambda x: F.size(F.filter(needle, lambda y: y.eqNullSafe(x))) <= F.size(F.filter(hay, lambda y: y.eqNullSafe(x))))


def folder_prefixes(path: str) -> Column:
    """All prefixes of a path, each an array; an empty or null path has none."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))), lambda i: F.slice(path, 1, i))).otherwise(F.array().cast("array<array<string>>"))


def prefix_join(mails: DataFrame, folders: DataFrame, path: str = "folder_path") -> DataFrame:
    """Mails with every folder whose path is a prefix of theirs: prefixes are exploded, so the join is on equality."""
    return mails.withColumn("_prefix", F.explode(folder_prefixes(path))).join(folders.withColumnRenamed(path, "_prefix"), "_prefix").withColumnRenamed("_prefix", "prefix_path")
