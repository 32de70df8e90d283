"""The ledger over the mailbox tables, and the queries of its relational operators.

A message row is a candidate, recipients and attachments are its events, attachment names stand for payloads. The SQL twins share
one chain of CTEs that states the same projection for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.operators import canonical as C, integrity as I, ledger as L, packing as P, recursion as R
from postlode.session import checkpointed, table, written

#: Bytes of a part in the packing queries.
PART_LIMIT = 16 << 20


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "messages").dropDuplicates(["store_id", "seq"])


def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates before they get a key and a parent."""
    m = messages(spark, sf)
    gone = F.coalesce("removed", F.lit(False))
    status = F.when(gone, "failed").when(~L.supported_class(F.coalesce("message_class", F.lit("")), F.size("embedded_path") > 0) | ~F.coalesce("supported", F.lit(False)), "unsupported").when(F.col("seq") % 3 == 0, "written").otherwise("spooled")
    completeness = F.when(F.col("message_class").isNull(), "damaged").when(F.col("submit_filetime").isNull(), "partial").otherwise("complete")
    return m.select(
        "store_id", "seq", "provenance", F.nullif("message_id", F.lit(0)).alias("source_node_id"), "recovery_index", "parent_message_id", "parent_attachment_index", "folder_id", "message_class", "associated",
        F.coalesce(F.to_json("embedded_path"), F.lit("[]")).alias("embedded_path_json"), "embedded_path", F.size(F.coalesce("embedded_path", F.array().cast("array<int>"))).alias("embedded_depth"),
        completeness.alias("completeness"), status.alias("status"),
    )


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with their key, but without a parent. They are written once: a query reads them several times over, and a plan that makes
    them anew each time takes minutes to compile and run."""
    return written(L.with_occurrence(candidate_rows(spark, sf)).withColumn("item_key", L.item_key()))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return L.with_parent(keyed(spark, sf))


_CANDIDATES = """
WITH RECURSIVE m AS (SELECT DISTINCT ON (store_id, seq) * FROM messages),
k AS (
  SELECT store_id, seq, provenance, nullif(message_id, 0) AS source_node_id, recovery_index, parent_message_id, parent_attachment_index, folder_id, message_class, associated, embedded_path,
    coalesce(CAST(to_json(embedded_path) AS VARCHAR), '[]') AS embedded_path_json, coalesce(len(embedded_path), 0) AS embedded_depth,
    CASE WHEN message_class IS NULL THEN 'damaged' WHEN submit_filetime IS NULL THEN 'partial' ELSE 'complete' END AS completeness,
    CASE WHEN coalesce(removed, false) THEN 'failed' WHEN coalesce(message_class, '') = '' OR NOT coalesce(supported, false)
         OR (lower(message_class) = 'ipm.ole.class.{00061055-0000-0000-c000-000000000046}' AND coalesce(len(embedded_path), 0) = 0) THEN 'unsupported'
         WHEN seq % 3 = 0 THEN 'written' ELSE 'spooled' END AS status,
    row_number() OVER (PARTITION BY store_id, provenance, nullif(message_id, 0), recovery_index ORDER BY seq) - 1 AS occurrence
  FROM m),
keyed AS (SELECT *, provenance || ':' || coalesce(source_node_id::VARCHAR, '-') || ':' || coalesce(recovery_index::VARCHAR, '-') || ':' || occurrence AS item_key FROM k),
par AS (
  SELECT c.store_id, c.seq, p.item_key AS parent_item_key
  FROM (SELECT *, coalesce(recovery_index, -1) AS ri, embedded_path[1:len(embedded_path) - 1] AS way FROM keyed
        WHERE parent_message_id IS NOT NULL AND len(embedded_path) > 0 AND embedded_path[-1] IS NOT DISTINCT FROM parent_attachment_index) c
  ASOF JOIN (SELECT *, coalesce(recovery_index, -1) AS ri, coalesce(embedded_path, []) AS way FROM keyed WHERE status <> 'pending') p
    ON p.store_id = c.store_id AND p.provenance = c.provenance AND p.ri = c.ri AND p.way = c.way AND p.seq < c.seq),
cand AS (SELECT keyed.*, par.parent_item_key FROM keyed LEFT JOIN par USING (store_id, seq))
"""


def unnumbered_events(spark: SparkSession, sf: str, cands: DataFrame) -> DataFrame:
    """Recipients and attachments as events of the last candidate with their message id."""
    owner = cands.where("source_node_id is not null").groupBy("store_id", F.col("source_node_id").alias("message_id")).agg(F.max_by("item_key", "seq").alias("item_key"))
    r = table(spark, sf, "recipients").dropDuplicates(["store_id", "seq"]).select("store_id", "seq", "message_id", F.lit("recipient").alias("kind"), F.to_json(F.struct("display_name")).alias("metadata_json"), F.lit(None).cast("string").alias("blob_sha256"), F.lit(None).cast("bigint").alias("byte_len"))
    a = table(spark, sf, "attachments").dropDuplicates(["store_id", "seq"]).select(
        "store_id", "seq", "message_id", F.when(F.col("data_size").isNull(), "attachment_missing").when(F.col("attachment_type").isin(2, 3, 4, 7), "attachment_reference").otherwise("attachment_data").alias("kind"),
        F.to_json(F.struct("filename")).alias("metadata_json"), F.when(F.col("data_size").isNotNull(), F.sha2("filename", 256)).alias("blob_sha256"), F.when(F.col("filename").isNotNull(), F.col("data_size")).alias("byte_len"),
    )
    # every seventh rejection is missing, and some items that are not rejected have one
    rejected = cands.where("(status = 'unsupported' and seq % 7 <> 0) or (status = 'spooled' and seq % 103 = 0)").select(
        "store_id", "seq", F.col("source_node_id").alias("message_id"), F.lit("output_unrepresentable").alias("kind"), F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lower("message_class").alias("category"))).alias("metadata_json"),
        F.lit(None).cast("string").alias("blob_sha256"), F.lit(None).cast("bigint").alias("byte_len"), "item_key",
    )
    return r.unionByName(a).join(owner, ["store_id", "message_id"]).unionByName(rejected)


def events(spark: SparkSession, sf: str, cands: DataFrame) -> DataFrame:
    """candidate_events: unnumbered_events numbered by seq."""
    return L.numbered_events(unnumbered_events(spark, sf, cands))


def event_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers and kinds of all events. Numbering reads its rows twice, so they are written first, without what numbers don't need."""
    e = unnumbered_events(spark, sf, keyed(spark, sf)).select("store_id", "item_key", "seq", "kind")
    return L.numbered_events(written(e)).select("store_id", "item_key", "sequence", "kind")


def blobs(spark: SparkSession, sf: str, cands: DataFrame) -> DataFrame:
    return L.with_pack_offsets(L.stored_blobs(unnumbered_events(spark, sf, cands).select("store_id", F.col("blob_sha256").alias("sha256"), "byte_len")))


_EVENTS = (
    _CANDIDATES
    + """, owner AS (SELECT store_id, source_node_id AS message_id, arg_max(item_key, seq) AS item_key FROM cand WHERE source_node_id IS NOT NULL GROUP BY ALL),
raw AS (
  SELECT DISTINCT store_id, seq, message_id, 'recipient' AS kind, CAST(NULL AS VARCHAR) AS blob_sha256, CAST(NULL AS BIGINT) AS byte_len FROM recipients
  UNION ALL SELECT DISTINCT store_id, seq, message_id, CASE WHEN data_size IS NULL THEN 'attachment_missing' WHEN attachment_type IN (2, 3, 4, 7) THEN 'attachment_reference' ELSE 'attachment_data' END,
    CASE WHEN data_size IS NOT NULL THEN sha256(filename) END, CASE WHEN filename IS NOT NULL THEN data_size END FROM attachments),
owned AS (SELECT store_id, seq, kind, blob_sha256, byte_len, item_key FROM raw JOIN owner USING (store_id, message_id)
  UNION ALL SELECT store_id, seq, 'output_unrepresentable', NULL, NULL, item_key FROM cand WHERE (status = 'unsupported' AND seq % 7 <> 0) OR (status = 'spooled' AND seq % 103 = 0)),
ev AS (SELECT *, row_number() OVER (PARTITION BY store_id, item_key ORDER BY seq) AS sequence FROM owned),
blob AS (SELECT store_id, blob_sha256 AS sha256, min(byte_len) AS byte_len, count(*) AS refs, min(byte_len) <> max(byte_len) AS conflicting FROM ev WHERE blob_sha256 IS NOT NULL GROUP BY 1, 2),
packed AS (SELECT *, coalesce(sum(byte_len) OVER (PARTITION BY store_id ORDER BY sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pack_offset FROM blob)
"""
)


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The ledger tables, with rows that break each of the integrity rules: pending items, events with half a payload or of no item,
    blobs that overlap, that nothing refers to or that are no blobs, items twice in a part, in none or in one without being written."""
    c = checkpointed(candidates(spark, sf))
    part = (F.floor(F.col("seq") / 50) + 1).cast("int").alias("part_index")
    stores = c.select("store_id").distinct()
    item = lambda where: c.where(where).select("store_id", part, "item_key")
    items = item("status = 'written' and seq % 5 <> 0").unionByName(item("status = 'written' and seq % 83 = 0")).unionByName(item("status = 'spooled' and seq % 89 = 0")).unionByName(stores.select("store_id", F.lit(1).alias("part_index"), F.lit("missing:item").alias("item_key")))
    parts = c.where("status = 'written'").select("store_id", part).distinct().withColumn("oversize", F.when(F.col("part_index") % 7 == 0, 1).otherwise(0))
    e = events(spark, sf, c).withColumn("byte_len", F.when(F.col("seq") % 101 != 5, F.col("byte_len"))).select("store_id", "item_key", "sequence", "kind", "blob_sha256", "byte_len")
    e = e.unionByName(stores.select("store_id", F.lit("missing:event").alias("item_key"), F.lit(1).alias("sequence"), F.lit("no_such_kind").alias("kind"), F.lit(None).cast("string").alias("blob_sha256"), F.lit(None).cast("bigint").alias("byte_len")))
    b = blobs(spark, sf, c).select("store_id", "sha256", "byte_len", F.when(F.col("sha256").startswith("8"), F.col("pack_offset") - 1).otherwise(F.col("pack_offset")).alias("pack_offset"), "storage_class")
    b = b.unionByName(stores.select("store_id", F.lit("no blob").alias("sha256"), F.lit(-5).cast("bigint").alias("byte_len"), F.lit(0).cast("bigint").alias("pack_offset"), F.lit("pack").alias("storage_class")))
    pending = c.withColumn("status", F.when(F.col("seq") % 97 == 0, "pending").otherwise(F.col("status")))
    return {"candidates": pending, "candidate_events": e, "blobs": b, "part_items": items, "parts": parts}


#: The tables above; the names say what they are made of.
_TABLES = (
    _EVENTS
    + """, stores AS (SELECT DISTINCT store_id FROM cand),
part_of AS (SELECT *, CAST(floor(seq / 50) + 1 AS INT) AS part_index FROM cand),
item AS (SELECT store_id, part_index, item_key FROM part_of WHERE status = 'written' AND seq % 5 <> 0
  UNION ALL SELECT store_id, part_index, item_key FROM part_of WHERE (status = 'written' AND seq % 83 = 0) OR (status = 'spooled' AND seq % 89 = 0)
  UNION ALL SELECT store_id, 1, 'missing:item' FROM stores),
part_ AS (SELECT DISTINCT store_id, part_index, CASE WHEN part_index % 7 = 0 THEN 1 ELSE 0 END AS oversize FROM part_of WHERE status = 'written'),
tc AS (SELECT * REPLACE (CASE WHEN seq % 97 = 0 THEN 'pending' ELSE status END AS status) FROM cand),
te AS (SELECT store_id, item_key, sequence, kind, blob_sha256, CASE WHEN seq % 101 <> 5 THEN byte_len END AS byte_len FROM ev
  UNION ALL SELECT store_id, 'missing:event', 1, 'no_such_kind', NULL, NULL FROM stores),
tb AS (SELECT store_id, sha256, byte_len, CASE WHEN starts_with(sha256, '8') THEN pack_offset - 1 ELSE pack_offset END AS pack_offset FROM packed
  UNION ALL SELECT store_id, 'no blob', -5, 0 FROM stores)
"""
)

_RULES_SQL = {
    "I01_pending": "SELECT store_id, item_key AS offender FROM tc WHERE status = 'pending'",
    "I02_blob_parity": "SELECT store_id, item_key || '#' || sequence AS offender FROM te WHERE (blob_sha256 IS NULL) <> (byte_len IS NULL)",
    "I03_event_length": "SELECT e.store_id, item_key || '#' || sequence AS offender FROM te e LEFT JOIN tb b ON b.store_id = e.store_id AND b.sha256 = e.blob_sha256 WHERE e.blob_sha256 IS NOT NULL AND e.byte_len IS DISTINCT FROM b.byte_len",
    "I04_unreferenced_blob": "SELECT store_id, sha256 AS offender FROM tb b WHERE NOT EXISTS (SELECT 1 FROM te e WHERE e.store_id = b.store_id AND e.blob_sha256 = b.sha256)",
    "I05_written_without_part": "SELECT store_id, item_key AS offender FROM tc c WHERE status = 'written' AND NOT EXISTS (SELECT 1 FROM item i WHERE i.store_id = c.store_id AND i.item_key = c.item_key)",
    "I06_part_item_not_written": "SELECT i.store_id, i.item_key AS offender FROM item i WHERE NOT EXISTS (SELECT 1 FROM tc c WHERE c.status = 'written' AND i.store_id = c.store_id AND i.item_key = c.item_key)",
    "I07_empty_part": "SELECT store_id, CAST(part_index AS VARCHAR) AS offender FROM part_ p WHERE NOT EXISTS (SELECT 1 FROM item i WHERE i.store_id = p.store_id AND i.part_index = p.part_index)",
    "I08_oversize_part": "SELECT store_id, CAST(part_index AS VARCHAR) AS offender FROM part_ p WHERE oversize = 1 AND 1 <> (SELECT count(*) FROM item i JOIN tc c USING (store_id, item_key) WHERE i.store_id = p.store_id AND i.part_index = p.part_index AND c.parent_item_key IS NULL)",
    "I09_pack_overlap": "SELECT store_id, sha256 AS offender FROM (SELECT *, max(pack_offset + byte_len) OVER (PARTITION BY store_id ORDER BY pack_offset, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM tb WHERE byte_len > 0) WHERE pack_offset < p",
    "I10_blob_identity": "SELECT store_id, sha256 AS offender FROM tb GROUP BY ALL HAVING count(*) > 1 OR coalesce(min(byte_len), -1) < 0 OR NOT regexp_matches(sha256, '^[0-9a-f]{64}$')",
    "I12_rejections": """SELECT store_id, item_key AS offender FROM tc c WHERE (SELECT count(*) FROM te e WHERE e.store_id = c.store_id AND e.item_key = c.item_key AND e.kind = 'output_unrepresentable') <> CASE WHEN status = 'unsupported' THEN 1 ELSE 0 END""",
    "I13_foreign_keys": """SELECT DISTINCT store_id, offender FROM (SELECT store_id, item_key AS offender FROM te UNION ALL SELECT store_id, item_key FROM item UNION ALL SELECT store_id, parent_item_key FROM tc WHERE parent_item_key IS NOT NULL) k
        WHERE NOT EXISTS (SELECT 1 FROM tc p WHERE p.store_id = k.store_id AND p.item_key = k.offender)""",
    "I16_ownership": """SELECT DISTINCT store_id, item_key AS offender FROM (SELECT *, count(*) OVER (PARTITION BY store_id, parent_item_key, parent_attachment_index) AS n FROM tc)
        WHERE (parent_item_key IS NULL) <> (parent_attachment_index IS NULL) OR (parent_item_key IS NULL) <> (embedded_path_json = '[]') OR (parent_item_key IS NOT NULL AND parent_attachment_index IS NOT NULL AND n > 1)""",
    "I17_duplicate_items": "SELECT store_id, item_key AS offender FROM item GROUP BY ALL HAVING count(*) > 1",
    "X_unknown_event_kinds": "SELECT store_id, item_key || '#' || sequence AS offender FROM te WHERE kind NOT IN ('recipient', 'attachment_data', 'attachment_missing', 'attachment_reference', 'output_unrepresentable')",
}


def _on(f):
    """A query over the candidates."""
    return lambda spark, sf: f(candidates(spark, sf))


def _on_rows(f):
    """A query over the candidates that needs neither keys nor parents."""
    return lambda spark, sf: f(candidate_rows(spark, sf))


def _rule(name: str):
    return lambda spark, sf: I.RULES[name](tables(spark, sf))


def _tree(c: DataFrame) -> DataFrame:
    return R.trees(checkpointed(c.select("store_id", "item_key", "parent_item_key", "status", "source_node_id")), ["spooled", "written", "unsupported"])


def _events(f, number: bool = True, of=candidates):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = of(spark, sf)
        return f(c, (events if number else unnumbered_events)(spark, sf, c))

    return run


def _blobs(spark: SparkSession, sf: str) -> DataFrame:
    return blobs(spark, sf, candidates(spark, sf))


def _event_join(c: DataFrame, e: DataFrame) -> DataFrame:
    return e.join(c.select("store_id", "item_key", "status", "completeness"), ["store_id", "item_key"]).groupBy("status", "kind").agg(F.count("*").alias("events"), F.coalesce(F.sum("byte_len"), F.lit(0)).alias("bytes"))


def _rejection_join(c: DataFrame, e: DataFrame) -> DataFrame:
    """Each event has a number, so counting the events counts their numbers."""
    rejected = e.where("kind = 'output_unrepresentable'").select("store_id", "item_key", "kind")
    return c.select("store_id", "item_key", "status").join(rejected, ["store_id", "item_key"], "left").groupBy("status").agg(F.count("*").alias("rows"), F.count("kind").alias("rejections"))


def packing_items(spark: SparkSession, sf: str) -> DataFrame:
    """Top-level candidates with folder path, location and payload, for packing."""
    f = table(spark, sf, "folders")
    now = C.latest(f.select("store_id", "seq", "source_id", "name", "address_json"), ["store_id", "source_id"])
    paths = now.select("store_id", F.col("source_id").alias("folder_id"), F.when(F.col("source_id") % 3 == 0, "store_root").otherwise("ipm_subtree").alias("location"), F.array(F.concat(F.lit("g"), (F.col("source_id") % 7).cast("string")), F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Recovered Folder "), F.col("source_id").cast("string")))).alias("folder_path"))
    c = candidates(spark, sf).where("parent_item_key is null and status in ('spooled', 'written')")
    return P.with_ranks(c.join(paths, ["store_id", "folder_id"], "left").select("store_id", "seq", "item_key", "provenance", "source_node_id", "recovery_index", "occurrence", F.coalesce("location", F.lit("store_root")).alias("location"), F.coalesce("folder_path", F.array(F.lit("Unfiled Mail"))).alias("folder_path"), F.when(F.col("associated"), "associated").otherwise("normal").alias("placement"), (F.pmod(F.col("seq") * 7919, F.lit(400_000)) + 1000).alias("payload_bytes")))


def packing(spark: SparkSession, sf: str) -> DataFrame:
    return P.pack(packing_items(spark, sf), PART_LIMIT).select("store_id", "item_key", F.col("pos").alias("position"), "part_index", "oversize")


def packing_parts(spark: SparkSession, sf: str) -> DataFrame:
    return P.parts_table(P.pack(packing_items(spark, sf), PART_LIMIT))


QUERIES = {
    "A01_job_summary": _on_rows(lambda c: L.job_summary(c)),
    "A01_job_summary_by_store": _on_rows(lambda c: L.job_summary(c, ["store_id"])),
    "A21_items_by_provenance": _on_rows(lambda c: c.groupBy("provenance").agg(F.count("*").alias("items"), F.countDistinct("store_id").alias("stores"))),
    "R04_R05_item_keys": _on(lambda c: c.select("store_id", "seq", "item_key", "occurrence")),
    "R06_parent_lookup": _on(lambda c: c.where("parent_item_key is not null").select("store_id", "item_key", "parent_item_key")),
    "R01_stranded_descendants": _on(lambda c: R.stranded(checkpointed(c.select("store_id", "item_key", "parent_item_key", "status")))),
    "R02_R03_candidate_trees": _on(lambda c: _tree(c)),
    "A13_tree_sizes": _on(lambda c: R.tree_sizes(_tree(c)).select("store_id", F.col("root").alias("item_key"), "mails", "depth")),
    "W02_first_wins_kept": _on_rows(lambda c: L.first_wins(c)[0].select("store_id", "seq")),
    "W02_first_wins_issues": _on_rows(lambda c: L.first_wins(c)[1].select("store_id", "seq", "source_node_id")),
    "W03_W04_event_sequence": event_sequence,
    "J01_events_with_candidates": _events(_event_join, number=False),
    "J02_J03_events_with_blobs": lambda spark, sf: (lambda t: t["candidate_events"].join(t["blobs"].select("store_id", F.col("sha256").alias("blob_sha256"), F.col("byte_len").alias("stored"), "storage_class"), ["store_id", "blob_sha256"], "left").groupBy("kind", "storage_class").agg(F.count("*").alias("events"), F.count_if(F.col("byte_len") == F.col("stored")).alias("equal_length")))(tables(spark, sf)),
    "J04_candidates_with_rejections": _events(_rejection_join, number=False, of=keyed),
    "J06_parts_with_items": lambda spark, sf: (lambda t: t["parts"].join(t["part_items"], ["store_id", "part_index"], "left_semi").select("store_id", "part_index"))(tables(spark, sf)),
    "J09_parent_child": _on(lambda c: c.join(c.select("store_id", F.col("item_key").alias("parent_item_key"), F.col("status").alias("parent_status")), ["store_id", "parent_item_key"]).groupBy("parent_status", "status").agg(F.count("*").alias("n"))),
    "J10_A03_part_item_counts": lambda spark, sf: (lambda t: t["parts"].join(t["part_items"], ["store_id", "part_index"], "left").groupBy("store_id", "part_index", "oversize").agg(F.count("item_key").alias("items")))(tables(spark, sf)),
    "J13_slot_conflicts": _on(lambda c: C.slot_conflicts(c)),
    "K05_blob_dedup": lambda spark, sf: _blobs(spark, sf).select("store_id", "sha256", "byte_len", "references", "conflicting"),
    "K06_storage_class": lambda spark, sf: _blobs(spark, sf).groupBy("storage_class").agg(F.count("*").alias("blobs"), F.sum("byte_len").alias("bytes")),
    "A02_A06_blob_totals": lambda spark, sf: L.blob_totals(_blobs(spark, sf)),
    "A05_next_sequence": _events(lambda c, e: e.groupBy("store_id", "item_key").agg((F.count("*") + 1).alias("next_sequence")), number=False),
    "A07_rejections_by_category": _events(lambda c, e: L.rejection_counts(c, e), number=False),
    "A12_capped_issues": _on_rows(lambda c: L.capped(L.first_wins(c)[1].select("store_id", "seq"), ["store_id", "seq"])[1]),
    "L01_keyset_page": _on(lambda c: L.keyset_page(c.select("store_id", "seq", "item_key"), (1, 1000))),
    "L03_latest_candidate": _on(lambda c: c.where("source_node_id is not null").groupBy("store_id", "source_node_id").agg(F.max_by("item_key", "seq").alias("item_key"))),
    "O01_canonical_order": lambda spark, sf: P.positioned(packing_items(spark, sf), "store_id", P.ORDERS["canonical"], {}).select("store_id", "item_key", "pos"),
    "O02_text_order": _on(lambda c: P.positioned(c, "store_id", ["provenance", "source_node_id", "recovery_index", "occurrence"], {}).select("store_id", "item_key", (F.col("pos") + 1).alias("n"))),
    "O06_embedded_order": _on(lambda c: C.ranked(c.where("parent_item_key is not null"), ["store_id", "parent_item_key"], [F.col("embedded_path_json"), F.col("item_key")]).select("store_id", "item_key", "n")),
    "U04_multiset_difference": lambda spark, sf: L.multiset_difference(*(messages(spark, sf).where(w).select(F.coalesce("sender_email", F.lit("-")).alias("sender_email")) for w in ("seq % 2 = 0", "seq % 2 = 1")), ["sender_email"]),
    "G01_packing": packing,
    "G01_A18_part_estimates": packing_parts,
    **{n: _rule(n) for n in _RULES_SQL},
    "I_all_rules": lambda spark, sf: I.report({k: checkpointed(t) for k, t in tables(spark, sf).items()}),
}

_TREES = """, kept AS (SELECT store_id, item_key, parent_item_key FROM cand WHERE status IN ('spooled', 'written', 'unsupported')),
tree AS (
  SELECT store_id, item_key AS root, item_key, 0 AS depth FROM kept WHERE parent_item_key IS NULL
  UNION ALL SELECT k.store_id, t.root, k.item_key, t.depth + 1 FROM tree t JOIN kept k ON k.store_id = t.store_id AND k.parent_item_key = t.item_key)
"""
_FIRST = """, ranked AS (SELECT *, coalesce(source_node_id = 0, true) OR embedded_depth > 0 AS free,
  row_number() OVER (PARTITION BY store_id, source_node_id, coalesce(source_node_id = 0, true) OR embedded_depth > 0 ORDER BY CASE provenance WHEN 'normal' THEN 1 WHEN 'recovered' THEN 2 WHEN 'orphan' THEN 3 WHEN 'fragment' THEN 4 ELSE 5 END, seq) AS n FROM cand)
"""
_PACK_ITEMS = (
    _CANDIDATES
    + """, fnow AS (SELECT store_id, source_id, arg_max(struct_pack(name := name), seq).name AS name FROM folders GROUP BY 1, 2),
fpath AS (SELECT store_id, source_id AS folder_id, CASE WHEN source_id % 3 = 0 THEN 'store_root' ELSE 'ipm_subtree' END AS location, ['g' || (source_id % 7), coalesce(nullif(name, ''), 'Recovered Folder ' || source_id)] AS folder_path FROM fnow),
pitem AS (SELECT c.store_id, c.item_key, coalesce(location, 'store_root') AS location, coalesce(folder_path, ['Unfiled Mail']) AS folder_path, provenance, source_node_id, recovery_index, occurrence
  FROM cand c LEFT JOIN fpath USING (store_id, folder_id) WHERE parent_item_key IS NULL AND status IN ('spooled', 'written'))
"""
)

SQL = {
    "A01_job_summary": _CANDIDATES + "SELECT count(*) AS total, count(*) FILTER (status = 'spooled') AS spooled, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (completeness = 'partial') AS partial, count(*) FILTER (completeness = 'damaged') AS damaged, count(*) FILTER (provenance <> 'normal') AS recovered_items FROM cand",
    "A01_job_summary_by_store": _CANDIDATES + "SELECT store_id, count(*) AS total, count(*) FILTER (status = 'spooled') AS spooled, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (completeness = 'partial') AS partial, count(*) FILTER (completeness = 'damaged') AS damaged, count(*) FILTER (provenance <> 'normal') AS recovered_items FROM cand GROUP BY 1",
    "A21_items_by_provenance": _CANDIDATES + "SELECT provenance, count(*) AS items, count(DISTINCT store_id) AS stores FROM cand GROUP BY 1",
    "R04_R05_item_keys": _CANDIDATES + "SELECT store_id, seq, item_key, occurrence FROM cand",
    "R06_parent_lookup": _CANDIDATES + "SELECT store_id, item_key, parent_item_key FROM cand WHERE parent_item_key IS NOT NULL",
    "R01_stranded_descendants": _CANDIDATES
    + """, st AS (SELECT c.store_id, c.item_key, 0 AS depth FROM cand c JOIN cand p ON p.store_id = c.store_id AND p.item_key = c.parent_item_key WHERE c.status = 'spooled' AND p.status IN ('written', 'unsupported')
         UNION SELECT c.store_id, c.item_key, st.depth + 1 FROM st JOIN cand c ON c.store_id = st.store_id AND c.parent_item_key = st.item_key WHERE c.status = 'spooled')
         SELECT store_id, item_key, min(depth) AS depth FROM st GROUP BY 1, 2""",
    "R02_R03_candidate_trees": _CANDIDATES + _TREES + "SELECT root, store_id, item_key, depth FROM tree",
    "A13_tree_sizes": _CANDIDATES + _TREES + "SELECT store_id, root AS item_key, count(*) AS mails, max(depth) AS depth FROM tree GROUP BY 1, 2",
    "W02_first_wins_kept": _CANDIDATES + _FIRST + "SELECT store_id, seq FROM ranked WHERE free OR n = 1",
    "W02_first_wins_issues": _CANDIDATES + _FIRST + "SELECT store_id, seq, source_node_id FROM ranked WHERE NOT free AND n > 1",
    "W03_W04_event_sequence": _EVENTS + "SELECT store_id, item_key, sequence, kind FROM ev",
    "J01_events_with_candidates": _EVENTS + "SELECT status, kind, count(*) AS events, coalesce(sum(byte_len), 0) AS bytes FROM ev JOIN cand USING (store_id, item_key) GROUP BY 1, 2",
    "J02_J03_events_with_blobs": _TABLES + "SELECT kind, CASE WHEN b.byte_len <= 65536 THEN 'inline' WHEN b.sha256 IS NOT NULL THEN 'pack' END AS storage_class, count(*) AS events, count(*) FILTER (te.byte_len = b.byte_len) AS equal_length FROM te LEFT JOIN tb b ON b.store_id = te.store_id AND b.sha256 = te.blob_sha256 GROUP BY 1, 2",
    "J04_candidates_with_rejections": _EVENTS + "SELECT status, count(*) AS rows, count(sequence) AS rejections FROM cand LEFT JOIN (SELECT store_id, item_key, sequence FROM ev WHERE kind = 'output_unrepresentable') USING (store_id, item_key) GROUP BY 1",
    "J06_parts_with_items": _TABLES + "SELECT store_id, part_index FROM part_ SEMI JOIN item USING (store_id, part_index)",
    "J09_parent_child": _CANDIDATES + "SELECT p.status AS parent_status, c.status, count(*) AS n FROM cand c JOIN cand p ON p.store_id = c.store_id AND p.item_key = c.parent_item_key GROUP BY 1, 2",
    "J10_A03_part_item_counts": _TABLES + "SELECT store_id, part_index, oversize, count(item_key) AS items FROM part_ LEFT JOIN item USING (store_id, part_index) GROUP BY 1, 2, 3",
    "J13_slot_conflicts": _CANDIDATES + "SELECT store_id, parent_item_key, parent_attachment_index, count(*) AS children FROM cand WHERE parent_item_key IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "K05_blob_dedup": _EVENTS + 'SELECT store_id, sha256, byte_len, refs AS "references", conflicting FROM packed',
    "K06_storage_class": _EVENTS + "SELECT CASE WHEN byte_len <= 65536 THEN 'inline' ELSE 'pack' END AS storage_class, count(*) AS blobs, sum(byte_len) AS bytes FROM packed GROUP BY 1",
    "A02_A06_blob_totals": _EVENTS + "SELECT count(*) AS blobs, coalesce(sum(byte_len), 0) AS bytes, coalesce(max(pack_offset + byte_len), 0) AS pack_end FROM packed",
    "A05_next_sequence": _EVENTS + "SELECT store_id, item_key, max(sequence) + 1 AS next_sequence FROM ev GROUP BY 1, 2",
    "A07_rejections_by_category": _EVENTS + """SELECT CASE WHEN status <> 'unsupported' THEN 'not rejected' WHEN n IS NULL THEN 'no event' WHEN n > 1 THEN 'several events' ELSE 'counted' END AS rule, CASE WHEN status = 'unsupported' AND n = 1 THEN coalesce(lower(message_class), '-') ELSE '-' END AS category, count(*) AS n
        FROM cand LEFT JOIN (SELECT store_id, item_key, count(*) AS n FROM ev WHERE kind = 'output_unrepresentable' GROUP BY 1, 2) USING (store_id, item_key) WHERE status = 'unsupported' OR n IS NOT NULL GROUP BY 1, 2""",
    "A12_capped_issues": _CANDIDATES + _FIRST + "SELECT greatest(count(*) - 10000, 0) AS dropped FROM ranked WHERE NOT free AND n > 1",
    "L01_keyset_page": _CANDIDATES + "SELECT store_id, seq, item_key FROM cand WHERE store_id > 1 OR (store_id = 1 AND seq > 1000) ORDER BY store_id, seq LIMIT 1024",
    "L03_latest_candidate": _CANDIDATES + "SELECT store_id, source_node_id, arg_max(item_key, seq) AS item_key FROM cand WHERE source_node_id IS NOT NULL GROUP BY 1, 2",
    "O01_canonical_order": _PACK_ITEMS + """SELECT store_id, item_key, row_number() OVER (PARTITION BY store_id ORDER BY CASE location WHEN 'store_root' THEN 1 ELSE 2 END, folder_path,
        CASE provenance WHEN 'normal' THEN 1 WHEN 'recovered' THEN 2 WHEN 'orphan' THEN 3 WHEN 'fragment' THEN 4 ELSE 5 END, source_node_id NULLS FIRST, recovery_index NULLS FIRST, occurrence) - 1 AS pos FROM pitem""",
    "O02_text_order": _CANDIDATES + "SELECT store_id, item_key, row_number() OVER (PARTITION BY store_id ORDER BY provenance NULLS FIRST, source_node_id NULLS FIRST, recovery_index NULLS FIRST, occurrence) AS n FROM cand",
    "O06_embedded_order": _CANDIDATES + "SELECT store_id, item_key, row_number() OVER (PARTITION BY store_id, parent_item_key ORDER BY embedded_path_json, item_key) AS n FROM cand WHERE parent_item_key IS NOT NULL",
    "U04_multiset_difference": """WITH d AS (SELECT coalesce(sender_email, '-') AS sender_email, sum(CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END) AS d FROM (SELECT DISTINCT store_id, seq, sender_email FROM messages) GROUP BY 1)
        SELECT sender_email, greatest(d, 0) AS missing, greatest(-d, 0) AS surplus FROM d WHERE d <> 0""",
    **{n: _TABLES + q for n, q in _RULES_SQL.items()},
    "I_all_rules": _TABLES + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS offenders FROM ({q})" for n, q in _RULES_SQL.items()),
}
