"""Queries of folder paths, ownership, class predicates and metadata repair over the mailbox tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.operators import canonical as C, ledger as L
from postlode.plans import ledger as B
from postlode.session import table


def folders(spark: SparkSession, sf: str) -> DataFrame:
    """The newest row of each folder with its parsed address."""
    f = table(spark, sf, "folders").select("store_id", "seq", "folder_key", "source_id", "parent_source_id", "name", "address_json")
    return C.latest(f, ["store_id", "source_id"]).withColumn("address", C.parsed_address())


_FOLDERS = """
WITH RECURSIVE lf AS (SELECT store_id, source_id, arg_max(struct_pack(folder_key := folder_key, parent := parent_source_id, name := name, a := address_json), seq) AS v FROM folders GROUP BY 1, 2),
f AS (SELECT store_id, source_id, v.folder_key AS folder_key, v.parent AS parent_source_id, v.name AS name, v.a AS address_json,
  CASE WHEN regexp_full_match(v.a, '\\s*\\[[\\s\\d,]*\\]\\s*') AND json_valid(v.a) THEN CAST(CAST(v.a AS JSON) AS INT[]) END AS address FROM lf),
ipm AS (SELECT DISTINCT store_id, address FROM f WHERE source_id = 32802 AND len(address) = 1),
byaddr AS (SELECT store_id, address, coalesce(nullif(name, ''), 'Recovered Folder ' || source_id) AS part FROM f WHERE address IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY store_id, address ORDER BY coalesce(folder_key, '') DESC, source_id DESC) = 1),
climb AS (
  SELECT store_id, address, address AS here, CAST([] AS VARCHAR[]) AS path, false AS missing FROM (SELECT DISTINCT store_id, address FROM f WHERE address IS NOT NULL) x
  WHERE NOT EXISTS (SELECT 1 FROM ipm WHERE ipm.store_id = x.store_id AND ipm.address = x.address)
  UNION ALL
  SELECT c.store_id, c.address, c.here[1:len(c.here) - 1], list_prepend(b.part, c.path), b.part IS NULL
  FROM climb c LEFT JOIN byaddr b ON b.store_id = c.store_id AND b.address = c.here
  WHERE len(c.here) > 0 AND NOT c.missing AND NOT EXISTS (SELECT 1 FROM ipm WHERE ipm.store_id = c.store_id AND ipm.address = c.here)),
fp AS (
  SELECT store_id, address, CASE WHEN len(here) = 0 THEN 'store_root' ELSE 'ipm_subtree' END AS location, CASE WHEN NOT missing AND len(path) <= 64 THEN path END AS folder_path,
    CASE WHEN missing OR len(path) > 64 THEN 'invalid folder hierarchy' END AS error
  FROM climb c WHERE len(address) > 0 AND (missing OR len(here) = 0 OR EXISTS (SELECT 1 FROM ipm WHERE ipm.store_id = c.store_id AND ipm.address = c.here))),
del AS (SELECT store_id, min(address) AS address FROM f WHERE source_id = 32866 AND EXISTS (SELECT 1 FROM ipm WHERE ipm.store_id = f.store_id AND ipm.address = f.address[1:len(f.address) - 1]) GROUP BY 1)
"""


def address_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = C.paths_by_address(folders(spark, sf)).withColumn("location", F.when(F.col("error").isNull(), F.col("location")))
    return paths.withColumns({"address": F.to_json("address"), "folder_path": F.array_join("folder_path", "/")})


def folder_set(spark: SparkSession, sf: str) -> DataFrame:
    return C.folder_set(folders(spark, sf)).withColumn("folder_path", F.array_join("folder_path", "/"))


def deleted_items(spark: SparkSession, sf: str) -> DataFrame:
    return C.deleted_items(folders(spark, sf)).withColumn("address", F.to_json("address"))


def visible(spark: SparkSession, sf: str) -> DataFrame:
    f = folders(spark, sf)
    return f.where(C.visible_folder(F.col("address"), F.col("source_id"))).select("store_id", "source_id")


def unambiguous(spark: SparkSession, sf: str) -> DataFrame:
    f = folders(spark, sf).where("address is not null").withColumn("address_text", F.to_json("address"))
    return C.unambiguous(f, "address_text").select("store_id", "source_id")


def parent_paths(spark: SparkSession, sf: str) -> DataFrame:
    return C.paths_by_parent(_unique(spark, sf)).withColumn("folder_path", F.to_json("folder_path"))


def _unique(spark: SparkSession, sf: str) -> DataFrame:
    return folders(spark, sf).select("store_id", "source_id", "parent_source_id", "name", "address")


def filed(spark: SparkSession, sf: str) -> DataFrame:
    m = B.messages(spark, sf).where("parent_message_id is null").select("store_id", "seq", "folder_id", "provenance")
    return C.filed(m, C.paths_by_parent(_unique(spark, sf))).withColumn("folder_path", F.to_json("folder_path"))


def classes(spark: SparkSession, sf: str) -> DataFrame:
    m = B.messages(spark, sf).select("message_class").distinct()
    return m.select(F.coalesce("message_class", F.lit("-")).alias("cls"), *(c.alias(n) for n, c in C.class_flags(F.coalesce("message_class", F.lit(""))).items()), C.default_container_class(F.coalesce("message_class", F.lit(""))).alias("container_class"))


def repaired(spark: SparkSession, sf: str) -> DataFrame:
    r = C.repaired_messages(B.messages(spark, sf))
    return r.withColumns({"derived": F.array_join("derived", ","), "generated": F.array_join("generated", ",")})


def reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    return C.reconstruction_counts(C.repaired_messages(B.messages(spark, sf)))


def recipients(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "recipients").dropDuplicates(["store_id", "seq"])


def filetimes(spark: SparkSession, sf: str) -> DataFrame:
    ticks, bad = C.contained_filetime("submit_filetime")
    return B.messages(spark, sf).select("store_id", "seq", ticks.alias("ticks"), bad.alias("invalid"), F.date_format(C.filetime_to_timestamp(ticks), "yyyy-MM-dd HH:mm:ss").alias("at"))


def ownership(spark: SparkSession, sf: str) -> DataFrame:
    return C.ownership_errors(B.candidates(spark, sf))


def prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Per store and location the folder prefixes of its mail, and mails below each."""
    items = B.packing_items(spark, sf)
    return items.select("store_id", "location", F.explode(L.folder_prefixes("folder_path")).alias("p")).groupBy("store_id", "location", F.array_join("p", "/").alias("prefix")).agg(F.count("*").alias("mails"))


#: Follows _FOLDERS: every folder's walk up its parents, step by step.
_UP = """, walk AS (
  SELECT store_id, source_id, source_id AS id, CAST([] AS VARCHAR[]) AS path, CAST([] AS BIGINT[]) AS seen, false AS ended, false AS bad FROM f
  UNION ALL
  SELECT w.store_id, w.source_id, g.parent_source_id,
    CASE WHEN g.source_id IS NULL THEN list_prepend('Recovered Folder ' || w.id, w.path)
         WHEN g.address IS NULL OR (len(g.address) > 0 AND NOT (g.source_id = 32802 AND len(g.address) = 1)) THEN list_prepend(coalesce(nullif(g.name, ''), 'Recovered Folder ' || w.id), w.path) ELSE w.path END,
    list_append(w.seen, w.id), g.source_id IS NULL OR g.parent_source_id IS NULL, list_contains(w.seen, w.id)
  FROM walk w LEFT JOIN f g ON g.store_id = w.store_id AND g.source_id = w.id WHERE NOT w.ended AND NOT w.bad),
bypar AS (SELECT store_id, source_id, CASE WHEN NOT bad AND len(path) <= 64 THEN path END AS folder_path, CASE WHEN bad OR len(path) > 64 THEN 'invalid folder hierarchy' END AS error FROM walk WHERE ended OR bad)
"""
_MSG = "WITH m AS (SELECT DISTINCT ON (store_id, seq) * FROM messages),"
_D = lambda root: f"(lower(c) LIKE lower('{root}') || '.%' AND length(c) > {len(root) + 1})"
_ID = lambda root: f"(lower(c) = lower('{root}') OR {_D(root)})"
_OPTIONAL = f"(NOT ({_ID('IPM.Note')} OR {_D('REPORT.IPM.Note')} OR {_D('IPM.Schedule.Meeting')}) OR {_ID('IPM.Contact')} OR {_ID('IPM.Appointment')} OR {_ID('IPM.Task')} OR {_ID('IPM.StickyNote')})"
_CONTAINER = f"CASE WHEN {_ID('IPM.Contact')} OR {_ID('IPM.DistList')} THEN 'IPF.Contact' WHEN {_ID('IPM.Appointment')} THEN 'IPF.Appointment' WHEN {_ID('IPM.Task')} THEN 'IPF.Task' WHEN {_ID('IPM.StickyNote')} THEN 'IPF.StickyNote' ELSE 'IPF.Note' END"
_REPAIR = f"""{_MSG} x AS (
  SELECT store_id, seq, coalesce(nullif(message_class, ''), 'IPM.Note') AS c, nullif(message_class, '') IS NULL AS no_class, subject, nullif(sender_name, '') AS n, nullif(sender_email, '') AS e,
    submit_filetime AS s, delivery_filetime AS d, coalesce(submit_filetime < 0, false) AS sbad, coalesce(delivery_filetime < 0, false) AS dbad FROM m),
r AS (
  SELECT store_id, seq, c AS message_class, coalesce(subject, '') AS subject, coalesce(n, e, '') AS sender_name, coalesce(e, n, '') AS sender_email,
    CASE WHEN sbad OR s IS NULL THEN 0 ELSE s END AS submit_ticks, CASE WHEN dbad OR d IS NULL THEN 0 ELSE d END AS delivery_ticks, sbad::INT + dbad::INT AS omitted_properties,
    list_filter(['creation_time', 'modification_time', 'sender_address', 'sender_name'], lambda v: CASE v WHEN 'sender_address' THEN n IS NOT NULL AND e IS NULL WHEN 'sender_name' THEN n IS NULL AND e IS NOT NULL ELSE d IS NOT NULL AND NOT dbad END) AS derived,
    list_filter(['creation_time', 'delivery_time', 'message_class', 'modification_time', 'sender_address', 'sender_name', 'subject', 'submit_time'], lambda v: CASE v
      WHEN 'message_class' THEN no_class WHEN 'subject' THEN subject IS NULL WHEN 'submit_time' THEN s IS NULL OR sbad WHEN 'delivery_time' THEN d IS NULL OR dbad
      WHEN 'sender_name' THEN n IS NULL AND e IS NULL AND NOT {_OPTIONAL} WHEN 'sender_address' THEN n IS NULL AND e IS NULL AND NOT {_OPTIONAL} ELSE d IS NULL OR dbad END) AS generated,
    {_CONTAINER} AS container_class FROM x)
"""
_MIMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.EXTENSIONS.items())

QUERIES = {
    "R07_folder_path_by_address": address_paths,
    "R08_folder_path_by_parent": parent_paths,
    "R08_F38_message_folders": filed,
    "A25_deleted_items_address": deleted_items,
    "X04_folder_set": folder_set,
    "P12_visible_folders": visible,
    "P13_store_root_folders": lambda spark, sf: folders(spark, sf).where("source_id & 31 = 2 and source_id <> 32834").select("store_id", "source_id"),
    "J11_unambiguous_folders": unambiguous,
    "J14_A19_folder_prefixes": prefixes,
    "P09_P10_P11_F24_class_predicates": classes,
    "X06_X08_X09_message_repair": repaired,
    "A08_reconstruction_counts": reconstruction,
    "X07_recipient_repair": lambda spark, sf: C.repaired_recipients(recipients(spark, sf)),
    "X07_partial_by_recipients": lambda spark, sf: C.partial_by_recipients(recipients(spark, sf)),
    "F11_F12_filetimes": filetimes,
    "X05_X12_F21_F22_attachments": lambda spark, sf: C.named_attachments(table(spark, sf, "attachments").dropDuplicates(["store_id", "seq"])),
    "X02_I16_ownership_errors": ownership,
}
SQL = {
    "R07_folder_path_by_address": _FOLDERS + "SELECT store_id, CAST(to_json(address) AS VARCHAR) AS address, CASE WHEN error IS NULL THEN location END AS location, array_to_string(folder_path, '/') AS folder_path, error FROM fp",
    "A25_deleted_items_address": _FOLDERS + "SELECT store_id, CAST(to_json(address) AS VARCHAR) AS address FROM del",
    "X04_folder_set": _FOLDERS
    + """, loc AS (SELECT f.store_id, f.source_id, coalesce(f.folder_key, '') AS k, fp.location, fp.folder_path, del.address IS NOT NULL AS d
        FROM f JOIN fp ON fp.store_id = f.store_id AND fp.address = f.address AND fp.error IS NULL LEFT JOIN del ON del.store_id = f.store_id AND del.address = f.address
        WHERE fp.location <> 'store_root' OR (source_id & 31 = 2 AND source_id <> 32834)),
      won AS (SELECT *, count(*) OVER (PARTITION BY store_id, location, folder_path) - 1 AS omitted,
        row_number() OVER (PARTITION BY store_id, location, folder_path ORDER BY k, source_id) AS up, row_number() OVER (PARTITION BY store_id, location, folder_path ORDER BY NOT d, k DESC, source_id DESC) AS down, bool_or(d) OVER (PARTITION BY store_id, location, folder_path) AS any_d FROM loc)
      SELECT store_id, location, array_to_string(folder_path, '/') AS folder_path, source_id, CASE WHEN any_d THEN 'deleted_items' ELSE 'ordinary' END AS role, omitted FROM won WHERE CASE WHEN any_d THEN down = 1 ELSE up = 1 END""",
    "P12_visible_folders": _FOLDERS + "SELECT store_id, source_id FROM f WHERE len(address) > 0 AND NOT (source_id = 32802 AND len(address) = 1)",
    "P13_store_root_folders": _FOLDERS + "SELECT store_id, source_id FROM f WHERE source_id & 31 = 2 AND source_id <> 32834",
    "J11_unambiguous_folders": _FOLDERS + "SELECT store_id, source_id FROM (SELECT *, count(*) OVER (PARTITION BY store_id, address) AS n FROM f WHERE address IS NOT NULL) WHERE n = 1",
    "J14_A19_folder_prefixes": B._PACK_ITEMS + """, px AS (SELECT store_id, location, array_to_string(folder_path[1:k], '/') AS prefix FROM (SELECT *, unnest(range(1, len(folder_path) + 1)) AS k FROM pitem))
      SELECT store_id, location, prefix, count(*) AS mails FROM px GROUP BY 1, 2, 3""",
    "P09_P10_P11_F24_class_predicates": f"""SELECT coalesce(mc, '-') AS cls, {_ID("IPM.Contact")} AS is_contact, {_ID("IPM.DistList")} AS is_distribution_list, {_D("IPM.Document")} AS is_document, {_ID("IPM.Appointment")} AS is_appointment,
      {_D("IPM.Schedule.Meeting")} AS is_meeting, {_ID("IPM.Task")} AS is_task, {_ID("IPM.StickyNote")} AS is_note_item, lower(c) = 'ipm.ole.class.{{00061055-0000-0000-c000-000000000046}}' AS is_calendar_exception, {_OPTIONAL} AS sender_optional, {_CONTAINER} AS container_class
      FROM (SELECT DISTINCT message_class AS mc, coalesce(message_class, '') AS c FROM messages)""",
    "X06_X08_X09_message_repair": _REPAIR + "SELECT * REPLACE (array_to_string(derived, ',') AS derived, array_to_string(generated, ',') AS generated) FROM r",
    "A08_reconstruction_counts": _REPAIR + "SELECT field, kind, count(*) AS n FROM (SELECT unnest(derived) AS field, 'derived' AS kind FROM r UNION ALL SELECT unnest(generated), 'generated' FROM r) GROUP BY 1, 2",
    "X07_recipient_repair": """SELECT * FROM (SELECT DISTINCT ON (store_id, seq) store_id, seq, message_id, CASE recipient_type WHEN 1 THEN 'to' WHEN 2 THEN 'cc' WHEN 3 THEN 'bcc' END AS kind, coalesce(display_name, email_address) AS display_name,
      coalesce(email_address, display_name) AS email_address, CASE WHEN coalesce(display_name, '') = '' AND coalesce(email_address, '') <> '' THEN 'recipient_display_name' WHEN coalesce(display_name, '') <> '' AND coalesce(email_address, '') = '' THEN 'recipient_address' END AS derived
      FROM recipients) WHERE kind IS NOT NULL AND display_name IS NOT NULL""",
    "X07_partial_by_recipients": """SELECT store_id, message_id, count(*) AS recipients, count(*) FILTER (k) AS kept, count(*) FILTER (NOT coalesce(k, false) OR upper(address_type) <> 'SMTP') > 0 AS partial
      FROM (SELECT DISTINCT ON (store_id, seq) *, recipient_type BETWEEN 1 AND 3 AND coalesce(display_name, email_address) IS NOT NULL AS k FROM recipients) GROUP BY 1, 2""",
    "F11_F12_filetimes": f"""{_MSG} t AS (SELECT store_id, seq, CASE WHEN submit_filetime < 0 OR submit_filetime IS NULL THEN 0 ELSE submit_filetime END AS ticks, coalesce(submit_filetime < 0, false) AS invalid FROM m)
      SELECT *, strftime(make_timestamp(CAST(floor((ticks - 116444736000000000) / 10) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS at FROM t""",
    "X05_X12_F21_F22_attachments": f"""SELECT store_id, seq, message_id, attachment_index, mime,
      coalesce(nullif(filename, ''), CASE WHEN attachment_type = 5 THEN 'Embedded message ' || coalesce(attachment_index::VARCHAR, 'null') || '.msg' WHEN attachment_type IN (2, 3, 4, 7) THEN 'Referenced attachment ' || coalesce(attachment_index::VARCHAR, 'null')
        ELSE 'Recovered attachment ' || attachment_index || '.' || coalesce(CASE lower(trim(split_part(mime, ';', 1))) {_MIMES} END, 'bin') END) AS filename,
      coalesce(CASE WHEN contains(filename, '.') THEN string_split(filename, '.')[-1] END, '') AS extension,
      CASE WHEN attachment_type = 5 THEN 'embedded' WHEN attachment_type IN (2, 3, 4, 7) THEN 'attachment_reference' WHEN data_size IS NULL THEN 'attachment_missing' WHEN data_size = 0 THEN 'attachment_empty' ELSE 'attachment_data' END AS terminal
      FROM (SELECT DISTINCT ON (store_id, seq) *, coalesce(nullif(detected_mime, ''), CASE WHEN attachment_type = 5 THEN 'message/rfc822' END) AS mime FROM attachments)""",
    "X02_I16_ownership_errors": B._CANDIDATES
    + """, o AS (SELECT c.store_id, c.item_key, CASE WHEN len(c.embedded_path) > 256 THEN 'too deep' WHEN c.parent_item_key IS NULL AND len(c.embedded_path) > 0 THEN 'path without parent'
        WHEN c.parent_item_key IS NOT NULL AND c.embedded_path IS DISTINCT FROM list_append(coalesce(p.embedded_path, []), c.parent_attachment_index) THEN 'path differs from parent''s' END AS rule
        FROM cand c LEFT JOIN cand p ON p.store_id = c.store_id AND p.item_key = c.parent_item_key)
      SELECT * FROM o WHERE rule IS NOT NULL""",
    "R08_folder_path_by_parent": _FOLDERS + _UP + "SELECT store_id, source_id, CAST(to_json(folder_path) AS VARCHAR) AS folder_path, error FROM bypar",
    "R08_F38_message_folders": _FOLDERS + _UP + """SELECT m.store_id, m.seq, CAST(to_json(CASE WHEN m.folder_id IS NULL OR len(b.folder_path) = 0 THEN [CASE provenance WHEN 'normal' THEN 'Unfiled Mail' WHEN 'recovered' THEN 'Recovered Mail' WHEN 'orphan' THEN 'Orphan Mail' WHEN 'fragment' THEN 'Fragment Mail' END]
        WHEN b.source_id IS NULL THEN ['Recovered Folder ' || m.folder_id] ELSE b.folder_path END) AS VARCHAR) AS folder_path, b.error
        FROM (SELECT DISTINCT ON (store_id, seq) * FROM messages) m LEFT JOIN bypar b ON b.store_id = m.store_id AND b.source_id = m.folder_id WHERE m.parent_message_id IS NULL""",
}
