"""Folder paths, the visible folder set, ownership and the repair of message metadata, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postlode.operators.ledger import class_flags
from postlode.schema import DELETED_ITEMS, IPM_SUBTREE, SEARCH_ROOT

_MAX_I64 = (1 << 63) - 1


# --- folders --------------------------------------------------------------------------------------------------------------


#: Most levels of a folder path; a deeper one is an error, not a shorter path.
MOST_LEVELS = 64
#: The folder of messages that name none, by provenance.
UNFILED = {"normal": "Unfiled Mail", "recovered": "Recovered Mail", "orphan": "Orphan Mail", "fragment": "Fragment Mail"}
_INVALID = "invalid folder hierarchy"


def parsed_address(json: str = "address_json") -> Column:
    """The address array of its JSON text, of any length; null for anything but a list of integers."""
    return F.when(F.col(json).rlike(r"^\s*\[[\s\d,]*\]\s*$"), F.from_json(json, "array<int>"))


def visible_folder(address: Column, node: Column) -> Column:
    """Not the root, nor the IPM subtree directly below it."""
    return (F.size(address) > 0) & ~((node == IPM_SUBTREE) & (F.size(address) == 1))


def _named(name: Column, node: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Recovered Folder "), node.cast("string")))


def paths_by_address(folders: DataFrame) -> DataFrame:
    """(store_id, address, location, folder_path, error) of the addresses of folders, but for the IPM subtrees' own.

    The path holds the names of the folders at the prefixes of the address, from below the IPM subtree, or from below the root where
    it is in none; of several folders at an address the last by folder_key names it. An address with a prefix at which no folder is,
    or of more than MOST_LEVELS levels, has an error and no path. Prefixes are exploded and joined by equality, so nothing recurses.
    """
    a = folders.where("address is not null")
    names = a.groupBy("store_id", F.col("address").alias("prefix")).agg(F.max_by(F.struct("source_id", "name"), F.struct(F.coalesce("folder_key", F.lit("")), "source_id")).alias("n")).select("store_id", "prefix", _named(F.col("n.name"), F.col("n.source_id")).alias("part"))
    ipm = _ipm(a)
    from_level = F.when(F.col("ipm").isNotNull(), 2).otherwise(1)
    placed = a.select("store_id", "address", F.get("address", F.lit(0)).alias("top")).distinct().join(ipm, ["store_id", "top"], "left").where("size(address) > 0 and not (ipm is not null and size(address) = 1)")
    steps = placed.withColumn("prefix", F.explode(F.transform(F.sequence(from_level, F.size("address")), lambda i: F.slice("address", 1, i))))
    found = steps.join(names, ["store_id", "prefix"], "left").groupBy("store_id", "address", "ipm").agg(F.array_sort(F.collect_list(F.struct(F.size("prefix").alias("k"), "part"))).alias("parts"), F.count_if(F.col("part").isNull()).alias("missing"))
    error = F.when((F.col("missing") > 0) | (F.size("parts") > MOST_LEVELS), _INVALID)
    return found.select("store_id", "address", F.when(F.col("ipm").isNull(), "store_root").otherwise("ipm_subtree").alias("location"), F.when(error.isNull(), F.transform("parts", lambda p: p["part"])).alias("folder_path"), error.alias("error"))


def _ipm(folders: DataFrame) -> DataFrame:
    """(store_id, top, ipm): the first index of the addresses of the IPM subtrees, which lie right below the root."""
    return folders.where((F.col("source_id") == IPM_SUBTREE) & (F.size("address") == 1)).select("store_id", F.element_at("address", 1).alias("top")).distinct().withColumn("ipm", F.lit(True))


def deleted_items(folders: DataFrame) -> DataFrame:
    """(store_id, address): of the folders with the id of deleted items whose direct parent is an IPM subtree, the least address."""
    found = folders.where((F.col("source_id") == DELETED_ITEMS) & (F.size("address") == 2)).withColumn("top", F.element_at("address", 1)).join(_ipm(folders), ["store_id", "top"], "left_semi")
    return found.groupBy("store_id").agg(F.min("address").alias("address"))


def folder_set(folders: DataFrame) -> DataFrame:
    """One row per (store_id, location, folder_path) of paths_by_address() without error: the folder that stands for it, its role, and
    how many were omitted beside it.

    folders: store_id, source_id, address, folder_key and further columns. At the root only ordinary folder ids count, without the
    search root. The folder at the deleted-items address wins over others, the last of several by folder_key, else the first one.
    """
    located = folders.join(paths_by_address(folders).where("error is null").drop("error"), ["store_id", "address"])
    kept = located.where((F.col("location") != "store_root") | ((F.col("source_id").bitwiseAND(0x1F) == 2) & (F.col("source_id") != SEARCH_ROOT)))
    marked = kept.join(deleted_items(folders).withColumn("_d", F.lit(True)), ["store_id", "address"], "left")
    place = F.struct(F.coalesce("folder_key", F.lit("")), "source_id")
    value = F.struct("source_id", F.when(F.col("_d"), "deleted_items").otherwise("ordinary").alias("role"))
    won = marked.groupBy("store_id", "location", "folder_path").agg(F.max_by(F.when(F.col("_d"), value), F.when(F.col("_d"), place)).alias("deleted"), F.min_by(value, place).alias("first"), (F.count("*") - 1).alias("omitted"))
    return won.withColumn("w", F.coalesce("deleted", "first")).select("store_id", "location", "folder_path", "w.source_id", "w.role", "omitted")


def paths_by_parent(folders: DataFrame) -> DataFrame:
    """(store_id, source_id, folder_path, error) of folders by their parents: names from the top down, leaving out the root and the IPM
    subtree as their addresses show them. A parent that is not there ends the path as Recovered Folder and its id. A folder on or below
    a cycle, or with more than MOST_LEVELS names, has an error and no path. An empty path stays empty.

    folders: store_id, source_id, parent_source_id, name, address, one row each.
    """
    from postlode.operators import hierarchy as H

    seen = F.when(F.col("address").isNull() | visible_folder(F.col("address"), F.col("source_id")), _named(F.col("name"), F.col("source_id")))
    nodes = folders.where("store_id is not null and source_id is not null").select(F.col("store_id").alias("tree"), F.col("source_id").alias("node"), F.col("parent_source_id").alias("parent"), seen.alias("name"))
    reached, rest = H.hierarchy(nodes)
    lost = nodes.where("parent is not null").select("tree", F.col("node").alias("root"), F.concat(F.lit("Recovered Folder "), F.col("parent").cast("string")).alias("above"))
    whole = F.concat(F.when(F.col("above").isNotNull(), F.array("above")).otherwise(F.array().cast("array<string>")), F.array_compact("name_path"))
    named = reached.join(lost, ["tree", "root"], "left").select("tree", "node", whole.alias("p"))
    good = named.select("tree", "node", F.when(F.size("p") <= MOST_LEVELS, F.col("p")).alias("folder_path"), F.when(F.size("p") > MOST_LEVELS, _INVALID).alias("error"))
    bad = rest.select("tree", "node", F.lit(None).cast("array<string>").alias("folder_path"), F.lit(_INVALID).alias("error"))
    return good.unionByName(bad).withColumnsRenamed({"tree": "store_id", "node": "source_id"})


def filed(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(store_id, seq, folder_path, error) of messages by folder_id and paths_by_parent(): a folder that is not there is a Recovered
    Folder; no folder, or one whose path is empty, is the one of UNFILED for the provenance. Nearly all messages may be in one folder, which is one row of
    paths: the adaptive planner broadcasts paths or splits that partition."""
    j = messages.join(paths.withColumnRenamed("source_id", "folder_id").withColumn("_there", F.lit(True)), ["store_id", "folder_id"], "left")
    unfiled = F.array(F.element_at(F.create_map(*(F.lit(x) for kv in UNFILED.items() for x in kv)), F.col("provenance")))
    path = F.when(F.col("folder_id").isNull(), unfiled).when(F.col("_there").isNull(), F.array(F.concat(F.lit("Recovered Folder "), F.col("folder_id").cast("string")))).when(F.size("folder_path") == 0, unfiled).otherwise(F.col("folder_path"))
    return j.select("store_id", "seq", path.alias("folder_path"), "error")


def unambiguous(folders: DataFrame, key: str) -> DataFrame:
    """Folders whose key occurs once; an ambiguous key resolves nothing."""
    return folders.join(folders.groupBy("store_id", key).count().where("count = 1").select("store_id", key), ["store_id", key], "left_semi")


def slot_conflicts(candidates: DataFrame) -> DataFrame:
    """(store_id, parent_item_key, parent_attachment_index, children) of slots with more than one child."""
    return candidates.where("parent_item_key is not null").groupBy("store_id", "parent_item_key", "parent_attachment_index").agg(F.count("*").alias("children")).where("children > 1")


def ownership_errors(candidates: DataFrame, deepest: int = 256) -> DataFrame:
    """(store_id, item_key, rule) of embedded rows whose path isn't their parent's path plus their index, or is too deep, and of
    top-level rows with a path."""
    parent = candidates.select("store_id", F.col("item_key").alias("parent_item_key"), F.col("embedded_path").alias("parent_path"))
    c = candidates.join(parent, ["store_id", "parent_item_key"], "left")
    whole = F.concat(F.coalesce("parent_path", F.array().cast("array<int>")), F.array("parent_attachment_index"))
    rule = (
        F.when(F.size("embedded_path") > deepest, "too deep")
        .when(F.col("parent_item_key").isNull() & (F.size("embedded_path") > 0), "path without parent")
        .when(F.col("parent_item_key").isNotNull() & ~F.col("embedded_path").eqNullSafe(whole), "path differs from parent's")
    )
    return c.select("store_id", "item_key", rule.alias("rule")).where("rule is not null")


# --- repair of metadata ---------------------------------------------------------------------------------------------------


def contained_filetime(c: str) -> tuple[Column, Column]:
    """(ticks, invalid): 0 for null and for values beyond a signed 64-bit integer or below 0, of which only the latter are invalid."""
    v = F.col(c).cast("decimal(20,0)")
    bad = F.coalesce((v > _MAX_I64) | (v < 0), F.lit(False))
    return F.when(bad | v.isNull(), F.lit(0)).otherwise(v).cast("bigint"), bad


def filetime_to_timestamp(c: Column) -> Column:
    """Ticks of 100 ns since 1601 as a timestamp; microseconds are kept, the tenth is cut off."""
    return F.timestamp_micros(F.floor((c - F.lit(116444736000000000)) / 10).cast("bigint"))


def repaired_messages(m: DataFrame) -> DataFrame:
    """Messages with defaults and repairs: message_class, subject, sender_name, sender_email, ticks, and which fields were derived
    from another or generated (arrays of names, sorted)."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    name, email = filled("sender_name"), filled("sender_email")
    cls = F.coalesce(filled("message_class"), F.lit("IPM.Note"))
    optional = class_flags(cls)["sender_optional"]
    sent, sent_bad = contained_filetime("submit_filetime")
    received, received_bad = contained_filetime("delivery_filetime")
    has_received = F.col("delivery_filetime").isNotNull() & ~received_bad
    neither = name.isNull() & email.isNull()
    pick = lambda pairs: F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs))))
    derived = [("sender_address", name.isNotNull() & email.isNull()), ("sender_name", name.isNull() & email.isNotNull()), ("creation_time", has_received), ("modification_time", has_received)]
    generated = [
        ("message_class", filled("message_class").isNull()), ("subject", F.col("subject").isNull()), ("sender_name", neither & ~optional), ("sender_address", neither & ~optional),
        ("submit_time", F.col("submit_filetime").isNull() | sent_bad), ("delivery_time", F.col("delivery_filetime").isNull() | received_bad),
        ("creation_time", ~has_received), ("modification_time", ~has_received),
    ]
    return m.select(
        "store_id", "seq", cls.alias("message_class"), F.coalesce("subject", F.lit("")).alias("subject"),
        F.coalesce(name, email, F.lit("")).alias("sender_name"), F.coalesce(email, name, F.lit("")).alias("sender_email"),
        sent.alias("submit_ticks"), received.alias("delivery_ticks"), (sent_bad.cast("int") + received_bad.cast("int")).alias("omitted_properties"),
        pick(derived).alias("derived"), pick(generated).alias("generated"), default_container_class(cls).alias("container_class"),
    )


def default_container_class(c: Column) -> Column:
    f = class_flags(c)
    return F.when(f["is_contact"] | f["is_distribution_list"], "IPF.Contact").when(f["is_appointment"], "IPF.Appointment").when(f["is_task"], "IPF.Task").when(f["is_note_item"], "IPF.StickyNote").otherwise("IPF.Note")


def reconstruction_counts(repaired: DataFrame) -> DataFrame:
    """(field, kind, n): how often each field was derived or generated; counts of several frames add up."""
    each = lambda c: repaired.select(F.explode(c).alias("field"), F.lit(c).alias("kind"))
    return each("derived").unionByName(each("generated")).groupBy("field", "kind").agg(F.count("*").alias("n"))


def repaired_recipients(r: DataFrame) -> DataFrame:
    """Recipients of type 1 to 3 with a name or an address, each standing in for the other where it is null; derived names which."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    display = F.coalesce("display_name", "email_address")
    derived = F.when(empty("display_name") & ~empty("email_address"), "recipient_display_name").when(~empty("display_name") & empty("email_address"), "recipient_address")
    kind = F.when(F.col("recipient_type") == 1, "to").when(F.col("recipient_type") == 2, "cc").when(F.col("recipient_type") == 3, "bcc")
    return r.select("store_id", "seq", "message_id", kind.alias("kind"), display.alias("display_name"), F.coalesce("email_address", display).alias("email_address"), derived.alias("derived")).where("kind is not null and display_name is not null")


def partial_by_recipients(r: DataFrame) -> DataFrame:
    """(store_id, message_id, recipients, kept, partial): partial if a recipient is dropped or has an address type other than SMTP."""
    kept = F.col("recipient_type").between(1, 3) & F.coalesce("display_name", "email_address").isNotNull()
    return r.groupBy("store_id", "message_id").agg(F.count("*").alias("recipients"), F.count_if(kept).alias("kept"), (F.count_if(~F.coalesce(kept, F.lit(False)) | (F.col("address_type").isNotNull() & (F.upper("address_type") != "SMTP"))) > 0).alias("partial"))


#: File extension of a media type.
EXTENSIONS = {
    "application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/tiff": "tif", "application/zip": "zip",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/msword": "doc", "application/vnd.ms-excel": "xls", "application/vnd.ms-powerpoint": "ppt",
}


def extension_for_mime(c: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.element_at(pairs, F.lower(F.trim(F.element_at(F.split(c, ";"), 1))))


def filename_extension(c: Column) -> Column:
    """What follows the last dot, null if that is nothing or there is no dot."""
    return F.when(F.instr(c, ".") > 0, F.nullif(F.substring_index(c, ".", -1), F.lit("")))


def named_attachments(a: DataFrame) -> DataFrame:
    """Attachments with media type and filename filled in, and the terminal state of their data."""
    embedded, reference = F.col("attachment_type") == 5, F.col("attachment_type").isin(2, 3, 4, 7)
    mime = F.coalesce(F.nullif("detected_mime", F.lit("")), F.when(embedded, "message/rfc822"))
    made = F.when(embedded, F.format_string("Embedded message %d.msg", "attachment_index")).when(reference, F.format_string("Referenced attachment %d", "attachment_index")).otherwise(F.concat(F.lit("Recovered attachment "), F.col("attachment_index").cast("string"), F.lit("."), F.coalesce(extension_for_mime(mime), F.lit("bin"))))
    state = F.when(F.coalesce(embedded, F.lit(False)), "embedded").when(F.coalesce(reference, F.lit(False)), "attachment_reference").when(F.col("data_size").isNull(), "attachment_missing").when(F.col("data_size") == 0, "attachment_empty").otherwise("attachment_data")
    return a.select("store_id", "seq", "message_id", "attachment_index", mime.alias("mime"), F.coalesce(F.nullif("filename", F.lit("")), made).alias("filename"), F.coalesce(filename_extension(F.col("filename")), F.lit("")).alias("extension"), state.alias("terminal"))


def named_property_set(guid_hex: Column) -> Column:
    """mapi for the zero GUID and the MAPI set, public_strings, else guid."""
    return F.when(guid_hex.isin("0" * 32, "2803020000000000c000000000000046"), "mapi").when(guid_hex == "2903020000000000c000000000000046", "public_strings").otherwise("guid")


def latest(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of each key the row with the largest order value, all columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "n") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def display_names(messages: DataFrame) -> DataFrame:
    """(key.., display_name, how) of associated messages: their own display name (property 0x3001), else their subject (derived), else
    (no subject) (generated). messages: display_name and subject among its columns."""
    own, subject = F.nullif("display_name", F.lit("")), F.nullif("subject", F.lit(""))
    how = F.when(own.isNotNull(), "kept").when(subject.isNotNull(), "derived").otherwise("generated")
    return messages.withColumns({"display_name": F.coalesce(own, subject, F.lit("(no subject)")), "how": how})


def propagated_rejections(candidates: DataFrame) -> DataFrame:
    """(store_id, item_key, category): unsupported items with their own category, and every item above one of them, which then can't be
    written whole, as item_graph_dependency_rejected. An item that is both keeps its own."""
    from postlode.operators.recursion import descend

    own = candidates.where("status = 'unsupported'").select("store_id", "item_key")
    upward = candidates.where("parent_item_key is not null").select("store_id", F.col("parent_item_key").alias("item_key"), F.col("item_key").alias("parent"))
    above = descend(own, upward, ["store_id", "item_key"]).where("depth > 0").select("store_id", "item_key").distinct().join(own, ["store_id", "item_key"], "left_anti")
    return own.withColumn("category", F.lit("source_item_unsupported")).unionByName(above.withColumn("category", F.lit("item_graph_dependency_rejected")))


def part_folders(items: DataFrame, folders: DataFrame) -> DataFrame:
    """(store_id, part_index, prefix) of the folders a part holds: part 1 all of the store's, later ones those above their mail.

    items: store_id, part_index, folder_path; folders: store_id, folder_path. Null and empty paths have no folders."""
    from postlode.operators.ledger import folder_prefixes

    prefixes = lambda d, *c: d.select(*c, F.explode(folder_prefixes("folder_path")).alias("prefix")).distinct()
    first = items.where("part_index = 1").select("store_id").distinct()
    return prefixes(items, "store_id", "part_index").unionByName(prefixes(folders.join(first, "store_id", "left_semi").withColumn("part_index", F.lit(1)), "store_id", "part_index")).distinct()
