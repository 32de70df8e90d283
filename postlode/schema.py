"""Ledger schemas, closed domains and their orders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Closed domains, in their defined order.
PROVENANCE = ["normal", "recovered", "orphan", "fragment"]
COMPLETENESS = ["complete", "partial", "damaged"]
STATUS = ["pending", "spooled", "written", "unsupported", "failed"]
RECOVERY_MODES = {"balanced": 0, "aggressive": 0x03}
RECIPIENT_TYPES = {1: "to", 2: "cc", 3: "bcc"}
FILE_FORMATS = {14: "ansi32", 15: "ansi32", 23: "unicode64", 36: "unicode64_with4k_pages"}
EVENT_KINDS = [
    "recipient", "attachment", "attachment_mime_probe", "attachment_data", "attachment_partial", "attachment_direct", "attachment_missing",
    "attachment_reference", "property", "property_direct", "property_incomplete", "output_unrepresentable",
]
NODE_TYPES = {
    0x00: "heap", 0x01: "internal", 0x02: "normal_folder", 0x03: "search_folder", 0x04: "normal_message", 0x05: "attachment",
    0x06: "search_update_queue", 0x07: "search_criteria", 0x08: "associated_message", 0x0A: "contents_index", 0x0B: "receive_folders",
    0x0C: "outgoing_queue", 0x0D: "hierarchy_table", 0x0E: "contents_table", 0x0F: "associated_contents_table", 0x10: "search_contents_table",
    0x11: "attachment_table", 0x12: "recipient_table", 0x13: "search_table_index", 0x1F: "heap_internal",
}
IPM_SUBTREE, DELETED_ITEMS, SEARCH_ROOT = 0x8022, 0x8062, 0x8042
INLINE_LIMIT = 64 * 1024

#: Spark DDL of the ledger tables. store_id partitions all of them.
TABLES = {
    "job_metadata": "key string, value string",
    "folders": "store_id bigint, folder_key string, source_id bigint, parent_source_id bigint, name string, address_json string, container_class string",
    "candidates": "store_id bigint, seq bigint, item_key string, provenance string, source_node_id bigint, recovery_index bigint, occurrence int, completeness string, status string, metadata_json string, recovery_unit_json string, parent_item_key string, parent_attachment_index int, embedded_path_json string",
    "blobs": "store_id bigint, sha256 string, byte_len bigint, pack_offset bigint",
    "inline_blobs": "store_id bigint, sha256 string, data binary",
    "candidate_events": "store_id bigint, item_key string, sequence int, kind string, metadata_json string, blob_sha256 string, byte_len bigint",
    "worker_events": "store_id bigint, sequence bigint, kind string, attempt int, category string",
    "isolated_units": "store_id bigint, unit_json string, failures int",
    "parts": "store_id bigint, part_index int, filename string, byte_len bigint, sha256 string, oversize int, sidecar_json string",
    "part_items": "store_id bigint, part_index int, item_key string",
    "publication_intents": "store_id bigint, part_index int, part_json string, sidecar_json string, item_keys_json string",
}


def rank(column: str | Column, domain: list[str]) -> Column:
    """Position of a value in its domain; unknown values and nulls come after all known ones."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, domain)), c), F.lit(0).cast("bigint")), F.lit(len(domain) + 1).cast("bigint")).cast("int")


def node_type(nid: str | Column) -> Column:
    """Name of a node id's type (its low five bits), null for an unknown one."""
    c = F.col(nid) if isinstance(nid, str) else nid
    pairs = F.create_map(*(F.lit(x) for k, v in NODE_TYPES.items() for x in (k, v)))
    return F.element_at(pairs, c.bitwiseAND(0x1F).cast("int"))
