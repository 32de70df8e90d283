"""Problem 3: nested mail records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.operators import nested as N
from postlode.session import table, written

#: Columns of the flat tables, by kind of node: fields of the object, some of them in objects of its own.
FIELDS = {
    "mail": ("subject", "sender_name", "sender_email", "submit_filetime", "message_class", "completeness", "folder_path", "folder_location", "placement", "spooled_bytes", "key.provenance", "key.source_node_id", "key.recovery_index", "key.occurrence"),
    "recipient": ("index", "recipient_type", "display_name", "email_address", "address_type"),
    "attachment": ("index", "attachment_type", "filename", "detected_mime", "data_complete", "declared_size", "data.sha256", "data.byte_len", "data.pack_offset"),
    "property": ("owner", "owner_index", "record_set_index", "entry_index", "property_id", "value_type", "declared_byte_len", "blob.sha256", "blob.byte_len", "blob.pack_offset", "named_property.guid", "named_property.name.kind", "named_property.name.value"),
}


def _occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return N.occurrences(N.latest_records(table(spark, sf, "canonical_mail")))


def _unfolded(spark: SparkSession, sf: str) -> DataFrame:
    """All places of all objects, each object being stored once and joined to its places by its identity."""
    o = written(_occurrences(spark, sf))
    return N.unfolded(N.bridge(o), N.stored_objects(o))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return _unfolded(spark, sf).select("mail_id", "node_kind", "node_path", "parent_path")


def bridge(spark: SparkSession, sf: str) -> DataFrame:
    return N.bridge(_occurrences(spark, sf))


def objects(spark: SparkSession, sf: str) -> DataFrame:
    return N.stored_objects(_occurrences(spark, sf))


def _flat(kind: str):
    return lambda spark, sf: N.flat_table(_occurrences(spark, sf), kind, FIELDS[kind]).drop("object_id", "content")


def shared_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind: places, and how many of them are at ordinal 0 of their relation."""
    return _unfolded(spark, sf).groupBy("node_kind", "relation").agg(F.count("*").alias("places"), F.count_if(F.col("ordinal") == 0).alias("first_places"))


#: DuckDB's json_valid lets a comma stand before a closing bracket; JSON does not, so that is tested beside it, outside strings.
_NODES = r"""
WITH RECURSIVE latest AS (SELECT mail_id, arg_max({'r': record_json}, captured_at).r AS r FROM canonical_mail GROUP BY mail_id),
node AS (
  SELECT mail_id, 'mail' AS node_kind, '$' AS node_path, '' AS parent_path, 0 AS ordinal, CAST(r AS JSON) AS j FROM latest
  WHERE r IS NOT NULL AND json_valid(r) AND NOT regexp_matches(regexp_replace(r, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[}\]]') AND json_type(CAST(CASE WHEN json_valid(r) THEN r END AS JSON)) = 'OBJECT'
  UNION ALL
  SELECT mail_id, kind, node_path || '.' || k || CASE WHEN listed THEN '[' || i || ']' ELSE '' END, node_path, i, x
  FROM (
    SELECT mail_id, node_path, c.kind AS kind, c.k AS k, c.listed AS listed, u.i AS i,
      CASE WHEN json_type(v) = 'ARRAY' THEN v -> CAST(u.i AS INT) ELSE v END AS x, json_type(v) AS t
    FROM (
      SELECT mail_id, node_path, c, CASE WHEN NOT c.listed AND json_type(j -> c.k) = 'VARCHAR' AND json_valid(j ->> c.k) THEN CAST(j ->> c.k AS JSON) ELSE j -> c.k END AS v
      FROM (SELECT mail_id, node_path, j, unnest(CASE node_kind
          WHEN 'mail' THEN [{'k': 'recipients', 'kind': 'recipient', 'listed': true}, {'k': 'attachments', 'kind': 'attachment', 'listed': true}, {'k': 'properties', 'kind': 'property', 'listed': true}]
          WHEN 'recipient' THEN [{'k': 'properties', 'kind': 'property', 'listed': true}]
          WHEN 'attachment' THEN [{'k': 'properties', 'kind': 'property', 'listed': true}, {'k': 'embedded', 'kind': 'mail', 'listed': false}]
          ELSE [] END) AS c FROM node)),
      LATERAL (SELECT unnest(range(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(json_array_length(v) AS INT) ELSE 1 END)) AS i) u
    WHERE v IS NOT NULL AND (c.listed OR json_type(v) = 'OBJECT'))
  WHERE json_type(x) = 'OBJECT')
"""

QUERIES = {"p3_found": found, "p3_bridge": bridge, "p3_objects": objects, "p3_unfolded": _unfolded, "p3_places": shared_objects, **{f"p3_{kind}_table": _flat(kind) for kind in FIELDS}}
SQL = {
    "p3_found": _NODES + "SELECT mail_id, node_kind, node_path, parent_path FROM node",
    "p3_places": _NODES + r"SELECT node_kind, coalesce(regexp_extract(substr(node_path, length(parent_path) + 2), '^[a-z]+'), '') AS relation, count(*) AS places, count(*) FILTER (ordinal = 0) AS first_places FROM (SELECT *, 1 FROM node) GROUP BY 1, 2",
    **{
        f"p3_{kind}_table": _NODES + f"SELECT mail_id, node_path, parent_path, ordinal, {', '.join(f"j ->> '$.{f}' AS {f.replace('.', '_')}" for f in fields)} FROM node WHERE node_kind = '{kind}'"
        for kind, fields in FIELDS.items()
    },
}
