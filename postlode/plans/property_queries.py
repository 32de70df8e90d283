"""Queries of the property rules over the property rows of canonical_mail's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.operators import canonical as C, nested as N, properties as P
from postlode.plans import p3_nested as Q
from postlode.session import written

_OWNER = ["mail_id", "parent_path"]


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    return written(Q._occurrences(spark, sf))


def properties(spark: SparkSession, sf: str) -> DataFrame:
    """Property rows with their numbers: mail_id, node_path, parent_path, ordinal, property_id, value_type, record_set_index. What is no
    number is null."""
    o = N.flat_table(_objects(spark, sf), "property", ("property_id", "value_type", "record_set_index"))
    return o.select("mail_id", "node_path", "parent_path", "ordinal", *(F.expr(f"try_cast({c} as int)").alias(c) for c in ("property_id", "value_type", "record_set_index")))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    p, k = F.col("property_id"), F.col("value_type")
    each = properties(spark, sf).select(
        P.writer_managed(p).alias("managed"), P.body_type_valid(p, k).alias("body_valid"), (P.copied_type(p) == k).alias("copied_ok"), P.streamable(k).alias("streamable"), P.attachment_state(p, k).alias("as_attachment"),
    )
    return each.groupBy(*each.columns).agg(F.count("*").alias("n"))


def admitted(spark: SparkSession, sf: str) -> DataFrame:
    return P.admitted(properties(spark, sf), _OWNER, ["ordinal"]).select("mail_id", "node_path", "rule")


def linked(spark: SparkSession, sf: str) -> DataFrame:
    return P.linked_exceptions(properties(spark, sf), _OWNER)


def body_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The rule with a selector by the record: the number of its mail modulo 4 (0: none), and an RTF said to be in sync in every second."""
    p = properties(spark, sf).withColumns({"native_body": F.nullif((F.col("mail_id") % 4).cast("int"), F.lit(0)), "rtf_in_sync": F.col("mail_id") % 2 == 0})
    return P.body_metadata(p, _OWNER)


def display_names(spark: SparkSession, sf: str) -> DataFrame:
    """Associated mails of canonical_mail. A display name is a property of id 0x3001, whose value lies in a blob; here its hash stands for it."""
    o = _objects(spark, sf)
    name = N.flat_table(o, "property", ("property_id", "blob.sha256")).where("property_id = '12289'").groupBy("mail_id", F.col("parent_path").alias("node_path")).agg(F.min_by("blob_sha256", "ordinal").alias("display_name"))
    m = N.flat_table(o, "mail", ("subject", "placement")).where("placement = 'associated'").join(name, ["mail_id", "node_path"], "left")
    return C.display_names(m).select("mail_id", "node_path", "display_name", "how")


QUERIES = {"P14_P16_P17_P18_P19_property_rules": flags, "P15_admissible_properties": admitted, "P20_calendar_linkage": linked, "X10_body_metadata": body_metadata, "X14_display_names": display_names}
_in = lambda values: ", ".join(map(str, values))
_case = lambda pairs: " ".join(f"WHEN {k} THEN {v}" for k, v in pairs.items())
_BODY = "CASE WHEN p IN (125, 4096) THEN coalesce(k IN (30, 31), false) WHEN p IN (4105, 4115) THEN coalesce(k = 258, false) ELSE true END"
_PROPS = Q._NODES + ", pr AS (SELECT mail_id, node_path, parent_path, ordinal, TRY_CAST(j ->> '$.property_id' AS INT) AS p, TRY_CAST(j ->> '$.value_type' AS INT) AS k, TRY_CAST(j ->> '$.record_set_index' AS INT) AS r FROM node WHERE node_kind = 'property')"
_KEPT = f"CASE p {_case(P.ATTACHMENT_KEPT)} END"
SQL = {
    "P14_P16_P17_P18_P19_property_rules": _PROPS
    + f""" SELECT coalesce(p IN ({_in(P.WRITER_MANAGED)}), false) AS managed, {_BODY} AS body_valid, CASE p {_case(P.COPIED)} END = k AS copied_ok, coalesce(k IN (30, 31, 258), false) AS streamable,
        CASE WHEN p IN ({_in(P.ATTACHMENT_MAPPED)}) THEN 'mapped' WHEN {_KEPT} = k THEN 'kept' WHEN {_KEPT} IS NOT NULL THEN 'wrong type' ELSE 'other' END AS as_attachment, count(*) AS n FROM pr GROUP BY 1, 2, 3, 4, 5""",
    "P15_admissible_properties": _PROPS
    + f""", f AS (SELECT *, CASE WHEN p IS NULL THEN 'id' WHEN k IS NULL THEN 'no type' WHEN r IS NULL OR r <> 0 THEN 'record set' WHEN p <= 0 OR p >= 32768 THEN 'id' WHEN NOT ({_BODY}) THEN 'body type' END AS rule1 FROM pr)
        SELECT mail_id, node_path, CASE WHEN rule1 IS NULL AND EXISTS (SELECT 1 FROM f g WHERE g.mail_id = f.mail_id AND g.parent_path = f.parent_path AND g.p = f.p AND g.rule1 IS NULL AND g.ordinal < f.ordinal) THEN 'repeated' ELSE rule1 END AS rule FROM f""",
    "P20_calendar_linkage": _PROPS + " SELECT mail_id, parent_path, CAST(count(DISTINCT CASE WHEN p BETWEEN 32762 AND 32766 THEN p END) AS INT) AS linkage FROM pr WHERE r = 0 GROUP BY 1, 2",
    "X10_body_metadata": _PROPS
    + """, o AS (SELECT mail_id, parent_path, nullif(CAST(mail_id % 4 AS INT), 0) AS s, mail_id % 2 = 0 AS r, list(p) AS ids FROM pr GROUP BY 1, 2),
        m AS (SELECT *, coalesce(NOT list_contains(ids, CASE s WHEN 1 THEN 4096 WHEN 2 THEN 4105 WHEN 3 THEN 4115 END), false) AS lost, r AND NOT list_contains(ids, 4105) AS no_rtf FROM o)
        SELECT mail_id, parent_path, CASE WHEN NOT lost THEN s END AS native_body, r AND NOT no_rtf AS rtf_in_sync, lost::INT + no_rtf::INT AS omitted FROM m""",
    "X14_display_names": _PROPS.replace("FROM node WHERE node_kind = 'property')", ", j ->> '$.blob.sha256' AS sha FROM node WHERE node_kind = 'property')")
    + """, dn AS (SELECT mail_id, parent_path AS node_path, arg_min(sha, ordinal) AS d FROM pr WHERE p = 12289 GROUP BY 1, 2)
        SELECT n.mail_id, n.node_path, coalesce(nullif(d, ''), nullif(j ->> '$.subject', ''), '(no subject)') AS display_name, CASE WHEN d <> '' THEN 'kept' WHEN j ->> '$.subject' <> '' THEN 'derived' ELSE 'generated' END AS how
        FROM node n LEFT JOIN dn USING (mail_id, node_path) WHERE node_kind = 'mail' AND j ->> '$.placement' = 'associated'""",
}
