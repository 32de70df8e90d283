"""Rules over property rows of messages and attachments, as columns: which are admissible, of what type they must be, which are kept.

Rows have property_id, value_type and record_set_index as integers; null ids and types are admissible to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Property ids that a writer sets itself.
WRITER_MANAGED = [
    0x001A, 0x0037, 0x0039, 0x0042, 0x0064, 0x0065, 0x007D, 0x0C1A, 0x0C1E, 0x0C1F, 0x0E02, 0x0E03, 0x0E04, 0x0E06, 0x0E07, 0x0E08, 0x0E17, 0x0E1B, 0x0E1F,
    0x1000, 0x1009, 0x1013, 0x1016, 0x3007, 0x3008, 0x300B, 0x3FDE,
]
#: Types by name, the types of bodies, and the type that each property of a copied message must have.
INT32, BOOL, TEXT8, TEXT16, TIME, BINARY = 0x0003, 0x000B, 0x001E, 0x001F, 0x0040, 0x0102
BODIES = {0x007D: [TEXT8, TEXT16], 0x1000: [TEXT8, TEXT16], 0x1009: [BINARY], 0x1013: [BINARY]}
COPIED = {0x0017: INT32, 0x0036: INT32, 0x0E38: INT32, 0x1097: INT32, 0x65C6: INT32, 0x0057: BOOL, 0x0058: BOOL, 0x0070: TEXT16, 0x0071: BINARY, 0x0E3C: BINARY, 0x0E3D: BINARY, 0x3013: BINARY}
STREAMABLE = [TEXT8, TEXT16, BINARY]
#: Attachment properties with a place of their own, and those kept as they are with the type they must have.
ATTACHMENT_MAPPED = [0x0E20, 0x0E21, 0x3701, 0x3704, 0x3705, 0x3707, 0x3708, 0x370D]
ATTACHMENT_KEPT = {0x3001: TEXT16, 0x3702: BINARY, 0x3709: BINARY, 0x7FFA: INT32, 0x7FFB: TIME, 0x7FFC: TIME, 0x7FFD: INT32, 0x7FFE: BOOL, 0x7FFF: BOOL}
#: Properties that link a calendar exception to its series; the selector of the native body and the body each value means.
LINKAGE = [0x7FFA, 0x7FFB, 0x7FFC, 0x7FFD, 0x7FFE]
NATIVE = {1: 0x1000, 2: 0x1009, 3: 0x1013}


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def writer_managed(prop: Column) -> Column:
    return _known(prop.isin(WRITER_MANAGED))


def body_type_valid(prop: Column, kind: Column) -> Column:
    """Whether a body has one of its types; other properties may have any."""
    out = F.when(F.lit(False), F.lit(True))
    for p, kinds in BODIES.items():
        out = out.when(prop == p, _known(kind.isin(kinds)))
    return out.otherwise(True)


def copied_type(prop: Column) -> Column:
    """The type a property of a copied message must have, null for one without such a rule."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in COPIED.items() for x in kv)), prop.cast("int"))


def streamable(kind: Column) -> Column:
    return _known(kind.isin(STREAMABLE))


def attachment_state(prop: Column, kind: Column) -> Column:
    """mapped, kept, wrong type (of one that would be kept) or other."""
    must = F.element_at(F.create_map(*(F.lit(x) for kv in ATTACHMENT_KEPT.items() for x in kv)), prop.cast("int"))
    return F.when(_known(prop.isin(ATTACHMENT_MAPPED)), "mapped").when(must == kind, "kept").when(must.isNotNull(), "wrong type").otherwise("other")


def admitted(properties: DataFrame, owner: list[str], order: list[str]) -> DataFrame:
    """Adds rule: null for an admissible property of a message, else why it is none: no type, record set (another than 0), id (0, null or from
    0x8000 on), body type, repeated (not the first of its id by order among those that pass the others). An owner's properties are few."""
    p, k = F.col("property_id"), F.col("value_type")
    first = F.when(p.isNull(), "id").when(k.isNull(), "no type").when(~_known(F.col("record_set_index") == 0), "record set").when((p <= 0) | (p >= 0x8000), "id").when(~body_type_valid(p, k), "body type")
    marked = properties.withColumn("_first", first)
    place = F.row_number().over(W.partitionBy(*owner, "property_id", F.col("_first").isNull()).orderBy(*order))
    return marked.withColumn("_place", place).withColumn("rule", F.when(F.col("_first").isNull() & (F.col("_place") > 1), "repeated").otherwise(F.col("_first"))).drop("_first", "_place")


def linked_exceptions(properties: DataFrame, owner: list[str]) -> DataFrame:
    """(owner.., linkage): how many of the five linking properties each owner has in record set 0; five make a calendar exception whole."""
    return properties.where("record_set_index = 0").groupBy(*owner).agg(F.countDistinct(F.when(F.col("property_id").isin(LINKAGE), F.col("property_id"))).cast("int").alias("linkage"))


def body_metadata(properties: DataFrame, owner: list[str], selector: str = "native_body", in_sync: str = "rtf_in_sync") -> DataFrame:
    """(owner.., selector, in_sync, omitted) of messages: the selector of the native body is cleared where its body is not among the
    properties, and the RTF's being in sync where there is no RTF; omitted counts both. properties has both as columns, equal in all
    rows of an owner."""
    has = {p: F.max(F.when(F.col("property_id") == p, 1).otherwise(0)).alias(f"_{p}") for p in (0x1000, 0x1009, 0x1013)}
    each = properties.groupBy(*owner).agg(F.max(selector).alias("s"), F.max(in_sync).alias("r"), *has.values())
    missing = F.lit(False)
    for value, p in NATIVE.items():
        missing = missing | ((F.col("s") == value) & (F.col(f"_{p}") == 0))
    missing = _known(missing)
    no_rtf = _known(F.col("r")) & (F.col(f"_{0x1009}") == 0)
    return each.select(*owner, F.when(~missing, F.col("s")).alias(selector), F.when(no_rtf, False).otherwise(F.col("r")).alias(in_sync), (missing.cast("int") + no_rtf.cast("int")).alias("omitted"))


def reconstructed_recipient(prop: Column, kind: Column, display: Column, email: Column, recipient_type: Column, index: Column) -> Column:
    """The value, as text, that a recipient's property must have to be put together again from the recipient's own fields; null where
    there is none. kind is not looked at, as the value's form says it."""
    name, address = F.coalesce(display, email), F.coalesce(email, display)
    value = (
        F.when(prop == 0x0C15, recipient_type.cast("string")).when(prop.isin(0x0E0F, 0x3A40), "false").when(prop.isin(0x0FF9, 0x0FFF, 0x300B), "").when(prop == 0x0FFE, "6")
        .when(prop == 0x3001, name).when(prop == 0x3002, "SMTP").when(prop.isin(0x3003, 0x39FF), address).when(prop == 0x3900, "0").when(prop == 0x67F3, "1").when(prop == 0x67F2, (index + 1).cast("string"))
    )
    return F.when(name.isNotNull(), value)


def distribution_list(counts: DataFrame, owner: list[str]) -> DataFrame:
    """(owner.., removed) of distribution lists: the sorted names of members, one_off and checksum that have to go. counts: owner and, for each
    of the three, its type (null: absent) and for the sets how many values they have: members_type, members_n, one_off_type, one_off_n,
    checksum_type. Sets must be lists of binaries (0x1102) of one length; the checksum must be an integer beside valid members."""
    many = 0x1102
    bad = _known(F.col("members_type") != many)
    n = F.when(F.col("members_type") == many, F.col("members_n"))
    one_n = F.when(F.col("one_off_type") == many, F.col("one_off_n"))
    gone = {"checksum": F.col("checksum_type").isNotNull() & (n.isNull() | (F.col("checksum_type") != INT32)), "members": bad, "one_off": F.col("one_off_type").isNotNull() & (bad | ~one_n.eqNullSafe(n))}
    return counts.select(*owner, F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in gone.items()))).alias("removed"))
