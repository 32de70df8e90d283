from pyspark.sql import functions as F

from postlode.operators import properties as P

PROP = "owner string, ordinal int, property_id int, value_type int, record_set_index int"


def test_admission(spark):
    rows = [("a", 0, 0x1000, 0x1F, 0), ("a", 1, 0x1000, 0x1E, 0), ("a", 2, 0x1009, 0x1F, 0), ("a", 3, 0x1009, 0x102, 0), ("a", 4, 0x8001, 3, 0), ("a", 5, 0, 3, 0), ("a", 6, 5, None, 0), ("a", 7, None, 3, 0), ("a", 8, 5, 3, 1), ("a", 9, 5, 3, None), ("b", 0, 0x1000, 0x1F, 0), (None, 0, 7, 3, 0), (None, 1, 7, 3, 0)]
    got = {(r.owner, r.ordinal): r.rule for r in P.admitted(spark.createDataFrame(rows, PROP), ["owner"], ["ordinal"]).collect()}
    assert len(got) == len(rows) and {k: v for k, v in got.items() if v} == {("a", 1): "repeated", ("a", 2): "body type", ("a", 4): "id", ("a", 5): "id", ("a", 6): "no type", ("a", 7): "id", ("a", 8): "record set", ("a", 9): "record set", (None, 1): "repeated"}
    assert P.admitted(spark.createDataFrame([], PROP), ["owner"], ["ordinal"]).count() == 0


def test_flags(spark):
    p, k = F.col("property_id"), F.col("value_type")
    df = spark.createDataFrame([(0x1000, 0x102), (0x1000, None), (0x70, 0x1F), (0x3001, 3), (0x7FFB, 0x40), (0x3701, 0x102), (None, None)], "property_id int, value_type int")
    got = [tuple(r) for r in df.select(P.writer_managed(p), P.body_type_valid(p, k), P.copied_type(p), P.streamable(k), P.attachment_state(p, k)).collect()]
    assert got == [(True, False, None, True, "other"), (True, False, None, False, "other"), (False, True, 0x1F, True, "other"), (False, True, None, False, "wrong type"), (False, True, None, False, "kept"), (False, True, None, True, "mapped"), (False, True, None, False, "other")]


def test_linkage_and_bodies(spark):
    rows = [("a", k, p, 3, 0) for k, p in enumerate([*P.LINKAGE, 0x7FFA])] + [("b", 0, 0x7FFA, 3, 0), ("b", 1, 0x7FFB, 3, 1)]
    assert {r.owner: r.linkage for r in P.linked_exceptions(spark.createDataFrame(rows, PROP), ["owner"]).collect()} == {"a": 5, "b": 1}
    rows = [("a", 0x1009, 2, True), ("b", 0x1000, 2, True), ("c", 0x1013, None, None), ("d", 0x1013, 3, False), ("e", None, 1, True)]
    got = {r.owner: (r.native_body, r.rtf_in_sync, r.omitted) for r in P.body_metadata(spark.createDataFrame(rows, "owner string, property_id int, native_body int, rtf_in_sync boolean"), ["owner"]).collect()}
    assert got == {"a": (2, True, 0), "b": (None, False, 2), "c": (None, None, 0), "d": (3, False, 0), "e": (None, False, 2)}


def test_recipients_are_put_together_again(spark):
    df = spark.createDataFrame([(p, "N", None, 2, 4) for p in (0x0C15, 0x0E0F, 0x0FFE, 0x3001, 0x3002, 0x39FF, 0x67F2, 0x9999)] + [(0x3001, None, "e", 1, 0), (0x3001, None, None, 1, 0)], "p int, d string, e string, t int, i int")
    got = [r[0] for r in df.select(P.reconstructed_recipient(F.col("p"), F.lit(3), F.col("d"), F.col("e"), F.col("t"), F.col("i"))).collect()]
    assert got == ["2", "false", "6", "N", "SMTP", "N", "5", None, "e", None]


def test_distribution_lists(spark):
    many = 0x1102
    rows = [("ok", many, 3, many, 3, 3), ("counts", many, 3, many, 2, 3), ("type", 0x1003, 3, many, 3, 3), ("none", None, None, many, 3, 3), ("sum", many, 3, None, None, 0x1F), ("one", many, 3, 0x1F, None, None), ("empty", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "owner string, members_type int, members_n int, one_off_type int, one_off_n int, checksum_type int")
    got = {r.owner: r.removed for r in P.distribution_list(df, ["owner"]).collect()}
    assert got == {"ok": [], "counts": ["one_off"], "type": ["checksum", "members", "one_off"], "none": ["checksum", "one_off"], "sum": ["checksum"], "one": ["one_off"], "empty": []}
