import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from postlode import schema as S
from postlode.operators import canonical as C, integrity as I, ledger as L, recursion as R

H = lambda x: hashlib.sha256(x.encode()).hexdigest()
CAND = "store_id bigint, seq bigint, item_key string, provenance string, source_node_id bigint, recovery_index bigint, status string, completeness string, parent_item_key string, parent_attachment_index int, embedded_path_json string, parent_message_id bigint, embedded_depth int"
c = lambda key, status="written", parent=None, index=None, path="[]", seq=1: (1, seq, key, "normal", 1, None, status, "complete", parent, index, path, None, 0)


def tables(spark, **over):
    base = {
        "candidates": ([c("a"), c("b", "spooled"), c("e", "spooled", "a", 0, "[0]")], CAND),
        "candidate_events": ([(1, "a", 1, "recipient", None, None), (1, "a", 2, "attachment_data", H("x"), 4)], "store_id bigint, item_key string, sequence int, kind string, blob_sha256 string, byte_len bigint"),
        "blobs": ([(1, H("x"), 4, 0)], "store_id bigint, sha256 string, byte_len bigint, pack_offset bigint"),
        "part_items": ([(1, 1, "a")], "store_id bigint, part_index int, item_key string"),
        "parts": ([(1, 1, 1)], "store_id bigint, part_index int, oversize int"),
    }
    return {k: spark.createDataFrame(over.get(k, rows), schema) for k, (rows, schema) in base.items()}


def offenders(spark, rule, **over):
    return sorted(r.offender for r in I.RULES[rule](tables(spark, **over)).collect())


def test_a_clean_ledger_passes_every_rule(spark):
    assert {r.rule: r.offenders for r in I.report(tables(spark)).collect()} == dict.fromkeys(I.RULES, 0)


def test_an_empty_ledger_passes_every_rule(spark):
    assert set(r.offenders for r in I.report(tables(spark, candidates=[], candidate_events=[], blobs=[], part_items=[], parts=[])).collect()) == {0}


E = lambda *more: [(1, "a", 1, "recipient", None, None), (1, "a", 2, "attachment_data", H("x"), 4), *more]


@pytest.mark.parametrize(
    ("rule", "over", "want"),
    [
        ("I01_pending", {"candidates": [c("a"), c("p", "pending")]}, ["p"]),
        ("I02_blob_parity", {"candidate_events": E((1, "a", 3, "property", H("x"), None), (1, "a", 4, "property", None, 3))}, ["a#3", "a#4"]),
        ("I03_event_length", {"candidate_events": E((1, "a", 3, "property", H("x"), 5), (1, "a", 4, "property", H("q"), 5))}, ["a#3", "a#4"]),
        ("I04_unreferenced_blob", {"blobs": [(1, H("x"), 4, 0), (1, H("y"), 1, 4), (2, H("x"), 4, 0)]}, sorted([H("x"), H("y")])),
        ("I05_written_without_part", {"part_items": []}, ["a"]),
        ("I06_part_item_not_written", {"part_items": [(1, 1, "a"), (1, 1, "b"), (1, 1, "zz")]}, ["b", "zz"]),
        ("I07_empty_part", {"parts": [(1, 1, 0), (1, 2, 0)]}, ["2"]),
        ("I08_oversize_part", {"candidates": [c("a"), c("b")], "part_items": [(1, 1, "a"), (1, 1, "b")]}, ["1"]),
        ("I09_pack_overlap", {"blobs": [(1, H("x"), 4, 0), (1, H("y"), 4, 3), (1, H("z"), 0, 3), (1, H("q"), 5, 7), (2, H("x"), 4, 2), (1, H("w"), None, 1)]}, [H("y")]),
        ("I10_blob_identity", {"blobs": [(1, H("x"), 4, 0), (1, H("x"), 4, 0), (1, "ABC", 1, 4), (1, H("n"), -1, 9)]}, sorted([H("x"), "ABC", H("n")])),
        ("I12_rejections", {"candidates": [c("a"), c("u", "unsupported"), c("v", "unsupported")], "candidate_events": E((1, "v", 1, "output_unrepresentable", None, None), (1, "a", 3, "output_unrepresentable", None, None))}, ["a", "u"]),
        ("I13_foreign_keys", {"candidate_events": E((1, "gone", 1, "recipient", None, None)), "candidates": [c("a"), c("e", "spooled", "nobody", 0, "[0]")]}, ["gone", "nobody"]),
        ("I16_ownership", {"candidates": [c("a"), c("h", parent="a"), c("p", path="[1]"), c("s", parent="a", index=2, path="[2]"), c("t", parent="a", index=2, path="[2]")]}, ["h", "p", "s", "t"]),
        ("I17_duplicate_items", {"part_items": [(1, 1, "a"), (1, 2, "a")]}, ["a"]),
        ("X_unknown_event_kinds", {"candidate_events": E((1, "a", 3, "nonsense", None, None), (1, "a", 4, None, None, None))}, ["a#3", "a#4"]),
    ],
)
def test_each_violation_is_found(spark, rule, over, want):
    assert offenders(spark, rule, **over) == want


def test_touching_ranges_over_range_borders(spark):
    big = 1 << 26
    ok = [(1, H("a"), big + 5, 0), (1, H("b"), 10, big + 5), (1, H("c"), big, 3 * big)]
    assert offenders(spark, "I09_pack_overlap", blobs=ok) == []
    assert offenders(spark, "I09_pack_overlap", blobs=[*ok, (1, H("d"), 1, big + 2)]) == [H("d")]


def test_stranded_and_trees(spark):
    rows = [c("r"), c("s1", "spooled", "r", 0, "[0]"), c("s2", "spooled", "s1", 0, "[0,0]"), c("w", "written", "s2", 0, "[0]"), c("s3", "spooled", "w", 0, "[0]"), c("f", "failed", "r", 1, "[1]"), c("s4", "spooled", "f", 0, "[0]")]
    df = spark.createDataFrame(rows, CAND)
    assert sorted((r.item_key, r.depth) for r in R.stranded(df).collect()) == [("s1", 0), ("s2", 1), ("s3", 0)]
    assert sorted((r.item_key, r.depth) for r in R.trees(df, ["written", "spooled"]).collect()) == [("r", 0), ("s1", 1), ("s2", 2), ("s3", 4), ("w", 3)]
    cyclic = spark.createDataFrame([(1, "x", "y"), (1, "y", "x"), (1, "z", None)], "store_id bigint, k string, parent string")
    assert sorted((r.root, r.k, r.depth) for r in R.descend(spark.createDataFrame([(1, "x")], "store_id bigint, k string"), cyclic, ["store_id", "k"]).collect()) == [("x", "x", 0), ("x", "y", 1)]


def test_keys_parents_and_first_wins(spark):
    rows = [(1, 1, 5, None, None, 0), (1, 2, 5, None, None, 0), (1, 3, 9, None, 5, 1), (1, 4, 5, None, None, 0), (1, 5, None, 3, None, 0), (1, 6, 0, None, None, 0), (1, 7, 0, None, None, 0)]
    df = spark.createDataFrame([(s, q, "normal", n, i, p, d) for s, q, n, i, p, d in rows], "store_id bigint, seq bigint, provenance string, source_node_id bigint, recovery_index bigint, parent_message_id bigint, embedded_depth int")
    keyed = L.with_occurrence(df).withColumn("item_key", L.item_key()).orderBy("seq").collect()
    assert [r.item_key for r in keyed] == ["normal:5:-:0", "normal:5:-:1", "normal:9:-:0", "normal:5:-:2", "normal:-:3:0", "normal:0:-:0", "normal:0:-:1"]
    kept, issues = L.first_wins(df)
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 5, 6, 7] and sorted(r.seq for r in issues.collect()) == [2, 4]


def test_parents_by_provenance_index_and_path(spark):
    rows = [  # seq, key, provenance, recovery_index, status, parent_message_id, parent_attachment_index, embedded_path
        (1, "a", "normal", None, "spooled", None, None, []),
        (2, "a0", "normal", None, "spooled", 5, 0, [0]),
        (3, "a03", "normal", None, "spooled", 6, 3, [0, 3]),
        (4, "b", "normal", None, "pending", None, None, []),
        (5, "c1", "normal", None, "spooled", 9, 1, [1]),  # b is pending, so a, whatever id it names
        (6, "r", "recovered", 7, "failed", None, None, None),
        (7, "r2", "recovered", 7, "spooled", 5, 2, [2]),
        (8, "s2", "recovered", 8, "spooled", 5, 2, [2]),  # nothing of that recovery index before it
        (9, "x", "normal", None, "spooled", 5, 4, [5]),  # the path ends in another index
        (10, "y", "normal", None, "spooled", 5, 4, []),  # no path
        (11, "z", "normal", None, "spooled", None, 0, [0]),  # embedded nowhere
        (70_000, "d0", "normal", None, "spooled", 5, 0, [0]),  # another block of seq: the last row without a path is y
        (200_000, "e09", "normal", None, "spooled", 5, 9, [0, 9]),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "store_id bigint, seq bigint, item_key string, provenance string, recovery_index bigint, status string, parent_message_id bigint, parent_attachment_index int, embedded_path array<int>")
    got = {r.item_key: r.parent_item_key for r in L.with_parent(df).collect()}
    assert len(got) == len(rows) and {k: v for k, v in got.items() if v} == {"a0": "a", "a03": "a0", "c1": "a", "r2": "r", "d0": "y", "e09": "d0"}
    assert L.with_parent(df.limit(0)).count() == 0


def test_blobs_and_offsets(spark):
    rows = [(1, H(str(k % 40)), k % 40) for k in range(200)] + [(1, H("1"), 999), (1, None, 3), (2, H("x"), None)]
    b = L.with_pack_offsets(L.stored_blobs(spark.createDataFrame(rows, "store_id bigint, sha256 string, byte_len bigint")))
    got = {r.sha256: r for r in b.where("store_id = 1").collect()}
    at = 0
    for h in sorted(got):
        assert got[h].pack_offset == at
        at += got[h].byte_len
    assert got[H("1")].conflicting and not got[H("2")].conflicting and len(got) == 40


def test_multisets(spark):
    df = spark.createDataFrame([(["1", "1", "2"], ["2", "1", "3", "1"]), (["1", "1", "2"], ["1", "2", "3"]), (["1", "2"], ["1", "3", "4"]), ([], ["1"]), ([None], [None])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(L.multiset_contains(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, True, True]
    one, two = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["a", "a", "b", None], ["a", "c", None]))
    assert sorted((r.k or "-", r.missing, r.surplus) for r in L.multiset_difference(one, two, ["k"]).collect()) == [("a", 1, 0), ("b", 1, 0), ("c", 0, 1)]


def test_predicates(spark):
    rows = ["IPM.Note", "ipm.note.x", "IPM.Note.", "IPM.Notes", "IPM.Contact", "IPM.Schedule.Meeting", "IPM.Schedule.Meeting.Request", "REPORT.IPM.Note.NDR", "", None]
    df = spark.createDataFrame([(x,) for x in rows], "c string")
    flags = C.class_flags(F.col("c"))
    got = df.select(L.is_or_descends_from(F.col("c"), "IPM.Note").alias("n"), flags["is_meeting"].alias("m"), flags["sender_optional"].alias("o"), C.default_container_class(F.col("c")).alias("k")).collect()
    assert [r.n for r in got] == [True, True, False, False, False, False, False, False, False, False]
    assert [r.m for r in got][5:7] == [False, True] and [r.o for r in got] == [False, False, True, True, True, True, False, False, True, True]
    assert got[4].k == "IPF.Contact" and got[0].k == "IPF.Note"
    ranks = spark.createDataFrame([(x,) for x in ["fragment", "normal", None, "odd"]], "p string").select(S.rank("p", S.PROVENANCE).alias("r")).collect()
    assert [r.r for r in ranks] == [4, 1, 5, 5]


def test_repairs(spark):
    m = "store_id bigint, seq bigint, message_class string, subject string, sender_name string, sender_email string, submit_filetime decimal(20,0), delivery_filetime decimal(20,0)"
    rows = [(1, 1, None, None, "N", None, None, 5), (1, 2, "IPM.Contact", "s", "", None, 2**63, 2**63), (1, 3, "IPM.Note", "", None, None, 7, None)]
    got = {r.seq: r for r in C.repaired_messages(spark.createDataFrame([(a, b, c_, d, e, f, None if g is None else __import__("decimal").Decimal(g), None if h is None else __import__("decimal").Decimal(h)) for a, b, c_, d, e, f, g, h in rows], m)).collect()}
    assert got[1].sender_email == "N" and got[1].derived == ["creation_time", "modification_time", "sender_address"] and "message_class" in got[1].generated
    assert got[2].omitted_properties == 2 and got[2].submit_ticks == 0 and "sender_name" not in got[2].generated
    assert {"sender_name", "sender_address"} <= set(got[3].generated) and "subject" not in got[3].generated
    r = "store_id bigint, seq bigint, message_id bigint, recipient_type int, display_name string, email_address string, address_type string"
    rr = spark.createDataFrame([(1, 1, 1, 1, None, "e", "SMTP"), (1, 2, 1, 2, "", "e", "smtp"), (1, 3, 1, 9, "d", "e", None), (1, 4, 1, 3, None, None, None)], r)
    assert sorted((x.seq, x.display_name, x.derived) for x in C.repaired_recipients(rr).collect()) == [(1, "e", "recipient_display_name"), (2, "", "recipient_display_name")]
    assert C.partial_by_recipients(rr).first().partial


FOLDERS = "store_id bigint, source_id bigint, address_json string, name string, folder_key string"


def test_paths_by_address(spark):
    deep = list(range(100, 170))
    rows = [
        (1, 290, "[]", "Root", "k0"), (1, S.IPM_SUBTREE, "[0]", "Top", "k1"), (1, 9, "[0,1]", "", "k2"), (1, 10, "[0, 1, 2]", "Deep", "k3"), (1, 13, "[0,1,2]", "Twin", "k6"),
        (1, 11, "[3,1]", "Lost", "k4"), (1, 12, "nonsense", "X", "k5"), (1, 34, "[5]", "Views", "k7"), (1, 35, "[6]", "Odd", "k8"), (1, S.SEARCH_ROOT, "[8]", "Search", "k9"),
        (1, 66, "[0,7]", "Bin", "m0"), (1, S.DELETED_ITEMS, "[0,4]", "Bin", "m1"), (1, S.DELETED_ITEMS, "[0,1,9]", "Not direct", "m2"), (1, S.DELETED_ITEMS, "[5,4]", "At root", "m3"),
        (2, S.IPM_SUBTREE, "[0,1]", "Not below the root", "k1"), (2, 2, "[0]", "A", "k0"),
        *((3, 1000 + k, str(deep[: k + 1]), f"n{k}", f"k{k}") for k in range(70)),
    ]
    f = spark.createDataFrame(rows, FOLDERS).withColumn("address", C.parsed_address())
    got = {(r.store_id, tuple(r.address)): (r.location, r.folder_path, r.error) for r in C.paths_by_address(f).collect()}
    ipm, root, bad = "ipm_subtree", "store_root", "invalid folder hierarchy"
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {
        (0, 1): (ipm, ["Recovered Folder 9"], None), (0, 1, 2): (ipm, ["Recovered Folder 9", "Twin"], None), (0, 1, 9): (ipm, ["Recovered Folder 9", "Not direct"], None), (0, 4): (ipm, ["Bin"], None), (0, 7): (ipm, ["Bin"], None),
        (3, 1): (root, None, bad), (5,): (root, ["Views"], None), (5, 4): (root, ["Views", "At root"], None), (6,): (root, ["Odd"], None), (8,): (root, ["Search"], None),
    }
    assert got[2, (0, 1)] == (root, ["A", "Not below the root"], None)
    assert got[3, tuple(deep[:64])][2] is None and len(got[3, tuple(deep[:64])][1]) == 64 and got[3, tuple(deep[:65])] == (root, None, bad)
    assert [(r.store_id, list(r.address)) for r in C.deleted_items(f).collect()] == [(1, [0, 4])]
    s = {(r.location, tuple(r.folder_path)): (r.source_id, r.role, r.omitted) for r in C.folder_set(f).where("store_id = 1").collect()}
    assert s == {
        (ipm, ("Recovered Folder 9",)): (9, "ordinary", 0), (ipm, ("Recovered Folder 9", "Twin")): (10, "ordinary", 1), (ipm, ("Recovered Folder 9", "Not direct")): (S.DELETED_ITEMS, "ordinary", 0),
        (ipm, ("Bin",)): (S.DELETED_ITEMS, "deleted_items", 1), (root, ("Views",)): (34, "ordinary", 0), (root, ("Views", "At root")): (S.DELETED_ITEMS, "ordinary", 0),
    }
    assert C.folder_set(f.limit(0)).count() == C.paths_by_address(f.limit(0)).count() == 0


def test_paths_by_parent(spark):
    rows = [(1, 1, None, "Root", []), (1, S.IPM_SUBTREE, 1, "Top", [0]), (1, 9, S.IPM_SUBTREE, "A", [0, 1]), (1, 10, 9, "", None), (1, 20, 99, "B", None), (1, 30, 31, "C", None), (1, 31, 30, "D", None), (1, 32, 31, "E", None)]
    rows += [(2, k, k - 1 if k else None, f"n{k}", None) for k in range(66)]
    f = spark.createDataFrame(rows, "store_id bigint, source_id bigint, parent_source_id bigint, name string, address array<int>")
    paths = C.paths_by_parent(f)
    got = {(r.store_id, r.source_id): (r.folder_path, r.error) for r in paths.collect()}
    bad = (None, "invalid folder hierarchy")
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {1: ([], None), S.IPM_SUBTREE: ([], None), 9: (["A"], None), 10: (["A", "Recovered Folder 10"], None), 20: (["Recovered Folder 99", "B"], None), 30: bad, 31: bad, 32: bad}
    assert len(got[2, 63][0]) == 64 and got[2, 64] == bad and got[2, 65] == bad
    m = spark.createDataFrame([(1, 1, None, "orphan"), (1, 2, 1, "normal"), (1, 3, 10, "normal"), (1, 4, 77, "normal"), (1, 5, 30, "normal"), (3, 6, 9, "fragment")], "store_id bigint, seq bigint, folder_id bigint, provenance string")
    filed = {r.seq: (r.folder_path, r.error) for r in C.filed(m, paths).collect()}
    assert filed == {1: (["Orphan Mail"], None), 2: (["Unfiled Mail"], None), 3: (["A", "Recovered Folder 10"], None), 4: (["Recovered Folder 77"], None), 5: bad, 6: (["Recovered Folder 9"], None)}


def test_display_names(spark):
    m = spark.createDataFrame([(1, "D", "S"), (2, "", "S"), (3, None, "S"), (4, None, ""), (5, "", None)], "seq bigint, display_name string, subject string")
    assert {r.seq: (r.display_name, r.how) for r in C.display_names(m).collect()} == {1: ("D", "kept"), 2: ("S", "derived"), 3: ("S", "derived"), 4: ("(no subject)", "generated"), 5: ("(no subject)", "generated")}


def test_rejection_counts(spark):
    c = spark.createDataFrame([(1, k, s) for k, s in (("a", "unsupported"), ("b", "unsupported"), ("c", "unsupported"), ("d", "spooled"), ("e", "spooled"), ("f", "unsupported"))], "store_id bigint, item_key string, status string")
    e = spark.createDataFrame([(1, "a", "output_unrepresentable", '{"category": "x"}'), (1, "b", "output_unrepresentable", "{}"), (1, "b", "output_unrepresentable", "{}"), (1, "d", "output_unrepresentable", "{}"), (1, "e", "recipient", None), (1, "f", "output_unrepresentable", "no json")], "store_id bigint, item_key string, kind string, metadata_json string")
    got = {(r.rule, r.category): r.n for r in L.rejection_counts(c, e).collect()}
    assert got == {("counted", "x"): 1, ("counted", "-"): 1, ("several events", "-"): 1, ("no event", "-"): 1, ("not rejected", "-"): 1}


def test_long_chains_are_an_error_and_cycles_end(spark):
    edges = spark.createDataFrame([(1, f"n{k + 1}", f"n{k}") for k in range(4)] + [(1, "n1", "n0")], "store_id bigint, k string, parent string")
    seeds = spark.createDataFrame([(1, "n0")], "store_id bigint, k string")
    assert {r.k: r.depth for r in R.descend(seeds, edges, ["store_id", "k"]).collect()} == {f"n{k}": k for k in range(5)}
    with pytest.raises(ValueError):
        R.descend(seeds, edges, ["store_id", "k"], most=3)


def test_prefix_join(spark):
    mails = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "m int, folder_path array<string>")
    fol = spark.createDataFrame([("f", ["a"]), ("g", ["a", "b"]), ("h", ["b"])], "n string, folder_path array<string>")
    assert sorted((r.m, r.n) for r in L.prefix_join(mails, fol).collect()) == [(1, "f"), (1, "g")]
    assert itertools
