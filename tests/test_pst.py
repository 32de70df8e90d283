import pytest

from postlode.sources import pst
from tests import pst_encoder


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("pst")
    (d / "a.pst").write_bytes(pst_encoder.store())
    (d / "b.pst").write_bytes(pst_encoder.store(3, orphan=False))
    (d / "broken.pst").write_bytes(b"!BDN" + bytes(600))
    spark.dataSource.register(pst.PstDataSource)
    return d


def read(spark, folder, table, **options):
    return spark.read.format("pst").options(table=table, nodes_per_task="10", **options).load(str(folder))


def test_messages_round_trip(spark, folder):
    rows = read(spark, folder, "messages").collect()
    a = [r for r in rows if r.path.endswith("a.pst")]
    assert len(a) == 41 and len([r for r in rows if r.path.endswith("b.pst")]) == 4  # the embedded one included
    assert {r.subject for r in a} == {f"Größe {k}" for k in range(40)} | {"inner of Größe 0"}
    inner = next(r for r in a if r.subject.startswith("inner"))
    assert (inner.embedded_path, inner.parent_message_id, inner.parent_attachment_index) == ([0], 0x200004, 0)
    assert all(r.sender_email == "nola@mail.example" and r.submit_filetime == 131219220137411478 and r.supported for r in a)


def test_orphans_only_in_aggressive_mode(spark, folder):
    found = read(spark, folder, "messages", mode="aggressive").where("provenance = 'orphan'").collect()
    assert [(r.subject, r.message_id) for r in found] == [("orphan", 0x300004)]


def test_folders_recipients_attachments(spark, folder):
    f = {(r.path[-5:], r.name): r for r in read(spark, folder, "folders").collect()}
    assert f["a.pst", "Inbox"].parent_source_id == pst_encoder.ROOT and f["a.pst", "Root"].parent_source_id is None and f["a.pst", "Inbox"].contents == 40
    r = read(spark, folder, "recipients").where("message_id = 2097156 and path like '%a.pst'").orderBy("recipient_index").collect()
    assert [(x.recipient_type, x.display_name, x.email_address, x.address_type) for x in r] == [(1, "Ülrik", "u@mail.example", "SMTP"), (2, None, "v@mail.example", None)]
    a = read(spark, folder, "attachments", payload="prefix", prefix_bytes="5").where("path like '%a.pst'").orderBy("attachment_index").collect()
    assert [(x.attachment_type, x.filename, x.data_size and x.data_size > 100) for x in a] == [(5, "inner.msg", None), (1, "file.bin", True)]
    assert bytes(a[1].data) == b"%PDF-" and a[1].data_size == 20_005
    assert read(spark, folder, "attachments", payload="none").where("data is not null").count() == 0


def test_properties_stores_nodes_issues(spark, folder):
    p = read(spark, folder, "properties", payload="full").where("path like '%b.pst' and owner = 'message'").collect()
    assert {x.property_id for x in p} == {0x1A, 0x37, 0x39, 0xC1A, 0xC1F} and all(len(x.data) == x.byte_len for x in p)
    s = {r.path[-5:]: r for r in read(spark, folder, "stores").collect()}
    assert (s["a.pst"].display_name, s["a.pst"].format, s["a.pst"].messages) == ("Test store", "unicode64", 41)
    assert read(spark, folder, "nodes").where("node_type = 'normal_message' and path like '%a.pst'").count() == 41
    assert [r.path[-10:] for r in read(spark, folder, "issues").collect()] == ["broken.pst"]


def test_damage_is_an_issue_not_a_failure(spark, folder, tmp_path):
    data = bytearray(pst_encoder.store(5, orphan=False))
    at = data.index("Größe 3".encode("utf-16-le"))
    data[at] ^= 0xFF
    (tmp_path / "damaged.pst").write_bytes(data)
    assert read(spark, tmp_path, "messages").count() == 5  # four, and one embedded
    assert [r.detail for r in read(spark, tmp_path, "issues").collect() if "check" in r.detail]


def test_queue_and_named_properties(spark, folder):
    u = read(spark, folder, "updates").where("path like '%a.pst'").orderBy("position").collect()
    assert [(r.kind, r.first_nid, r.second_nid) for r in u] == [("message_added", 7, 8), (None, 5, 0)]
    p = read(spark, folder, "named_properties").where("path like '%a.pst'").orderBy("property_id").collect()
    assert [(r.property_id, r.property_set, r.number, r.name) for r in p] == [(0x8000, bytes(range(16)).hex(), 0x8501, None), (0x8001, "2903020000000000c000000000000046", None, "Keywords")]


def test_a_folder_that_cannot_be_read_is_an_issue(monkeypatch):
    data = bytearray(pst_encoder.store(5, orphan=False))
    data[data.index("Inbox".encode("utf-16-le"))] ^= 0xFF
    everything = range(1 << 32)
    scan = pst.Scan(pst.Store(bytes(data)), "p")
    assert [r[3] for r in scan.rows("folders", everything)] == ["Root"]
    assert [i[1] for i in scan.rows("issues", everything) if i[2].startswith("folder:")] == [pst_encoder.INBOX]
    scan = pst.Scan(pst.Store(pst_encoder.store(5, orphan=False)), "p")

    def broken(folder):
        raise pst.FormatError("no table")

    monkeypatch.setattr(scan, "listed", broken)
    assert list(scan.rows("messages", everything)) == []
    assert [i[1:] for i in scan.rows("issues", everything)] == [(pst_encoder.INBOX, "contents of the folder: no table; 5 messages from 0x0 on not listed")]


def test_ranges_come_from_inner_pages_and_cover_all_nodes():
    store = pst.Store(pst_encoder.store(200))
    whole = [n for n, *_ in store.nodes()]
    for step in (1, 10, 50, 10_000):
        cuts = [0, *store.cuts(step), 1 << 32]
        assert cuts == sorted(cuts)
        assert [n for a, b in zip(cuts, cuts[1:], strict=False) for n, *_ in store.nodes(range(a, b))] == whole
    read, page = [], store.page
    store.page = lambda at: read.append(at) or page(at)
    first = list(store.nodes(range(whole[0], whole[1])))
    assert len(first) == 1 and len(read) <= 3


def test_sizes_need_no_data():
    store = pst.Store(pst_encoder.store(2))
    blocks = [b for _, b, _, _ in store.nodes()]
    want = [sum(map(len, store.blocks(b))) for b in blocks]
    assert [store.data_size(b) for b in blocks] == want and store.data_size(0) == 0
