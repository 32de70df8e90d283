import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from postlode.operators import references as R

AT = dt.datetime(2025, 1, 2, 3)
F = "store_id bigint, seq bigint, observed_at timestamp, source_id bigint, removed boolean, store_ID2 string"
M = "store_id bigint, seq bigint, observed_at timestamp, message_id bigint, folder_id bigint, parent_message_id bigint, parent_attachment_index int, removed boolean"
A = "store_id bigint, seq bigint, observed_at timestamp, message_id bigint, attachment_index int, removed boolean"


def frames(spark, f, m, a):
    return spark.createDataFrame(f, F), spark.createDataFrame(m, M), spark.createDataFrame(a, A)


def found(state):
    return sorted((r.store_id, r.seq, r.field) for r in R.orphan_references(state).collect())


FOLDERS = [(1, 1, AT, 10, False, "x"), (1, 1, AT, 10, False, "x"), (1, 2, AT, 11, None, None), (1, 9, AT, 11, True, None), (2, 1, AT, 12, False, None), (1, None, AT, 99, False, None)]
MESSAGES = [
    (1, 3, AT, 100, 10, None, None, False),  # folder is there
    (1, 4, AT, 101, 11, None, None, False),  # folder was removed later
    (1, 5, AT, 102, 12, 100, 0, False),  # folder is in another store; parent there, slot removed
    (1, 5, AT, 102, 12, 100, 0, False),  # delivered again
    (1, 6, AT, 103, None, 999, 1, True),  # nothing there, and itself removed
    (1, 7, AT, 104, 0, None, 5, None),  # folder 0; index without parent is no reference
    (1, 8, AT, None, None, None, None, None),
    (None, 3, AT, 100, 77, None, None, False),
    (1, 12, AT, 105, 20, 100, 1, False),  # folder arrives later, slot there
]
ATTACHMENTS = [(1, 10, AT, 100, 0, False), (1, 11, AT, 100, 0, True), (1, 13, AT, 100, 1, None), (1, 14, AT, None, 1, None)]
LATE = [(1, 20, AT, 20, False, None)]
WANT = [(1, 4, "folder_id"), (1, 5, "folder_id"), (1, 5, "parent_attachment_index"), (1, 6, "parent_attachment_index"), (1, 6, "parent_message_id"), (1, 7, "folder_id")]


def test_orphans(spark):
    state = R.initial(*frames(spark, FOLDERS + LATE, MESSAGES, ATTACHMENTS))
    assert found(state) == WANT
    report = {(r.field, r.referenced_table): (r.orphan_refs, r.missing_records) for r in R.orphan_report(state).collect()}
    assert report == {("folder_id", "folders"): (3, 3), ("parent_message_id", "messages"): (1, 1), ("parent_attachment_index", "attachments"): (2, 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_give_the_same(spark, seed, tmp_path):
    rnd = random.Random(seed)
    rows = [("f", x) for x in FOLDERS + LATE] + [("m", x) for x in MESSAGES] + [("a", x) for x in ATTACHMENTS]
    rnd.shuffle(rows)
    batches = [rows[:9], rows[9:16], rows[16:] + rows[:3]]  # the first three come again
    part = lambda b, k: [x for n, x in b if n == k]
    history = R.History(spark, str(tmp_path))
    for b in batches:
        history.apply(*frames(spark, *(part(b, k) for k in "fma")))
    state = history.state()
    assert found(state) == WANT
    whole = R.initial(*frames(spark, FOLDERS + LATE, MESSAGES, ATTACHMENTS))
    assert sorted(map(tuple, state.counts.where("refs <> 0 or existing <> 0").collect())) == sorted(map(tuple, whole.counts.where("refs <> 0 or existing <> 0").collect()))


def test_empty(spark):
    assert found(R.initial(*frames(spark, [], [], []))) == []


def test_a_hot_key_is_reported_whole(spark):
    m = [(1, k, AT, k, 5, None, None, False) for k in range(3000)]
    assert len(found(R.initial(*frames(spark, [], m, [])))) == 3000
    assert isinstance(R.orphan_keys(R.initial(*frames(spark, [], m, []))).first().refs, int) and T


def test_a_history_is_folded_and_a_failed_batch_does_not_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "MOST_BATCHES", 1)
    history = R.History(spark, str(tmp_path))
    history.apply(*frames(spark, FOLDERS, [], []))
    assert found(history.state()) == [] and len(history.batches) == 1
    real = R.History._write

    def broken(self, parts):
        real(self, parts)
        raise OSError("lost")

    monkeypatch.setattr(R.History, "_write", broken)
    with pytest.raises(OSError):
        history.apply(*frames(spark, LATE, MESSAGES, ATTACHMENTS))
    monkeypatch.setattr(R.History, "_write", real)
    assert found(history.state()) == []
    history.apply(*frames(spark, LATE, MESSAGES, ATTACHMENTS))
    assert found(history.state()) == WANT and len(history.batches) == 1
    removed = [(1, 50, AT, 10, True, None)]
    history.apply(*frames(spark, removed, [], []))  # the folder of row 3 goes
    assert found(history.state()) == sorted([*WANT, (1, 3, "folder_id")])
