import datetime as dt
import os

import pytest

from postlode.operators import ledger as L, packing as P, reports as R
from postlode.streaming import ledger_stream as S

ROWS = "store_id bigint, seq bigint, observed_at timestamp, provenance string, source_id bigint, removed boolean"
ITEMS = "store_id bigint, seq bigint, provenance string, source_node_id bigint, recovery_index bigint, occurrence int, location string, folder_path array<string>, payload_bytes bigint"


def test_sizes_keys_names(tmp_path):
    assert [R.parse_byte_size(x) for x in ("5", "4GiB", " 2 kb ", "1TB")] == [5, 4 << 30, 2000, 10**12]
    for bad in ("", "0", "-1", "4 XB", "1.5GB"):
        with pytest.raises(ValueError):
            R.parse_byte_size(bad)
    key = lambda **k: R.record_key(**({"tag": b"t", "source_sha256": "00" * 32, "mode": "balanced", "form": b"f", "most_bytes": 1, "part_index": 1} | k))
    assert len(key()) == 32 and key() != key(part_index=2) != key(most_bytes=2)
    with pytest.raises(ValueError):
        key(mode="odd")
    assert R.predicted_bytes(10, 15, 10) == 15 and R.predicted_bytes(10, 1, 3) == 4 and R.predicted_bytes(7, 1, 0) == 7
    assert R.batch_bytes(64 << 20, 0) == 4 << 20 and R.batch_bytes(64 << 20, 61 << 20) == 256 << 10
    assert R.safe_leaf("a.pst") and not any(map(R.safe_leaf, ("", ".", "..", "a/b", "a\\b")))


def test_snapshots_and_sources(tmp_path):
    path = str(tmp_path / "r.json")
    R.snapshot({"a": 1}, path)
    assert R.read_snapshot(path) == {"a": 1}
    before = R.source_identity(path, digest=True)
    assert R.unchanged(before)
    with open(path, "a") as f:
        f.write(" ")
    assert not R.unchanged(before)
    with pytest.raises(ValueError):
        R.read_snapshot(path)
    with pytest.raises(ValueError):
        R.snapshot({"a": "x" * 100}, path, most=50)
    os.symlink(path, tmp_path / "link")
    with pytest.raises(ValueError):
        R.source_identity(str(tmp_path / "link"))


def items(spark):
    return P.with_ranks(spark.createDataFrame([(1, k, "normal", k, None, 0, "store_root", ["a", "b"], 50) for k in range(6)], ITEMS))


def test_reports(spark):
    c = spark.createDataFrame([("written", "complete", "normal"), ("unsupported", "damaged", "orphan"), ("spooled", "complete", "normal")], "status string, completeness string, provenance string")
    summary = L.job_summary(c)
    parts = P.parts_table(P.pack(items(spark), 2 << 20))
    r = R.split_report(summary, parts).first()
    assert (r.committed, r.unfinished, r.normal_items, r.parts, r.clean_data) == (3, 1, 2, 1, False)
    done = L.job_summary(c.limit(1))
    one = lambda **k: R.split_report(done, parts, **k).first()
    assert one().clean_data and not any(one(**{k: v}).clean_data for k, v in (("source_unchanged", False), ("interrupted", True), ("terminal_failure", True)))
    assert not one(issues=spark.createDataFrame([(0, 2)], "issues bigint, issues_dropped bigint")).clean_data
    lost = one(omitted=spark.createDataFrame([("properties", 3), ("properties", 4), ("folders", 0)], "kind string, n bigint"))
    assert (lost.omitted_properties, lost.omitted_folders, lost.omitted_attachments, lost.clean_data) == (7, 0, 0, False)
    j = R.as_json(summary, "recover").first()
    assert j.json.startswith('{"kind":"recover","schema_version":1,"total":3')
    log = R.recovery_log({"committed": 3000}, [{"filename": f"part-{k:04}", "items": 1, "estimate_bytes": 5, "oversize": k == 1} for k in range(5)], detail=2)
    assert "3,000" in log and "part-0001  items 1  estimate 5  oversize" in log and "and 3 more parts" in log
    assert L.job_summary(c.limit(0)).first().total == 0
    blobs = spark.createDataFrame([("ab", 1), ("cd", 2)], "sha256 string, byte_len bigint")
    data = spark.createDataFrame([("ab", bytearray(b"x"))], "sha256 string, data binary")
    assert {x.sha256: x.state for x in R.verified_blobs(blobs, data).collect()} == {"ab": "wrong bytes", "cd": "missing"}


def rows(spark, n, base=0):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(1, base + k, t + dt.timedelta(hours=k), "normal" if k % 3 else "orphan", k % 5, k % 7 == 0) for k in range(n)], ROWS)


def test_streaming_ledger_survives_replay(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for k in range(3):
        rows(spark, 20, 10 * k).coalesce(1).write.mode("append").parquet(src)  # batches overlap
        S.write_ledger(S.rows_stream(spark, src, ROWS, 1), out, ck).awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == first.select("store_id", "seq").distinct().count() == 40
    # started again from nothing with the same files, it writes the same
    import shutil

    shutil.rmtree(ck)
    S.write_ledger(S.rows_stream(spark, src, ROWS, 1), out, ck).awaitTermination()
    assert spark.read.parquet(out).select("store_id", "seq").distinct().count() == spark.read.parquet(out).count() == 40


def test_streaming_state(spark, tmp_path):
    src = str(tmp_path / "src")
    rows(spark, 30).unionByName(rows(spark, 30)).repartition(3).write.parquet(src)
    stream = lambda: S.rows_stream(spark, src, ROWS, 1)

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert len(run(S.deduplicated(stream()), "append", "once")) == 30
    days = run(S.daily_counts(S.deduplicated(stream(), "1 hour"), None), "append", "days")
    assert sum(r.rows for r in days) >= 24
    latest = {}
    for r in run(S.latest_per_record(stream(), ["store_id", "source_id"]), "update", "latest"):
        latest[r.source_id] = max(latest.get(r.source_id, (-1, None)), (r.seq, r.present))
    assert latest == {k: (25 + k, (25 + k) % 7 != 0) for k in range(5)}


def test_units_and_payloads(spark):
    e = spark.createDataFrame([(1, "a", "unit_start", 1), (1, "a", "unit_end", 2), (1, "b", "unit_start", 3), (1, "c", "unit_end", 4), (1, "d", "unit_start", 5), (1, "d", "unit_start", 6)], "store_id bigint, unit string, kind string, seq bigint")
    assert sorted((r.unit, r.rule) for r in S.unit_brackets(e).collect()) == [("b", "not ended"), ("c", "end without start"), ("d", "nested")]
    u = spark.createDataFrame([("x",), ("y",)], "unit_json string")
    assert [r.unit_json for r in S.isolated(u, spark.createDataFrame([("x", 3), ("y", 2)], "unit_json string, failures int")).collect()] == ["y"]
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "id int")
    assert sorted((r.id, r.state) for r in S.unmatched_payloads(k(1, 2), k(2, 3), ["id"]).collect()) == [(1, "missing"), (3, "unregistered")]
