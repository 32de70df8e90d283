import pytest

from postlode.operators import parts as P

ITEM, PART = "store_id bigint, part_index int, item_key string, subject string", "store_id bigint, part_index int, filename string, items bigint, oversize int"


def frames(spark, stores=(1, 2), first=1):
    items = [(s, first + k // 2, f"{s}:{k}", f"é{k}") for s in stores for k in range(4)]
    parts = [(s, first + p, f"part-{first + p:04}", 2, 0) for s in stores for p in (0, 1)]
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(parts, PART)


def test_two_stores_keep_their_parts_apart(spark, tmp_path):
    folder = P.Folder(spark, str(tmp_path / "out"))
    assert folder.manifest().count() == 0 and folder.read() is None and folder.reconcile() == []
    m = {(r.store_id, r.part_index): r for r in folder.publish(*frames(spark)).collect()}
    assert {k: r["items"] for k, r in m.items()} == {(s, p): 2 for s in (1, 2) for p in (1, 2)} and len({r.sha256 for r in m.values()}) == 4
    held = {(r.store_id, r.part_index): r.n for r in folder.read().groupBy("store_id", "part_index").agg({"item_key": "count"}).toDF("store_id", "part_index", "n").collect()}
    assert held == {k: 2 for k in m} and all(r.item_key.startswith(f"{r.store_id}:") for r in folder.read().collect())
    with pytest.raises(FileExistsError):
        folder.publish(*frames(spark, stores=(2,)))
    assert folder.publish(*frames(spark, stores=(2,), first=3)).count() == 2 and folder.damaged().count() == 0


def test_items_and_parts_must_belong_together(spark, tmp_path):
    folder, (items, parts) = P.Folder(spark, str(tmp_path / "out")), frames(spark)
    for a, b in ((items, parts.where("part_index = 1")), (items.where("store_id = 1"), parts)):
        with pytest.raises(ValueError):
            folder.publish(a, b)
    assert folder.manifest().count() == 0


def test_a_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    folder, (items, parts) = P.Folder(spark, str(tmp_path / "out")), frames(spark)
    monkeypatch.setattr(P.Folder, "reconcile", lambda self: [])
    folder.publish(items, parts)
    monkeypatch.undo()
    assert folder.manifest().count() == 0 and folder.read().count() == 0
    assert folder.reconcile() == [1] and folder.reconcile() == [] and folder.manifest().count() == 4 and folder.read().count() == 8
    # a crash within the data: it does not count, and the parts can be published anew
    parts = frames(spark, first=5)[1]
    parts.write.parquet(str(tmp_path / "out/intents/publication=2"))
    items = frames(spark, first=5)[0]
    items.where("item_key <> '1:0'").write.partitionBy("store_id", "part_index").parquet(str(tmp_path / "out/data/publication=2"))
    assert folder.reconcile() == [] and folder.read().count() == 8
    assert folder.publish(items, parts).count() == 4 and folder.read().count() == 16 and folder.reconcile() == []


def test_damage_is_found(spark, tmp_path):
    folder = P.Folder(spark, str(tmp_path / "out"))
    folder.publish(*frames(spark))
    spark.createDataFrame([("x", "y")], "item_key string, subject string").write.mode("append").parquet(str(tmp_path / "out/data/publication=1/store_id=2/part_index=1"))
    assert [tuple(r) for r in folder.damaged().collect()] == [(2, 1, "items,byte_len,sha256")]


def test_small_parts_share_files(spark, tmp_path):
    folder, n = P.Folder(spark, str(tmp_path / "out")), 300
    items = spark.createDataFrame([(s, p, f"{s}:{p}:{k}", None) for s in (-1, 2) for p in range(n) for k in range(2)], ITEM)
    parts = spark.createDataFrame([(s, p, f"part-{p:04}", 2, 0) for s in (-1, 2) for p in range(n)], PART)
    assert folder.publish(items, parts).where("items = 2").count() == 2 * n and folder.damaged().isEmpty()
    files = list((tmp_path / "out/data").rglob("*.parquet"))
    assert len(files) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = folder.read()
    assert sorted(map(tuple, held.select(*items.columns).collect())) == sorted(map(tuple, items.collect()))
    # a part that loses a row, and one that loses all of them
    kept = held.where("item_key not in ('2:7:0', '-1:9:0', '-1:9:1')").drop("publication").toPandas()
    spark.createDataFrame(kept, items.schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "out/data/publication=1"))
    assert sorted(map(tuple, folder.damaged().collect())) == [(-1, 9, "missing"), (2, 7, "items,byte_len,sha256")]


def test_publications_in_folders_of_their_parts_are_read_beside_others(spark, tmp_path):
    folder, (items, parts) = P.Folder(spark, str(tmp_path / "out")), frames(spark)
    parts.write.parquet(str(tmp_path / "out/intents/publication=1"))
    items.write.partitionBy("store_id", "part_index").parquet(str(tmp_path / "out/data/publication=1"))
    assert folder.reconcile() == [1] and folder.publish(*frames(spark, first=3)).count() == 4
    assert folder.read().select(*items.columns).exceptAll(items.unionByName(frames(spark, first=3)[0])).isEmpty() and folder.read().count() == 16 and folder.damaged().isEmpty()


def test_commit_changes_one_row_an_item(spark):
    c = spark.createDataFrame([(1, "a", "spooled"), (1, "b", "written"), (1, "c", "spooled"), (1, "c", "spooled"), (1, "d", "spooled"), (2, "a", "spooled")], "store_id bigint, item_key string, status string")
    items = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, "c"), (1, 1, "x"), (1, 1, "d"), (1, 2, "d")], "store_id bigint, part_index int, item_key string")
    after, refused = P.committed(c, items)
    assert sorted(map(tuple, after.collect())) == [(1, "a", "written"), (1, "b", "written"), (1, "c", "spooled"), (1, "c", "spooled"), (1, "d", "spooled"), (2, "a", "spooled")]
    assert {r.item_key: r.rule for r in refused.collect()} == {"b": "not spooled", "c": "several candidates", "x": "no candidate", "d": "in several places"}
