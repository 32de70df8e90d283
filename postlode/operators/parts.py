"""Parts of stores, published once: intents, data, and a manifest that makes a part count.

A part is (store_id, part_index). Publishing first writes the intents (what each part shall hold), then the data in the order of the
parts' keys, then the manifest, whose rows are taken from the data as it lies there. A part counts if the manifest has it; whatever a
crash leaves before that is data nobody reads, and ``reconcile`` finishes or leaves it. All of it is written and read by Spark, below a
folder that all executors share, so nothing is renamed and the driver touches no file.

A publication may have hundreds of thousands of small parts, so parts share files: the rows of one lie together in one file, and readers
of few parts skip the others by the statistics in the files. Files that lie below folders of a part's keys, as earlier publications
have them, belong to that part.

Defined results for odd input
-----------------------------
* A part that is published already is not published again (FileExistsError). Items of a part without a row in parts are refused (ValueError),
  as are parts without items.
* Items whose part_index is null are in no part. A second run of reconcile changes nothing. No publication yet reads as an empty manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.session import checkpointed

KEY = ["store_id", "part_index"]
_MANIFEST = "store_id bigint, part_index int, filename string, items bigint, oversize int, byte_len bigint, sha256 string, publication int"


def contents(data: DataFrame) -> DataFrame:
    """(KEY, items, byte_len, sha256) of parts' rows: a part's digest is over those of its rows as JSON text, in their order. A part has a
    limited size, so its digests fit a row."""
    text = F.to_json(F.struct(*sorted(c for c in data.columns if c not in KEY)))
    rows = data.select(*KEY, F.octet_length(text).alias("n"), F.sha2(text, 256).alias("h"))
    return rows.groupBy(*KEY).agg(F.count("*").alias("items"), F.sum("n").cast("bigint").alias("byte_len"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("sha256"))


@dataclass(frozen=True)
class Folder:
    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        try:
            return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing there yet
            return None

    def _data(self, below: str = "") -> DataFrame | None:
        """The items below the data folder, with the number of their publication."""
        try:  # no part's folder is looked for by Spark, which would list and hold all of them
            found = self.spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(f"{self.path}/data{below}")
        except AnalysisException:  # nothing there yet
            return None
        named = lambda key: F.regexp_extract(F.col("_metadata.file_path"), rf".*/{key}=(-?\d+)/", 1).try_cast("bigint")
        keys = {k: F.coalesce(F.col(k), named(k)) if k in found.columns else named(k) for k in KEY}
        rest = [c for c in found.columns if c not in KEY]
        return found.select(*(keys[k].cast(t).alias(k) for k, t in zip(KEY, ("bigint", "int"), strict=True)), *rest, named("publication").cast("int").alias("publication"))

    def manifest(self) -> DataFrame:
        """The published parts."""
        found = self._read("manifest", _MANIFEST)
        return self.spark.createDataFrame([], _MANIFEST) if found is None else found

    def read(self) -> DataFrame | None:
        """The items of the published parts; None without any."""
        data = self._data()
        return None if data is None else data.join(self.manifest().select(*KEY, "publication"), [*KEY, "publication"], "left_semi").drop("publication")

    def publish(self, items: DataFrame, parts: DataFrame) -> DataFrame:
        """Publishes parts (KEY, filename, items, oversize) with their items (KEY and columns); returns the manifest rows of this publication.
        Small parts share a task and a file, and all rows of one are written together."""
        held = items.where("part_index is not null")
        parts = checkpointed(parts.select("store_id", F.col("part_index").cast("int").alias("part_index"), "filename", F.col("items").cast("bigint").alias("items"), F.col("oversize").cast("int").alias("oversize")))
        taken = parts.join(self.manifest(), KEY, "left_semi").first()
        if taken:
            raise FileExistsError(f"already published: store {taken['store_id']}, {taken['filename']}")
        both = held.select(*KEY).distinct().withColumn("_held", F.lit(True)).join(parts.select(*KEY, F.lit(True).alias("_part")), KEY, "full")
        if not both.where("_held is null or _part is null").isEmpty():
            raise ValueError("items and parts do not belong together")
        begun = self._read("intents")
        number = 1 + ((begun.agg(F.max("publication")).first()[0] or 0) if begun is not None else 0)
        parts.write.parquet(f"{self.path}/intents/publication={number}")
        held.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(f"{self.path}/data/publication={number}")
        self.reconcile()
        return self.manifest().where(F.col("publication") == number)

    def reconcile(self) -> list[int]:
        """Gives each begun publication whose parts all lie there whole its manifest; returns their numbers. One whose data is not there, or
        holds other items than intended, stays unpublished, as do parts that another publication has by now."""
        begun = self._read("intents")
        if begun is None:
            return []
        done = self.manifest().select("publication").distinct()
        # as many numbers as publications were begun and not finished, which is none but after a crash
        numbers = [r["publication"] for r in begun.select("publication").distinct().join(done, "publication", "left_anti").orderBy("publication").collect()]
        finished = []
        for n in numbers:
            data = self._data(f"/publication={n}")
            if data is None:
                continue
            intents = self._read(f"intents/publication={n}")
            there = contents(data.drop("publication"))
            rows = checkpointed(intents.join(there.withColumnRenamed("items", "found"), KEY, "left"))
            if rows.where("not (items <=> found)").isEmpty() and rows.join(self.manifest(), KEY, "left_semi").isEmpty():
                rows.select(*KEY, "filename", "items", "oversize", "byte_len", "sha256").write.mode("overwrite").parquet(f"{self.path}/manifest/publication={n}")
                finished.append(n)
        return finished

    def damaged(self) -> DataFrame:
        """(KEY, rule) of published parts whose data is no longer what the manifest says, read again: missing, or other in a figure."""
        data = self.read()
        m = self.manifest()
        there = m.limit(0).select(*KEY, "items", "byte_len", "sha256") if data is None else contents(data)
        return differing(m, there, KEY, ["items", "byte_len", "sha256"])


def differing(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, rule) of rows that two frames with one row a key don't have alike: ``missing`` where the right has none, ``surplus`` where the
    left has none, else the names of the columns that differ, in their order, joined by commas. Nulls are equal."""
    a = left.select(*keys, F.struct(*columns).alias("a"))
    j = a.join(right.select(*keys, F.struct(*columns).alias("b")), keys, "full")
    names = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    rule = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "surplus").otherwise(F.array_join(names, ","))
    return j.select(*keys, rule.alias("rule")).where("rule <> ''")


def committed(candidates: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, refused): items of published parts turn their spooled candidate to written. Refused are items (KEY, item_key, rule) that
    name no candidate, one that is not spooled, or one that several do, as exactly one row has to change for each; those change
    nothing. candidates: store_id, item_key, status; items: KEY, item_key."""
    named = items.groupBy("store_id", "item_key").agg(F.count("*").alias("_n"), F.min("part_index").alias("part_index"))
    there = candidates.groupBy("store_id", "item_key").agg(F.count("*").alias("_c"), F.max("status").alias("_s"))
    judged = checkpointed(named.join(there, ["store_id", "item_key"], "left").withColumn("rule", F.when(F.col("_c").isNull(), "no candidate").when(F.col("_n") > 1, "in several places").when(F.col("_c") > 1, "several candidates").when(F.col("_s") != "spooled", "not spooled")))
    good = judged.where("rule is null").select("store_id", "item_key", F.lit(True).alias("_w"))
    after = candidates.join(good, ["store_id", "item_key"], "left").withColumn("status", F.when(F.col("_w"), "written").otherwise(F.col("status"))).drop("_w")
    return after.select(*candidates.columns), judged.where("rule is not null").select(*KEY, "item_key", "rule")
