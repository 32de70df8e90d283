"""The ledger as a stream: rows become candidates batch by batch, idempotent under replay; deduplication and gaps as state.

The row identity (store_id, seq) makes every step replayable: a batch that runs again, or a row that is delivered again, changes
nothing. Failed tasks commit nothing, as files of a batch are written under its id and replaced whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

_IDENTITY = ["store_id", "seq"]


def rows_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_ledger(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends distinct rows under out/batch_id=N. Rows that an earlier batch holds are dropped by an anti-join on the identity."""

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(_IDENTITY)
        if number:
            before = spark.read.schema(batch.schema.add("batch_id", "long")).parquet(out).where(F.col("batch_id") < number).select(*_IDENTITY)
            fresh = fresh.join(before, _IDENTITY, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(rows: DataFrame, late: str = "10 days") -> DataFrame:
    """Rows once per identity within the watermark of observed_at; state older than that is let go."""
    return rows.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(_IDENTITY)


def daily_counts(rows: DataFrame, late: str | None = "10 days") -> DataFrame:
    """Rows per provenance and day of observed_at, complete once the watermark has passed the day. late None keeps the watermark that
    the rows have, such as that of deduplicated()."""
    return (rows.withWatermark("observed_at", late) if late else rows).groupBy(F.window("observed_at", "1 day").alias("w"), "provenance").agg(F.count("*").alias("rows")).select(F.col("w.start").alias("day"), "provenance", "rows")


def latest_per_record(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each record whose newest seq rises in a batch, that seq and whether it is present, by state per record."""
    schema = ", ".join(f"{k} bigint" for k in keys) + ", seq bigint, present boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest, gone = state.get if state.exists else (-1, False)
        before = newest
        for f in frames:
            at = f["seq"].idxmax()
            if f["seq"][at] > newest:
                newest, gone = int(f["seq"][at]), bool(f["removed"][at] is True or f["removed"][at] == 1)
        state.update((newest, gone))
        if newest != before:
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "seq": [newest], "present": [not gone]})

    return rows.select(*keys, "seq", F.coalesce("removed", F.lit(False)).alias("removed")).groupBy(*keys).applyInPandasWithState(step, schema, "seq bigint, gone boolean", "update", "NoTimeout")


def isolated(units: DataFrame, failures: DataFrame, most: int = 3) -> DataFrame:
    """Units to run: those that failed fewer than most times."""
    return units.join(failures.where(F.col("failures") >= most).select("unit_json"), "unit_json", "left_anti")


def unmatched_payloads(streams: DataFrame, payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state of registered payload streams and payloads that don't meet: missing or unregistered."""
    return streams.select(*keys, F.lit(1).alias("_s")).join(payloads.select(*keys, F.lit(1).alias("_p")), keys, "full").where("_s is null or _p is null").select(*keys, F.when(F.col("_s").isNull(), "unregistered").otherwise("missing").alias("state"))


def unit_brackets(events: DataFrame) -> DataFrame:
    """(store_id, unit, rule) where unit_start and unit_end events aren't in pairs: more starts than ends at any seq but one open."""
    from pyspark.sql import Window as W

    e = events.where("kind in ('unit_start', 'unit_end')").withColumn("open", F.sum(F.when(F.col("kind") == "unit_start", 1).otherwise(-1)).over(W.partitionBy("store_id", "unit").orderBy("seq")))
    last = e.groupBy("store_id", "unit").agg(F.max("open").alias("most"), F.min("open").alias("least"), F.max_by("open", "seq").alias("final"))
    rule = F.when(F.col("most") > 1, "nested").when(F.col("least") < 0, "end without start").when(F.col("final") != 0, "not ended")
    return last.select("store_id", "unit", rule.alias("rule")).where("rule is not null")
