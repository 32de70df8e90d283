"""References to records that do not exist.

Every key that is referred to or has a record carries two signed counts: how many emitted rows refer to it, and whether a
record is there. Both are maintained from change deltas: a reference adds +1, a record that appears adds +1 to the existence of
its key, one that is removed adds -1. Keys with positive references and no existence are the orphan report.

A state that is kept over many batches (History) is a log: each batch appends its new reference rows, the newest row of each record it
changes and its deltas, in buckets by key, and rewrites nothing. To tell what is new it reads the buckets its keys fall into. Counts
are sums over the log; after ``MOST_BATCHES`` batches it is folded into one.

Records of all tables share the row identity (store_id, seq). The row with the largest seq speaks for a record.

Defined results for odd input
-----------------------------
* A null reference is none; 0 is an ordinary key. ``removed`` null means not removed.
* Rows whose store_id or seq is null have no identity and are left out, as are records with a null key.
* A row delivered again (same store_id and seq) counts once, also over batches.
* Empty tables give an empty state; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlode.session import checkpointed

#: A key: the store, the table its record is in, and one or two ids (key_b is -1 where the table has one id).
KEY = ["store_id", "target", "key_a", "key_b"]

FIELDS = {"folder_id": "folders", "parent_message_id": "messages", "parent_attachment_index": "attachments"}


@dataclass(frozen=True)
class State:
    """rows: one per reference of an emitted row; records: newest row of each record; counts: the signed counts of each key."""

    rows: DataFrame
    records: DataFrame
    counts: DataFrame


def _key(target: str, a: Column, b: Column | None = None) -> list[Column]:
    return [
        F.lit(target).alias("target"),
        a.cast("bigint").alias("key_a"),
        (F.lit(-1) if b is None else b).cast("bigint").alias("key_b"),
    ]


def reference_rows(messages: DataFrame) -> DataFrame:
    """One row for each reference of each emitted message row: store_id, seq, observed_at, field and the key it names."""
    m = F.col
    refs = [
        F.struct(F.lit("folder_id").alias("field"), *_key("folders", m("folder_id"))),
        F.struct(F.lit("parent_message_id").alias("field"), *_key("messages", m("parent_message_id"))),
        F.struct(F.lit("parent_attachment_index").alias("field"), *_key("attachments", m("parent_message_id"), m("parent_attachment_index"))),
    ]
    return (
        messages.select("store_id", "seq", "observed_at", "folder_id", "parent_message_id", "parent_attachment_index")
        .where("store_id is not null and seq is not null and (folder_id is not null or parent_message_id is not null)")
        .dropDuplicates(["store_id", "seq"])
        .select("store_id", "seq", "observed_at", F.explode(F.array(*refs)).alias("r"))
        .select("store_id", "seq", "observed_at", "r.*")
        .where("key_a is not null and key_b is not null")
    )


def record_rows(folders: DataFrame, messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """The newest row of each record: its key, seq and whether it is present. Repeated rows fold into the same maximum."""
    c = F.col
    present = (~F.coalesce(c("removed"), F.lit(False))).cast("int").alias("present")
    parts = [
        folders.select("store_id", "seq", *_key("folders", c("source_id")), present),
        messages.select("store_id", "seq", *_key("messages", c("message_id")), present),
        attachments.select("store_id", "seq", *_key("attachments", c("message_id"), c("attachment_index")), present),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("store_id is not null and seq is not null and key_a is not null and key_b is not null")
    return _newest(rows)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max(F.struct("seq", "present")).alias("last")).select(*KEY, "last.seq", "last.present")


def _counts(rows: DataFrame, existence: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Sums of signed deltas by key. References are summed before they meet the rest, so a hot key leaves each task as one row."""
    deltas = (
        rows.groupBy(*KEY).agg(F.count("*").alias("refs")).withColumn("existing", F.lit(0).cast("bigint"))
        .unionByName(existence.select(*KEY, F.lit(0).cast("bigint").alias("refs"), F.col("delta").cast("bigint").alias("existing")))
    )
    if before is not None:
        deltas = before.unionByName(deltas)
    return deltas.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))


def initial(folders: DataFrame, messages: DataFrame, attachments: DataFrame) -> State:
    """The state after the first batch: every newest record is a delta of +1 if it is present, every reference one of +1."""
    rows, records = reference_rows(messages), record_rows(folders, messages, attachments)
    return State(rows, records, _counts(rows, records.where("present = 1").withColumn("delta", F.lit(1))))


#: Buckets of a history by key, and batches after which its log is folded.
BUCKETS, MOST_BATCHES = 16, 16


@dataclass
class History:
    """A state below a folder that all executors share: rows, records and deltas of each batch, in buckets. ``batches`` are those that
    count; whatever else is in the folder is left over from a batch that failed."""

    spark: SparkSession
    folder: str
    batches: list[int] = field(default_factory=list)
    written: int = 0

    def _read(self, name: str, schema: str, buckets: list[int] | None) -> DataFrame:
        found = None
        for b in self.batches:
            one = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/batch={b}/{name}")
            found = one if found is None else found.unionByName(one)
        if found is None:
            found = self.spark.createDataFrame([], f"{schema}, bucket int")
        return found if buckets is None else found.where(F.col("bucket").isin(buckets))

    def state(self, buckets: list[int] | None = None) -> State:
        """The state, or that part of it whose keys are in the buckets."""
        rows, records, deltas = (self._read(n, c, buckets) for n, c in _COLUMNS.items())
        return State(rows.drop("bucket"), _newest(records), deltas.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing")))

    def _write(self, parts: dict[str, DataFrame]) -> int:
        """Small buckets share a task, one with a hot key is split."""
        self.written += 1
        for name, part in parts.items():
            part.withColumn("bucket", _bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={self.written}/{name}")
        return self.written

    def apply(self, folders: DataFrame, messages: DataFrame, attachments: DataFrame) -> None:
        """Takes in a further batch, whatever order rows arrive in. A record's delta is its new minus its old presence, and only where the
        batch holds a row with a larger seq. The batch counts once all of it is written, so one that failed can be given again."""
        refs, batch = checkpointed(reference_rows(messages)), checkpointed(record_rows(folders, messages, attachments))
        touched = [r["b"] for r in refs.select(_bucket().alias("b")).union(batch.select(_bucket().alias("b"))).distinct().collect()]  # at most BUCKETS
        before = self.state(touched)
        # a row delivered again has the same keys, so that it is in the same buckets
        fresh = checkpointed(refs.join(before.rows.select("store_id", "seq", "field"), ["store_id", "seq", "field"], "left_anti"))
        old = before.records.select(*KEY, F.col("seq").alias("old_seq"), F.col("present").alias("old_present"))
        changed = checkpointed(batch.join(old, KEY, "left").where("old_seq is null or seq > old_seq").withColumn("delta", F.col("present") - F.coalesce("old_present", F.lit(0))))
        deltas = _counts(fresh, changed.where("delta <> 0")).where("refs <> 0 or existing <> 0")
        self.batches.append(self._write({"rows": fresh, "records": changed.select(*KEY, "seq", "present"), "deltas": deltas}))
        if len(self.batches) > MOST_BATCHES:
            whole = self.state()
            self.batches = [self._write({"rows": whole.rows, "records": whole.records, "deltas": whole.counts.where("refs <> 0 or existing <> 0")})]


_COLUMNS = {
    "rows": "store_id bigint, seq bigint, observed_at timestamp, field string, target string, key_a bigint, key_b bigint",
    "records": "store_id bigint, target string, key_a bigint, key_b bigint, seq bigint, present int",
    "deltas": "store_id bigint, target string, key_a bigint, key_b bigint, refs bigint, existing bigint",
}


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


def orphan_keys(state: State) -> DataFrame:
    """Keys that are referred to and have no record: KEY, refs."""
    return state.counts.where("refs > 0 and existing <= 0").select(*KEY, "refs")


def orphan_references(state: State, salts: int = 8) -> DataFrame:
    """The reference rows behind the orphan keys: store_id, seq, observed_at, field and key.

    A key may be named by a third of all rows. So the rows of a key are spread over ``salts`` tasks by their seq, and the orphan
    keys, which are one row each, are repeated for each of them.
    """
    keys = orphan_keys(state).select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = state.rows.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int"))
    return rows.join(keys, [*KEY, "salt"], "left_semi").drop("salt")


def orphan_report(state: State) -> DataFrame:
    """Orphan references per field, referenced table and day on which the referring row was observed."""
    return (
        orphan_references(state)
        .groupBy("field", F.col("target").alias("referenced_table"), F.to_date("observed_at").alias("day"))
        .agg(F.count("*").alias("orphan_refs"), F.countDistinct("store_id", "key_a", "key_b").alias("missing_records"))
    )
