"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session that this library makes itself; a given session is taken as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "300",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, over which conf takes precedence (dots in its keys written as two underscores)."""
    builder = SparkSession.builder.appName("postlode").config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors share. Only where that is unset, as in tests on one
    machine, a temporary one is made, which goes when the process ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="postlode-checkpoint-", dir=os.environ.get("TMPDIR"))
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as a Parquet table and read back: as checkpointed(), but by columns and compressed, which takes far
    less room where texts such as paths repeat."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that is dear per row; unchanged where the scan already gives
    that many, as it does for any large input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(2 * cores, key)
