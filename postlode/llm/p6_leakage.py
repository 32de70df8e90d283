"""Problem 6: evaluation texts in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.llm import leakage as L
from postlode.session import table


def found(spark: SparkSession, sf: str) -> DataFrame:
    return L.leaks(spark, table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each item with the number of documents it leaked into; items that didn't leak have 0."""
    items = table(spark, sf, "eval_items")
    n = L.leaks(spark, table(spark, sf, "documents"), items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "benchmark_name").join(n, "item_id", "left").select("item_id", "benchmark_name", F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"))


QUERIES = {"p6_found": found, "p6_leaked_items": leaked_items}
SQL: dict[str, str] = {}
