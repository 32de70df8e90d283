"""Problem 5: texts in containers of fixed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlode.llm import packing as K
from postlode.session import table


def packing(spark: SparkSession, sf: str) -> DataFrame:
    return K.packed(table(spark, sf, "documents"), table(spark, sf, "container_sizes"))


def filling(spark: SparkSession, sf: str) -> DataFrame:
    return K.filling(packing(spark, sf))


QUERIES = {"p5_packing": packing, "p5_filling": filling}
SQL: dict[str, str] = {}
