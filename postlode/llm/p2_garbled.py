"""Problem 2: text garbled by a wrong character encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.llm import garbled as G
from postlode.session import table

KEYS = ["source_table", "store_id", "seq", "field"]
#: The fields that are searched.
FIELDS = {"messages": ("subject", "sender_name"), "recipients": ("display_name",), "attachments": ("filename",)}


def _values(spark: SparkSession, sf: str) -> DataFrame:
    """(KEYS, value) of all fields; each table is read once."""
    parts = []
    for name, fields in FIELDS.items():
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
        parts.append(table(spark, sf, name).select("store_id", "seq", pairs.alias("p")).select(F.lit(name).alias("source_table"), "store_id", "seq", "p.field", "p.value"))
    return reduce(DataFrame.unionByName, parts)


def found(spark: SparkSession, sf: str) -> DataFrame:
    return G.damaged(_values(spark, sf), KEYS).select(*KEYS)


def restored(spark: SparkSession, sf: str) -> DataFrame:
    return G.restored(G.damaged(_values(spark, sf), KEYS))


QUERIES = {"p2_found": found, "p2_restored": restored}
SQL: dict[str, str] = {}
