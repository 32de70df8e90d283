"""Ordered greedy packing into parts: the longest ordered prefix that fits, then the next; an item that can't fit alone is a part of
its own, marked oversize.

The rule is sequential, the plan is not. Items are ranged in order and get a position and running sums of bytes and of newly
entered folder prefixes. For a part from item i, the estimate before item j is a constant plus F(j) - G(i) with monotone F, so the
first item beyond the limit is found for all i at once by merging F with the thresholds in ranges. That gives each item a pointer
to the start of the part after it; the starts reachable from position 0 are collected by pointer doubling, in as many rounds as
the logarithm of the number of parts, and items are assigned to parts by an equi-join on blocks of positions. No step holds a
store in one task or on the driver.

Defined results for odd input
-----------------------------
* Null paths count as the root (no prefixes), null payloads as 0 bytes. Order ties are broken by all of the key; repeated keys are
  returned by ``duplicate_keys`` and packed like any others.
* An empty table gives an empty result. Further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postlode.schema import PROVENANCE, rank
from postlode.session import checkpointed

_BLOCK = 4096


@dataclass(frozen=True)
class LinearEstimate:
    """Bytes of a part: fixed, plus payload and per_item for each item, plus per_prefix for each distinct folder prefix."""

    fixed: int = 1 << 20
    per_item: int = 64 << 10
    per_prefix: int = 16 << 10


ORDERS = {
    "canonical": ["location_rank", "folder_path", "provenance_rank", "source_node_id", "recovery_index", "occurrence"],
    "placement": ["location_rank", "folder_path", "placement_rank", "provenance_rank", "source_node_id", "recovery_index", "occurrence"],
    "traversal": ["seq"],
}


def with_ranks(items: DataFrame) -> DataFrame:
    """Adds the rank columns the orders need, where their source column is there."""
    out = items.withColumn("provenance_rank", rank("provenance", PROVENANCE))
    if "location" in items.columns:
        out = out.withColumn("location_rank", rank("location", ["store_root", "ipm_subtree"]))
    if "placement" in items.columns:
        out = out.withColumn("placement_rank", rank("placement", ["normal", "associated"]))
    return out


def duplicate_keys(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).count().where("count > 1")


def positioned(items: DataFrame, group: str, order: list[str], sums: dict[str, Column], lagged: list[str] | None = None) -> DataFrame:
    """Adds pos (0, 1, ... within the group by order) and, for each of sums, its running total before the row. A sum may refer to
    previous, a struct of the lagged columns of the row before in the group (null for the first).

    Rows are ranged over partitions; each partition's totals are one row, and only those rows are added up along the order.
    """
    n = max(2, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = checkpointed(items.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    local = W.partitionBy(group, "_part").orderBy("_at")
    across = W.partitionBy(group).orderBy("_part")
    to_before = (W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    if lagged:
        last = rows.groupBy(group, "_part").agg(F.max_by(F.struct(*lagged), "_at").alias("_last"))
        rows = rows.withColumn("_mine", F.lag(F.struct(*lagged)).over(local)).join(last.select(group, "_part", F.lag("_last").over(across).alias("_theirs")), [group, "_part"]).withColumn("previous", F.coalesce("_mine", "_theirs")).drop("_mine", "_theirs")
    rows = rows.withColumns({f"_v_{k}": v.cast("bigint") for k, v in sums.items()})
    totals = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), *(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    before = totals.select(group, "_part", F.coalesce(F.sum("_n").over(across.rowsBetween(*to_before)), zero).alias("_n0"), *(F.coalesce(F.sum(f"_t_{k}").over(across.rowsBetween(*to_before)), zero).alias(f"_b_{k}") for k in sums))
    inner = rows.withColumns({"pos": F.count("*").over(local.rowsBetween(*to_before)), **{f"before_{k}": F.coalesce(F.sum(f"_v_{k}").over(local.rowsBetween(*to_before)), zero) for k in sums}})
    return inner.join(before, [group, "_part"]).withColumns({"pos": F.col("pos") + F.col("_n0"), **{f"before_{k}": F.col(f"before_{k}") + F.col(f"_b_{k}") for k in sums}}).drop("_part", "_at", "_n0", "previous", *(f"_b_{k}" for k in sums))


def pack(items: DataFrame, limit: int, order: str = "canonical", estimate: LinearEstimate = LinearEstimate(), group: str = "store_id", path: str = "folder_path", payload: str = "payload_bytes") -> DataFrame:  # noqa: B008
    """items with pos, part_index (from 1 within the group) and oversize (1 or 0)."""
    keys = ORDERS[order]
    depth = F.greatest(F.coalesce(F.size(path), F.lit(0)), F.lit(0))
    located = items if "location_rank" in items.columns else items.withColumn("location_rank", F.lit(0))
    # prefixes an item enters are those it doesn't share with the item before; a folder of the other location is another folder
    same = F.expr(f"size(filter(sequence(1, greatest(size({path}), 1)), i -> i <= size({path}) and slice({path}, 1, i) = slice(previous.{path}, 1, i)))")
    entered = F.when(F.col(f"previous.{path}").isNull() | F.col(path).isNull() | (F.col("previous.location_rank") != F.col("location_rank")), depth).otherwise(depth - same)
    if order == "traversal":
        entered = F.lit(0)  # folders recur in any order there; the estimate leaves them out
    per = estimate.per_prefix if order != "traversal" else 0
    ranged = positioned(located, group, keys, {"bytes": F.coalesce(F.col(payload), F.lit(0)) + estimate.per_item, "entered": entered}, [path, "location_rank"]).withColumnRenamed("_v_entered", "_entered")
    # after item j the estimate is fixed + F(j) - G(i); F counts bytes and prefixes up to j, G those before i less the ones i brings itself
    value = F.col("before_bytes") + F.coalesce(F.col(payload), F.lit(0)) + estimate.per_item + per * (F.col("before_entered") + F.col("_entered"))
    start = F.col("before_bytes") + per * (F.col("before_entered") + F.col("_entered") - depth)
    rows = checkpointed(ranged.withColumns({"_f": value, "_g": start + (limit - estimate.fixed)}))
    nxt = _first_beyond(rows, group)
    starts = _chain(nxt, group)
    ends = starts.select(group, (F.col("part_index") - 1).alias("part_index"), F.col("pos").alias("stop"))
    spans = starts.join(ends, [group, "part_index"], "left").withColumn("oversize", (F.col("_f") > F.col("_g")).cast("int"))
    last = rows.groupBy(group).agg(F.max("pos").alias("_last"))
    blocks = spans.join(last, group).withColumn("stop", F.coalesce("stop", F.col("_last") + 1)).withColumn("_block", F.explode(F.sequence((F.col("pos") / _BLOCK).cast("bigint"), ((F.col("stop") - 1) / _BLOCK).cast("bigint"))))
    blocks = blocks.select(group, "_block", F.col("pos").alias("_start"), "stop", "part_index", "oversize")
    out = rows.withColumn("_block", (F.col("pos") / _BLOCK).cast("bigint")).join(blocks, [group, "_block"]).where("pos >= _start and pos < stop")
    return out.select(*items.columns, "pos", "part_index", "oversize")


def _first_beyond(rows: DataFrame, group: str) -> DataFrame:
    """(group, pos, nxt, _f, _g): the first position whose _f is above the row's _g, but not before pos + 1; the end without one.

    Both values are cut into about as many ranges as there are partitions; a range's own values are searched in a window of that
    range, and for thresholds above all of them the first value of the ranges after it counts.
    """
    bounds = rows.groupBy(group).agg(F.min("_f").alias("_lo"), (F.max("_f") + 1).alias("_hi"), F.count("*").alias("_n"))
    marked = rows.join(bounds, group)
    cut = lambda v: F.least(F.greatest(F.floor((v - F.col("_lo")) * F.ceil(F.col("_n") / 20_000) / (F.col("_hi") - F.col("_lo"))), F.lit(-1)), F.ceil(F.col("_n") / 20_000)).cast("bigint")
    values = marked.select(group, cut(F.col("_f")).alias("_r"), F.col("_f").alias("_x"), F.lit(1).alias("_kind"), F.col("pos").alias("_value_pos"), "pos")
    asks = marked.select(group, cut(F.col("_g")).alias("_r"), F.col("_g").alias("_x"), F.lit(2).alias("_kind"), F.lit(None).cast("bigint").alias("_value_pos"), "pos")
    # values equal to a threshold aren't beyond it. Falling order makes what lies ahead a running minimum, each row being seen once
    ahead = W.partitionBy(group, "_r").orderBy(F.desc("_x"), F.desc("_kind"), F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    inside = values.unionByName(asks).withColumn("_near", F.min("_value_pos").over(ahead)).where("_kind = 2")
    # what lies in the ranges after one's own is a minimum over them from the end; there are about n / 20,000 ranges to a group
    per_range = values.unionByName(asks).groupBy(group, "_r").agg(F.min("_value_pos").alias("_m"))
    later = per_range.select(group, "_r", F.min("_m").over(W.partitionBy(group).orderBy("_r").rowsBetween(1, W.unboundedFollowing)).alias("_far"))
    hit = inside.join(later, [group, "_r"], "left").select(group, "pos", F.coalesce("_near", "_far").alias("_hit"))
    return rows.select(group, "pos", "_f", "_g").join(hit, [group, "pos"]).select(group, "pos", F.when(F.col("_hit").isNotNull(), F.greatest(F.col("_hit"), F.col("pos") + 1)).alias("nxt"), "_f", "_g")


def _chain(pointers: DataFrame, group: str) -> DataFrame:
    """(group, pos, part_index, _f, _g) of the positions reached from 0, numbered from 1."""
    pointers = checkpointed(pointers)
    jump = pointers.where("nxt is not null").select(group, "pos", "nxt")
    reached = pointers.where("pos = 0").select(group, "pos", F.lit(1).alias("part_index"))
    size = 1
    known = 0
    while True:
        more = reached.join(jump, [group, "pos"]).select(group, F.col("nxt").alias("pos"), (F.col("part_index") + size).alias("part_index"))
        # the last position a pointer may lead to is beyond the end
        grown = checkpointed(reached.unionByName(more))
        if (now := grown.count()) == known:
            break
        reached, size, known = grown, 2 * size, now
        far = jump.select(group, F.col("pos").alias("nxt"), F.col("nxt").alias("then"))
        jump = checkpointed(jump.join(far, [group, "nxt"]).select(group, "pos", F.col("then").alias("nxt")))
    return reached.join(pointers.select(group, "pos", "_f", "_g"), [group, "pos"])


def pack_local(items: Sequence, limit: int, estimate: Callable[[Sequence], int]) -> list[tuple[list, bool]]:
    """The same rule over an ordered list with any estimate of a whole part: (items, oversize) of each part."""
    out: list[tuple[list, bool]] = []
    part: list = []
    for item in items:
        if part and estimate([*part, item]) > limit:
            out.append((part, estimate(part) > limit))
            part = []
        part.append(item)
    return [*out, (part, estimate(part) > limit)] if part else out


def parts_table(packed: DataFrame, estimate: LinearEstimate = LinearEstimate(), group: str = "store_id", path: str = "folder_path", payload: str = "payload_bytes") -> DataFrame:  # noqa: B008
    """(group, part_index, filename, items, oversize, prefixes, estimate_bytes) of pack()'s result."""
    from postlode.operators.ledger import folder_prefixes

    base = packed.groupBy(group, "part_index").agg(F.count("*").alias("items"), F.max("oversize").alias("oversize"), F.coalesce(F.sum(payload), F.lit(0)).alias("payload_bytes"))
    prefixes = packed.select(group, "part_index", "location" if "location" in packed.columns else F.lit("").alias("location"), path).distinct().select(group, "part_index", "location", F.explode(folder_prefixes(path)).alias("p")).distinct().groupBy(group, "part_index").agg(F.count("*").alias("prefixes"))
    zero = F.lit(0).cast("bigint")
    return base.join(prefixes, [group, "part_index"], "left").select(
        group,
        "part_index",
        F.format_string("part-%04d", "part_index").alias("filename"),
        "items",
        "oversize",
        "payload_bytes",
        F.coalesce("prefixes", zero).alias("prefixes"),
        (F.lit(estimate.fixed) + F.col("payload_bytes") + F.col("items") * estimate.per_item + F.coalesce("prefixes", zero) * estimate.per_prefix).alias("estimate_bytes"),
    )
