"""Filling containers of fixed capacity with texts: first-fit decreasing over a tournament tree of what bins have left.

Texts are measured in tokens of a public tokenizer, once. A text longer than the container is cut into full pieces, each of which
fills a container, and a rest; nothing else is cut. The items of a container size are spread over groups by a seeded hash, about
``group_items`` to a group, so groups are bounded and alike whatever the corpus, and each is packed on its own: items by falling
size, each into the first bin with room, which the tree finds in the logarithm of the number of bins. A group leaves at most a
few bins half empty, which is little beside the thousands it fills.

Defined results for odd input
-----------------------------
* Null and blank texts (white space only) and rows with a null id need no container. A repeated row counts once; of several texts
  with one id the greatest is taken.
* A text exactly as long as the container is one full piece. Equal sizes are taken in the order of id and piece.
* Containers with a null kind or a null or non-positive capacity are left out. Further columns are ignored. Empty tables give an
  empty result. A text of any length is measured whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlode.session import checkpointed, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's vocabulary expects a text to be split before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GROUP_ITEMS = 20_000
#: Container sizes are a small table of settings; more rows than this are refused.
MOST_SIZES = 1_000


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("texts", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a text, as a whole; an error of the tokenizer ends the job."""
    return len(_encoder(path).encode_ordinary(text))


def measured(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every text that isn't null or blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count_tokens(t, path) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    # \S in the JVM knows ASCII only; Unicode white space counts as blank too
    return spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S")).select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


class Tournament:
    """First bin with at least so much room. Bins are leaves of a binary tree whose inner nodes hold the most room below them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts an item into the first bin with room: (bin, room it had)."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        at, left = node - self.leaves, had - size
        room[node] = left
        node //= 2
        while node:
            a, b = room[2 * node], room[2 * node + 1]
            most = a if a > b else b
            if room[node] == most:
                break
            room[node] = most
            node //= 2
        return at, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each item, sizes being in falling order and none over capacity."""
    tree = Tournament(len(sizes), capacity)
    out = []
    for size in sizes:
        at, had = tree.place(size)
        out.append((at, capacity - had))
    return out


def packed(documents: DataFrame, sizes: DataFrame, path: str = TOKENIZER, group_items: int = GROUP_ITEMS, seed: int = 11) -> DataFrame:
    """One row for each text or piece of each container size: container_kind, capacity_tokens, group_no, container_no (within its
    group), doc_id, piece_no, token_from (within the text), token_count, place (its first token's position in the container)."""
    settings = sizes.where("container_kind is not null and capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).distinct().limit(MOST_SIZES + 1).collect()
    if len(settings) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} container sizes")
    tokens = checkpointed(measured(documents, path))
    empty = tokens.limit(0).select(F.lit("").alias("container_kind"), F.lit(0).cast("bigint").alias("capacity_tokens"), "doc_id", "tokens")
    kinds = F.explode(F.array(*(F.struct(F.lit(s["container_kind"]).alias("container_kind"), F.lit(s["capacity_tokens"]).cast("bigint").alias("capacity_tokens")) for s in settings))) if settings else None
    items = tokens.select("doc_id", "tokens", kinds.alias("k")).select("k.*", "doc_id", "tokens") if settings else empty
    cap = F.col("capacity_tokens")
    # groups by the number of pieces, which for small containers and long texts is far above that of texts
    counted = items.groupBy("container_kind", "capacity_tokens").agg(F.sum(F.ceil(F.col("tokens") / cap)).alias("n")).collect()
    groups = F.lit(1)
    for r in counted:
        groups = F.when((F.col("container_kind") == r["container_kind"]) & (cap == r["capacity_tokens"]), max(1, -(-int(r["n"]) // group_items))).otherwise(groups)
    last = F.ceil(F.col("tokens") / cap).cast("bigint") - 1
    pieces = (
        items.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("group_no", F.pmod(F.xxhash64("doc_id", "piece_no", "container_kind", F.lit(seed)), groups).cast("int"))
        .select("container_kind", "capacity_tokens", "group_no", "doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * cap).alias("token_from"), F.least(cap, F.col("tokens") - F.col("piece_no") * cap).alias("token_count"))
    )
    return pieces.groupBy("container_kind", "capacity_tokens", "group_no").applyInArrow(_pack, "container_kind string, capacity_tokens bigint, group_no int, container_no bigint, doc_id bigint, piece_no int, token_from bigint, token_count bigint, place bigint")


def _pack(group: pa.Table) -> pa.Table:
    group = group.sort_by([("token_count", "descending"), ("doc_id", "ascending"), ("piece_no", "ascending")])
    capacity = group["capacity_tokens"][0].as_py()
    spots = first_fit_decreasing(group["token_count"].to_pylist(), capacity)
    columns = [group["container_kind"], group["capacity_tokens"], group["group_no"], pa.array([b for b, _ in spots], pa.int64()), group["doc_id"], group["piece_no"], group["token_from"], group["token_count"], pa.array([p for _, p in spots], pa.int64())]
    return pa.table(columns, names=["container_kind", "capacity_tokens", "group_no", "container_no", "doc_id", "piece_no", "token_from", "token_count", "place"])


def filling(pack: DataFrame) -> DataFrame:
    """Per container size: containers, items, tokens, the least number of containers that could hold them, and the share filled."""
    bins = pack.groupBy("container_kind", "capacity_tokens", "group_no", "container_no").agg(F.sum("token_count").alias("t"), F.count("*").alias("i"))
    return bins.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("i").alias("items"),
        F.sum("t").alias("tokens"),
        F.ceil(F.sum("t") / F.first("capacity_tokens")).alias("least_containers"),
        (F.sum("t") / (F.count("*") * F.first("capacity_tokens"))).alias("filled"),
    )
