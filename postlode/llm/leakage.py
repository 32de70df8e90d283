"""Evaluation texts leaking into a corpus: a prefix-filtered set join with exact verification.

A document holds a leak of an item's text if both have WINDOW consecutive words in common. Each window of the item's text is a
set of shingles, all of which such a document must hold; so of each window only one shingle, the rarest in the corpus, has to be
looked for (the necessary prefix of the set, ordered by rarity). A document that holds it gives an alignment of the item's
window, which must lie wholly within the document (length and positional bounds), and whose words are then compared one by one.
The result therefore is exact.

Each document is read once. Its shingles are tested against a Bloom filter of the items' shingles, of fixed size, which gives their
counts over all documents (the rarity) and the runs of consecutive hits long enough for a window. Only runs go on: their shingles are
joined with the prefixes, and the words around each match are compared by built-in expressions. The plan is the same at every size.

Defined results for odd input
-----------------------------
* Words are runs of letters and digits after NFKC, case folding and removal of format characters; tags in angle brackets and all
  else separate words. Whole texts are searched.
* Null, empty and blank texts, and texts of fewer than WINDOW words, leak nothing. Rows with a null id are left out.
* Items whose words are equal leak together. A repeated document or item row gives its pairs once. Further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlode.llm import bloom
from postlode.session import checkpointed, spread

WINDOW = 12
SHINGLE = 4
#: Shingles of consecutive places that a window has.
SPAN = WINDOW - SHINGLE + 1
#: Words whose hashes, and counts of shingles, that a task holds at most; and words of runs it sends at once.
HELD, AT_ONCE = 500_000, 50_000

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")


@cache
def _format_characters() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") + "]")


def words(text: str | None) -> list[str]:
    """The words of a text as compared: see the module's docstring."""
    if not text:
        return []
    if not text.isascii():
        text = _format_characters().sub("", unicodedata.normalize("NFKC", text)).casefold()
    else:
        text = text.lower()
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text)


class Hashes:
    """64-bit hashes of the shingles of a list of words. Words are hashed once; shingles are combined from them in numpy."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, w: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > HELD:
            known.clear()
        for x in set(w).difference(known):
            known[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
        each = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        out = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            out = (out ^ each[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out


def item_texts(items: DataFrame) -> DataFrame:
    """(item_id, body): the passage and the question of each item."""
    return items.where("item_id is not null").select("item_id", F.explode(F.array("passage", "question")).alias("body")).where("body is not null")


_WORDED = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string())), ("h", pa.list_(pa.int64()))])


def worded(texts: DataFrame) -> DataFrame:
    """(text_id, words, h, items): each distinct list of words of at least WINDOW among item texts, the hashes of its shingles and the
    items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            rows = [(i, w, hashes(w).view(np.int64)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(w := words(t)) >= WINDOW]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_WORDED)], schema=_WORDED)

    rows = texts.select("item_id", "body").mapInArrow(run, "item_id bigint, words array<string>, h array<bigint>")
    return rows.groupBy("words", "h").agg(F.collect_set("item_id").alias("items")).withColumn("text_id", F.xxhash64("words"))


_READ = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string())), ("h", pa.int64()), ("n", pa.int64())])


def read(documents: DataFrame, wanted: np.ndarray) -> DataFrame:
    """What the documents have of the shingles that pass the filter ``wanted``, in rows of two kinds: (doc_id, words) of each run of words
    whose shingles all pass, of at least WINDOW words; and (h, n), in how many documents of a task a shingle occurs."""
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Hashes(), Counter()

        def counted() -> pa.RecordBatch:
            rows = list(counts.items())
            counts.clear()
            nothing = pa.nulls(len(rows))
            return pa.RecordBatch.from_arrays([nothing.cast(pa.int64()), nothing.cast(_READ[1].type), pa.array([h for h, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], schema=_READ)

        def sent(runs: list) -> pa.RecordBatch:
            nothing = pa.nulls(len(runs)).cast(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in runs], pa.int64()), pa.array([w for _, w in runs], _READ[1].type), nothing, nothing], schema=_READ)

        for b in batches:
            runs, size = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                if len(w) < WINDOW:
                    continue
                h = hashes(w)
                hit = bloom.passes(shared.value, h)
                if not hit.any():
                    continue
                counts.update(np.unique(h[hit]).view(np.int64).tolist())
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if end - start >= SPAN:
                        runs.append((doc, w[start : end + SHINGLE - 1]))
                        size += end - start
                if size > AT_ONCE:
                    yield sent(runs)
                    runs, size = [], 0
                if len(counts) > HELD:
                    yield counted()
            yield sent(runs)
        yield counted()

    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return spread(texts, "doc_id").mapInArrow(run, "doc_id bigint, words array<string>, h bigint, n bigint")


def prefixes(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(text_id, offset, shingle) of worded() texts so that each window of a text holds one of its shingles at that offset: of each
    window the one that is rarest by counts (h, n), the first of equals."""
    each = items.select("text_id", F.posexplode("h").alias("offset", "h")).join(counts, "h", "left").select("text_id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset").alias("s"))
    # one row per item text; an item text is a bounded passage, not a corpus
    per_text = each.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("s.offset", "s.n"))).alias("s"))
    least = F.expr(f"array_distinct(transform(sequence(0, size(s) - {SPAN}), j -> array_min(transform(slice(s, j + 1, {SPAN}), x -> struct(x.n as n, x.offset as offset))).offset))")
    return per_text.select("text_id", F.explode(least).alias("offset")).join(items.select("text_id", "words"), "text_id").select("text_id", "offset", _shingle("words", F.col("offset")).alias("shingle"))


def _shingle(words: str, at) -> F.Column:
    return F.array_join(F.slice(words, at + 1, SHINGLE), " ")


def leaks(spark: SparkSession, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds WINDOW consecutive words of the item's passage or question."""
    texts = checkpointed(worded(item_texts(items)))
    seen = checkpointed(read(documents, bloom.built(texts.select(F.explode("h").alias("h")), "h")))
    prefix = prefixes(texts, seen.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")))
    runs = seen.where("words is not null").select("doc_id", "words").withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)))
    # what a window around a shingle can reach: so many words before it and after its first
    before, after = F.least(F.lit(WINDOW - SHINGLE), F.col("at")), F.least(F.lit(WINDOW), F.size("words") - F.col("at"))
    around = runs.select("doc_id", _shingle("words", F.col("at")).alias("shingle"), F.slice("words", F.col("at") - before + 1, before + after).alias("near"), before.alias("before"))
    # a document often repeats itself, and a shingle that is in very many documents is the rarest of a window only if all are
    met = around.distinct().join(prefix, "shingle").join(texts.select("text_id", F.col("words").alias("item"), "items"), "text_id")
    first = F.greatest(-F.col("before"), -F.col("offset"))
    last = F.least(F.size("near") - F.col("before"), F.size("item") - F.col("offset")) - 1
    same = F.transform(F.sequence(first, last), lambda d: F.when(F.get("near", F.col("before") + d) == F.get("item", F.col("offset") + d), "1").otherwise("0"))
    return met.where(F.array_join(same, "").contains("1" * WINDOW)).select("doc_id", F.explode("items").alias("item_id")).distinct()
