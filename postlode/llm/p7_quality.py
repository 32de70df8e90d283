"""Problem 7: text statistics, and texts that are mostly not prose.

p7_found trains boosted trees on the statistics of a sample of the corpus: pure texts with a weak label and texts put together from
them. The sample is bounded by TRAIN_ROWS and drawn by a hash of the id; statistics and probabilities are taken of every text.
p7_text_statistics has the five statistics asked for as built-in expressions, over the texts as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlode.llm import holdout, quality as Q
from postlode.session import spread, table

#: About how many texts the classifier is trained on, whatever the corpus; they are those whose id has the least hashes.
TRAIN_ROWS = 2_000
#: Tasks that prepare them.
TRAIN_TASKS = 16

_OUT = pa.schema([("doc_id", pa.int64())] + [(n, pa.float64()) for n in [*Q.NAMES, "probability"]])


def _calibrates(text: str) -> bool:
    return hashlib.md5(text.encode()).digest()[0] % 2 == 0


def held_out(calibrating: bool) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, labels) of the hand-checked texts of one half."""
    of = [(t, y) for y, texts in ((0.0, holdout.CHECKED_PROSE), (1.0, holdout.CHECKED_JUNK)) for t in texts if _calibrates(t) == calibrating]
    return np.array([Q.statistics(t) for t, _ in of]), np.array([y for _, y in of])


def trained(documents: DataFrame, rows: int = TRAIN_ROWS) -> Q.Boosted:
    """Trees over examples() of about ``rows`` documents and of the seed texts, calibrated on half of the hand-checked ones. Texts that
    are among those are no examples."""
    share = min(1.0, rows / max(1, documents.count()))
    sample = documents.where(F.col("text").isNotNull()).where(F.xxhash64("doc_id") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    checked = {*holdout.CHECKED_PROSE, *holdout.CHECKED_JUNK}
    schema = pa.schema([("label", pa.float64()), ("statistics", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has rows / TRAIN_TASKS texts; their order decides what is put together
        texts = sorted(t for b in batches for t in b.column(0).to_pylist() if t not in checked)
        found = Q.examples(texts)
        yield pa.RecordBatch.from_arrays([pa.array([y for _, y in found], pa.float64()), pa.array([s for s, _ in found], pa.list_(pa.float64()))], schema=schema)

    got = sample.repartition(TRAIN_TASKS, F.xxhash64("doc_id", F.lit(7))).select("text").mapInArrow(run, "label double, statistics array<double>").toPandas()  # at most two rows a text
    every = Q.examples([*holdout.SEED_PROSE, *holdout.SEED_JUNK]) + sorted(zip(map(list, got["statistics"]), got["label"], strict=True))
    return Q.Boosted().fit(np.array([s for s, _ in every])[:, 1:], np.array([y for _, y in every])).calibrate(*_seen(held_out(True)))


def _seen(of: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return of[0][:, 1:], of[1]


def scored(documents: DataFrame, model: Q.Boosted | None = None) -> DataFrame:
    """(doc_id, NAMES, probability) of every document; probability is that of being mostly not prose. Statistics of a null text are
    null, as is the probability of a null or blank one."""
    shared = documents.sparkSession.sparkContext.broadcast(model or trained(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [None] * len(Q.NAMES)
        for b in batches:
            rows = [Q.statistics(t, lang) or nothing for t, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            x = np.array(rows, float).reshape(len(rows), len(Q.NAMES))
            seen = (x != 0).any(axis=1) & ~np.isnan(x[:, 0])
            p = np.full(len(rows), np.nan)
            if seen.any():
                p[seen] = shared.value.probability(x[seen, 1:])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64(), from_pandas=True) for c in (*x.T, p))], schema=_OUT)

    return spread(documents.select("doc_id", "text", "lang"), "doc_id").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} double" for n in [*Q.NAMES, "probability"]))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return scored(table(spark, sf, "documents")).where("probability > 0.5").select("doc_id")


def held_out_report(spark: SparkSession, sf: str) -> DataFrame:
    """One row: how a classifier trained on the corpus does on the hand-checked texts that neither trained nor calibrated it: texts,
    right ones, and the mean difference between probability and label (the calibration error, as all labels are 0 or 1)."""
    x, y = _seen(held_out(False))
    p = trained(table(spark, sf, "documents")).probability(x)
    return spark.createDataFrame([(len(y), int(((p > 0.5) == (y > 0.5)).sum()), float(np.abs(p - y).mean()))], "texts bigint, correct bigint, calibration_error double")


# --- the five statistics as expressions -----------------------------------------------------------------------------------

_LETTERS = r"[\p{L}\p{N}]+"
_BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}]"
_LINE_END = r"\r\n|\r|\n"
_PUNCTUATED = r"[.!?:;…。！？][\"'”’»)\]]*[\s\p{Z}\p{Cc}\p{Cf}]*$"


def text_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, mean_word_length, symbol_ratio, punct_line_share, common_word_share): zeros for a blank text, null for null.
    Common words are those of the language that lang names, else those of the language that has most."""
    t = F.col("text")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    words = spread(documents.select("doc_id", "text", "lang"), "doc_id").select(
        "doc_id", F.lower(F.substring("lang", 1, 2)).alias("lang"), F.regexp_extract_all(F.lower(t), F.lit(_LETTERS), F.lit(0)).alias("w"),
        F.length(F.regexp_replace(t, _BLANK, "")).alias("visible"), F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")).alias("letters"),
        count(rf"[^{_BLANK[1:]}[^\r\n]*").alias("lines"), count(_PUNCTUATED.replace("$", "(?:[\r\n]|$)").replace(_BLANK, rf"[{_BLANK}&&[^\r\n]]")).alias("ended"),
    )
    of = lambda v: F.size(F.filter("w", lambda w: w.isin(*v.split())))
    hits = {k: of(v) for k, v in Q.COMMON.items()}
    common: Column = F.greatest(*hits.values())
    for k, h in hits.items():
        common = F.when(F.col("lang") == k, h).otherwise(common)
    letters, n = F.col("letters"), F.size("w")
    share = lambda part, whole: F.when(F.col("w").isNotNull(), F.when(whole > 0, part / whole).otherwise(0.0))
    return words.select(
        "doc_id", F.when(F.col("w").isNotNull(), n).cast("bigint").alias("n_words"), share(letters, n).alias("mean_word_length"), share(F.col("visible") - letters, F.col("visible")).alias("symbol_ratio"),
        share(F.col("ended"), F.col("lines")).alias("punct_line_share"), share(common, n).alias("common_word_share"),
    )


def _statistics_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    hit = lambda words: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in words.split())})))"
    by_lang = " ".join(f"WHEN '{k}' THEN {hit(v)}" for k, v in Q.COMMON.items())
    return rf"""WITH t AS (
      SELECT doc_id, lower(lang[1:2]) AS lang, regexp_extract_all(lower(text), '{_LETTERS}') AS w, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS visible,
        list_filter(string_split_regex(text, '{_LINE_END}'), lambda x: regexp_matches(x, '[^{_BLANK[1:]}')) AS lines FROM documents),
    c AS (SELECT *, list_sum(list_transform(w, lambda x: length(x))) AS letters, CASE lang {by_lang} ELSE greatest({', '.join(map(hit, Q.COMMON.values()))}) END AS common FROM t)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CASE WHEN len(w) > 0 THEN letters / len(w) WHEN w IS NOT NULL THEN 0.0 END AS mean_word_length,
      CASE WHEN visible > 0 THEN (visible - coalesce(letters, 0)) / visible WHEN w IS NOT NULL THEN 0.0 END AS symbol_ratio,
      CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '{quoted(_PUNCTUATED)}'))) / len(lines) WHEN w IS NOT NULL THEN 0.0 END AS punct_line_share,
      CASE WHEN len(w) > 0 THEN common / len(w) WHEN w IS NOT NULL THEN 0.0 END AS common_word_share FROM c"""


QUERIES = {"p7_found": found, "p7_text_statistics": lambda spark, sf: text_statistics(table(spark, sf, "documents")), "p7_held_out": held_out_report}
SQL = {"p7_text_statistics": _statistics_sql()}
