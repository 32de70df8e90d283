import random

import numpy as np
import pytest

from postlode.llm import bloom, leakage as L

DOC, ITEM = "doc_id bigint, text string, passage string", "item_id bigint, passage string, question string, text string"


def brute(docs, items):
    windows = {}
    for i, passage, question, *_ in items:
        for body in (passage, question):
            w = L.words(body)
            for k in range(len(w) - 11):
                windows.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, text, *_ in docs:
        w = L.words(text)
        for k in range(len(w) - 11):
            out |= {(d, i) for i in windows.get(tuple(w[k : k + 12]), ())}
    return {(d, i) for d, i in out if d is not None and i is not None}


@pytest.mark.parametrize("seed", [3, 4])
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("a b c d e f".split())  # noqa: E731  few words, so that shingles recur
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 40))), " ".join(word() for _ in range(rnd.randint(5, 16))), "t") for i in range(25)]
    items += [(100, items[0][1].upper(), None, None), (101, None, "", None), (102, "Ein Text, der zwölf Wörter hat: eins zwei drei vier fünf sechs sieben.", None, None), (None, items[1][1], None, None)]
    docs = [(d, " ".join(word() for _ in range(rnd.randint(0, 90))), "p") for d in range(60)]
    for d in range(60, 90):
        w = items[rnd.randrange(25)][1].split()
        a = rnd.randrange(max(1, len(w) - 12))
        docs.append((d, "x y " + " ".join(w[a : a + rnd.randint(10, 16)]) + " z", None))
    docs += [(200, None, None), (201, " ", None), (202, "<p>EIN <b>te­xt</b> – der zwölf\nＷörter hat eins “zwei” drei vier fünf se​chs sieben</p>", None), (202, "again", None), (None, docs[0][1], None)]
    docs += docs[60:64]
    got = [tuple(r) for r in L.leaks(spark, spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and (202, 102) in got


def test_exactly_twelve(spark):
    twelve = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, "zero " + twelve + " more", "q", None)], ITEM)
    docs = spark.createDataFrame([(1, twelve, None), (2, twelve[4:], None), (3, "a " + twelve.replace("six", "6"), None), (4, ("word " * 100_000) + twelve.upper(), None)], DOC)
    assert sorted(tuple(r) for r in L.leaks(spark, docs, items).collect()) == [(1, 1), (4, 1)]
    assert L.leaks(spark, docs.limit(0), items).count() == L.leaks(spark, docs, items.limit(0)).count() == 0


def test_the_filter_has_no_false_negatives():
    rnd = np.random.default_rng(2)
    h = rnd.integers(0, 1 << 64, 5000, dtype=np.uint64)
    table = np.zeros(1 << 12, np.int64)
    for p in np.concatenate([h & np.uint64((1 << 18) - 1), h >> np.uint64(32) & np.uint64((1 << 18) - 1)]).tolist():
        table[p >> 6] |= np.int64(((1 << (p & 63)) + (1 << 63)) % (1 << 64) - (1 << 63))
    assert bloom.passes(table, h).all() and bloom.passes(table, rnd.integers(0, 1 << 64, 5000, dtype=np.uint64)).mean() < 0.05


def test_the_filter_built_by_spark(spark):
    h = spark.range(3000).selectExpr("xxhash64(id) as h").toPandas()["h"].to_numpy()
    table = bloom.built(spark.range(3000).selectExpr("xxhash64(id) as h"), "h", 1 << 16)
    assert bloom.passes(table, h).all() and not bloom.passes(bloom.built(spark.range(0).selectExpr("xxhash64(id) as h"), "h", 1 << 16), h).any()


def test_counts_and_runs_are_sent_in_parts(spark, monkeypatch):
    """A long document that repeats item text, with so small bounds that tasks send often, gives the same."""
    monkeypatch.setattr(L, "HELD", 5)
    monkeypatch.setattr(L, "AT_ONCE", 3)
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(d, f"{item} x{d} {item} " * 3, None) for d in range(20)]
    got = sorted(tuple(r) for r in L.leaks(spark, spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, item, None, None)], ITEM)).collect())
    assert got == [(d, 7) for d in range(20)]
