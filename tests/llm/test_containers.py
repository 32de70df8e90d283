import random

import pytest

from postlode.llm import packing as K

DOC, SIZE = "doc_id bigint, text string, container_kind string", "container_kind string, capacity_tokens int, text string"


@pytest.mark.parametrize("seed", range(20))
def test_the_tree_is_first_fit(seed):
    rnd = random.Random(seed)
    cap = rnd.randint(5, 60)
    sizes = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(0, 120))), reverse=True)
    bins: list[int] = []
    want = []
    for s in sizes:
        k = next((i for i, b in enumerate(bins) if b + s <= cap), len(bins))
        bins += [0] * (k == len(bins))
        want.append((k, bins[k]))
        bins[k] += s
    assert K.first_fit_decreasing(sizes, cap) == want


def test_packs_whole_texts(spark):
    rnd = random.Random(1)
    docs = [(d, " ".join(rnd.choice(["lamp", "Größe", "x1", "\n"]) for _ in range(rnd.choice([1, 5, 30, 200, 900]))), "k") for d in range(120)]
    docs += [(500, None, ""), (501, "", ""), (502, "  \n\t ", ""), (None, "x", ""), docs[0], (503, "word " * 30_000, "")]
    sizes = [("a", 64, ""), ("b", 1000, ""), ("b", 1000, ""), (None, 5, ""), ("c", 0, ""), ("d", None, "")]
    rows = K.packed(spark.createDataFrame(docs, DOC), spark.createDataFrame(sizes, SIZE), group_items=60).collect()
    tokens = {d: K.count_tokens(t) for d, t, _ in docs if d is not None and t and t.strip()}
    for kind, cap in (("a", 64), ("b", 1000)):
        own = [r for r in rows if r.container_kind == kind]
        for d, n in tokens.items():
            pieces = sorted((r.piece_no, r.token_from, r.token_count) for r in own if r.doc_id == d)
            assert [p for p, _, _ in pieces] == list(range(-(-n // cap))) and sum(c for _, _, c in pieces) == n
            assert all(f == p * cap for p, f, _ in pieces) and all(c == cap for _, _, c in pieces[:-1])
        bins: dict = {}
        for r in own:
            bins.setdefault((r.group_no, r.container_no), []).append((r.place, r.token_count))
        for spans in bins.values():
            at = 0
            for place, n in sorted(spans):
                assert place == at
                at += n
            assert at <= cap
        assert len({r.group_no for r in own}) > 1
        least = -(-sum(tokens.values()) // cap)
        assert len(bins) <= 11 / 9 * least + 3 * len({r.group_no for r in own})
    assert {r.container_kind for r in rows} == {"a", "b"} and {r.doc_id for r in rows} == tokens.keys()
    fill = {r.container_kind: r for r in K.filling(spark.createDataFrame([tuple(r) for r in rows], list(rows[0].__fields__))).collect()}
    assert fill["b"].filled > 0.8 and fill["a"].tokens == sum(tokens.values())


def test_empty(spark):
    d, s = spark.createDataFrame([], DOC), spark.createDataFrame([("a", 64, "")], SIZE)
    assert K.packed(d, s).count() == 0 and K.packed(spark.createDataFrame([(1, "x", "")], DOC), s.limit(0)).count() == 0
