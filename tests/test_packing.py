import random

import pytest

from postlode.operators import packing as P

SCHEMA = "store_id bigint, seq bigint, provenance string, source_node_id bigint, recovery_index bigint, occurrence int, location string, folder_path array<string>, payload_bytes bigint, placement string"


def nonlinear(items):
    """The estimate of the fixed test cases: 100, the payload, 10 for each folder prefix and 20 for each begun pair of items."""
    prefixes = {tuple(p[: k + 1]) for p, _, _ in items for k in range(len(p))}
    return 100 + sum(b for _, _, b in items) + 10 * len(prefixes) + 20 * -(-len(items) // 2)


@pytest.mark.parametrize(
    ("items", "limit", "want"),
    [
        ([("Inbox", 1, 25), ("Inbox", 2, 25)], 180, [([1, 2], False)]),
        ([("Inbox", 1, 25), ("Inbox", 2, 26)], 180, [([1], False), ([2], False)]),
        ([("A", 1, 1), ("A", 2, 1), ("A/B", 3, 1)], 150, [([1, 2], False), ([3], False)]),
        ([("Z", 9, 1), ("A", 5, 1), ("A", 2, 1)], 950, [([2, 5, 9], False)]),
        ([("A", 1, 500), ("A", 2, 1)], 190, [([1], True), ([2], False)]),
    ],
)
def test_fixed_cases(items, limit, want):
    ordered = sorted((p.split("/"), n, b) for p, n, b in items)
    assert [([n for _, n, _ in part], over) for part, over in P.pack_local(ordered, limit, nonlinear)] == want


@pytest.mark.parametrize("seed", range(3))
def test_the_distributed_plan_equals_the_rule(spark, seed):
    rnd = random.Random(seed)
    est = P.LinearEstimate(100, 7, 11)
    rows = []
    for store in (1, 2):
        for k in range(rnd.choice([1, 40, 150])):
            path = [rnd.choice("abc" if seed else "a") for _ in range(rnd.randint(0, 3))]
            rows.append((store, k, rnd.choice(["normal", "orphan", "fragment"]), rnd.choice([None, rnd.randint(1, 9)]), None, k, rnd.choice(["store_root", "ipm_subtree"]), path, rnd.choice([0, 5, 30, 900]), "normal"))
    rnd.shuffle(rows)
    got = P.pack(P.with_ranks(spark.createDataFrame(rows, SCHEMA)), 400, estimate=est).collect()
    assert len(got) == len(rows)

    def estimate(part):
        prefixes = {(r[6], tuple(r[7][: k + 1])) for r in part for k in range(len(r[7]))}
        # a prefix is entered anew where the location changes, as both locations have folders of their own
        return 100 + sum(7 + r[8] for r in part) + 11 * len(prefixes)

    rank = {"normal": 1, "recovered": 2, "orphan": 3, "fragment": 4}
    for store in (1, 2):
        own = sorted((r for r in rows if r[0] == store), key=lambda r: (r[6] != "store_root", r[7], rank[r[2]], r[3] is not None, r[3] or 0, r[5]))
        want = [([r[1] for r in part], over) for part, over in P.pack_local(own, 400, estimate)]
        parts: dict = {}
        for r in sorted((r for r in got if r.store_id == store), key=lambda r: r.pos):
            parts.setdefault((r.part_index, bool(r.oversize)), []).append(r.seq)
        mine = [(v, k[1]) for k, v in sorted(parts.items())]
        assert mine == want


def test_traversal_order_and_empty(spark):
    rows = [(1, k, "normal", 1, None, 0, "store_root", ["x"], 60, "normal") for k in range(10)]
    df = P.with_ranks(spark.createDataFrame(rows, SCHEMA))
    got = P.pack(df, 250, "traversal", P.LinearEstimate(100, 0, 0)).orderBy("seq").collect()
    assert [r.part_index for r in got] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert P.pack(df.limit(0), 250).count() == 0
    table = P.parts_table(P.pack(df, 250, estimate=P.LinearEstimate(100, 0, 5)), P.LinearEstimate(100, 0, 5)).orderBy("part_index").collect()
    assert table[0].filename == "part-0001" and table[0].estimate_bytes == 100 + 120 + 5
