import random

import pytest

from postlode.operators import hierarchy as H

SCHEMA = "tree bigint, node bigint, parent bigint, seq bigint, removed boolean, name string, TREE2 string"


def solve(spark, rows, stride=4):
    nodes = H.current_nodes(spark.createDataFrame(rows, SCHEMA), "tree", "node", "parent", "seq", "removed", "name")
    return H.hierarchy(nodes, stride)


def brute(rows):
    last = {}
    for t, n, p, s, gone, _, _ in rows:
        if t is not None and n is not None and ((t, n) not in last or last[t, n][0] < s):
            last[t, n] = (s, p, gone)
    here = {k: v[1] for k, v in last.items() if not v[2]}
    out = {}
    for t, n in here:
        way, x = [], n
        while x not in way:
            way.append(x)
            p = here[t, x]
            if p is None or (t, p) not in here:
                out[t, n] = ("path", tuple(reversed(way)))
                break
            x = p
        else:
            cycle = way[way.index(x) :]
            out[t, n] = ("cycle" if n in cycle else "below", min(cycle))
    return out


def got(reached, rest):
    out = {(r.tree, r.node): ("path", tuple(r.id_path)) for r in reached.collect()}
    assert all(r.depth == len(r.id_path) and r.root == r.id_path[0] for r in reached.collect())
    return out | {(r.tree, r.node): ("cycle" if r.on_cycle else "below", r.cycle_min) for r in rest.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    rows = [(t, n, rnd.choice([None, *range(60)]) if rnd.random() < 0.9 else n + 1, rnd.randint(1, 9), rnd.random() < 0.1, rnd.choice(["a", "", None, "x/y"]), "z") for t in (1, 2) for n in range(50)]
    rows = [(t, n, p, s * 100 + k, g, m, z) for k, (t, n, p, s, g, m, z) in enumerate(rows)]
    rows += rnd.choices(rows, k=20) + [(None, 1, None, 1, False, None, None), (1, None, None, 1, False, None, None)]
    assert got(*solve(spark, rows)) == brute(rows)


def test_deep_chain_long_cycle_and_self_parent(spark):
    chain = [(1, n, n - 1 if n else None, n, None, f"n{n}", None) for n in range(75)]
    cycle = [(2, n, (n + 1) % 13, n, False, None, None) for n in range(13)] + [(2, 100 + n, 99 + n if n else 5, 50 + n, False, None, None) for n in range(20)] + [(2, 500, 500, 1, False, None, None)]
    assert got(*solve(spark, chain + cycle)) == brute(chain + cycle)


def test_descendants_and_names(spark):
    rows = [(1, 1, None, 1, False, "top", None), (1, 2, 1, 2, False, "a/b", None), (1, 3, 2, 3, False, "", None), (1, 4, 1, 4, False, None, None)]
    reached, _ = solve(spark, rows)
    counts = {r.node: (r.descendants, r.children, r.height) for r in H.descendant_counts(reached).collect()}
    assert counts == {1: (3, 2, 2), 2: (1, 1, 1), 3: (0, 0, 0), 4: (0, 0, 0)}
    assert sorted((r.ancestor, r.node, r.distance) for r in H.ancestor_pairs(reached).collect()) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]
    names = {r.node: r.p for r in reached.select("node", H.joined_path("name_path", "id_path").alias("p")).collect()}
    assert names == {1: "top", 2: "top/a\\/b", 3: "top/a\\/b/Recovered Folder 3", 4: "top/Recovered Folder 4"}


def test_empty(spark):
    assert got(*solve(spark, [])) == {}


def brute_pairs(rows):
    """{(tree, ancestor, node): least number of steps} over all present nodes, cycles included; none is its own ancestor."""
    last = {}
    for t, n, p, s, gone, _, _ in rows:
        if (t, n) not in last or last[t, n][0] < s:
            last[t, n] = (s, p, gone)
    here = {k: v[1] for k, v in last.items() if not v[2]}
    out = {}
    for t, n in here:
        steps, x = 0, here[t, n]
        while x is not None and (t, x) in here and x != n and (t, x, n) not in out:
            steps += 1
            out[t, x, n] = steps
            x = here[t, x]
    return here, out


@pytest.mark.parametrize("seed", range(2))
def test_descendants_on_and_below_cycles(spark, seed):
    rnd = random.Random(seed)
    rows = [(1, n, rnd.choice([None, *range(60)]) if rnd.random() < 0.8 else n + 1, n, rnd.random() < 0.05, "n", None) for n in range(50)]
    rows += [(2, n, (n + 1) % 13, n, False, "n", None) for n in range(13)] + [(2, 100 + n, 99 + n if n else 5, 50 + n, False, "n", None) for n in range(20)]
    rows += [(2, 500, 500, 1, False, "n", None), (2, 501, 500, 1, False, "n", None), (2, 600, None, 1, False, "n", None), (2, 601, 600, 1, False, "n", None)]
    here, want = brute_pairs(rows)
    nodes = H.current_nodes(spark.createDataFrame(rows, SCHEMA), "tree", "node", "parent", "seq", "removed")
    reached, rest = H.hierarchy(nodes, 4)
    opened = H.opened_cycles(nodes, rest, 4)
    pairs = H.ancestor_pairs(reached).unionByName(H.unreached_pairs(opened)).collect()
    assert len(pairs) == len(want) and {(r.tree, r.ancestor, r.node): r.distance for r in pairs} == want
    counts = H.descendant_counts(reached).unionByName(H.unreached_counts(opened)).collect()
    assert len(counts) == len(here) == len({(r.tree, r.node) for r in counts})
    for r in counts:
        mine = [d for (t, a, _), d in want.items() if (t, a) == (r.tree, r.node)]
        assert (r.descendants, r.children, r.height) == (len(mine), mine.count(1), max(mine, default=0)), r
    assert {(r.tree, r.node) for r in counts if r.depth is None} == {(r.tree, r.node) for r in rest.collect()}
