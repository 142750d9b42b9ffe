"""Graph operators spread over tasks, against plain walks."""

import random

import pytest

from loomspan.operators import relational as R
from loomspan.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src long, dst long")


def walked(edges, seeds):
    after, known, down = {}, set(seeds), list(seeds)
    for a, b in edges:
        after.setdefault(a, []).append(b)
    while down:
        for d in after.get(down.pop(), ()):
            if d not in known:
                known.add(d)
                down.append(d)
    return known


def test_a_chain_of_5000_in_few_rounds(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 5001)
    edges = set(zip(names, names[1:], strict=False)) | {(20_000, 20_001)}
    got = [r.node for r in R.reachable(frame(spark, edges), spark.createDataFrame([(names[5],)], "node long"), rounds=20).collect()]
    assert len(got) == len(set(got)) and set(got) == walked(edges, [names[5]])


@pytest.mark.parametrize("seed", range(3))
def test_reachable(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(80), rng.randrange(80)) for _ in range(95)} | {(i, i + 1) for i in range(100, 160)} | {(5, 100), (160, 100)}
    got = [r.node for r in R.reachable(frame(spark, edges), spark.createDataFrame([(5,), (7,), (999,)], "node long"), patience=seed).collect()]
    assert sorted(got) == sorted(walked(edges, [5, 7, 999]))


def cycles(edges, length):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = []

    def on(path):
        for d in after.get(path[-1], ()):
            if d == path[0] and len(path) > 1:
                out.append(list(path))
            elif d > path[0] and d not in path and len(path) < length:
                on([*path, d])

    for n in after:
        on([n])
    return sorted(out)


@pytest.mark.parametrize("length", [2, 3, 4, 5])
def test_short_cycles(spark, length):
    rng = random.Random(length)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(45)}
    want = cycles(edges, length)
    assert sorted(r.nodes for r in R.short_cycles(frame(spark, edges), length).collect()) == want and len(want) > 3
    assert R.short_cycles(frame(spark, {(1, 2), (2, 3)}), length).count() == 0


def test_strong_components_of_lines(spark):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas().sort_values(["l_orderkey", "l_linenumber"])
    edges = {(a, b) for a, b, o, p, m, n in zip(line.l_partkey, line.l_partkey[1:], line.l_orderkey, line.l_orderkey[1:], line.l_linenumber, line.l_linenumber[1:], strict=False) if o == p and n == m + 1}
    assert len(edges) > 2 * len({a for a, _ in edges})
    back = {(b, a) for a, b in edges}
    want, left = set(), {n for e in edges for n in e}
    while left:
        n = min(left)
        group = walked(edges, [n]) & walked(back, [n])
        want |= {(m, n) for m in group if len(group) > 1}
        left -= group
    assert {(r.node, r.scc) for r in QUERIES["strong_components_spread"](spark, SF).collect()} == want
