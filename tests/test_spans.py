"""Span operators and nested duplicate blocks, against all pairs and plain scans."""

import random

import pytest

from loomspan.operators import relational as R
from loomspan.plans.analyze import Options, duplicate_blocks
from tests.test_suffixes import ordered, scan, shared


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_in_spans_of_any_width(spark, seed):
    rng = random.Random(seed)
    points = [(rng.choice("ab"), rng.randrange(-500, 5000)) for _ in range(400)] + [("a", 7), ("a", 7), (None, 3)]
    spans = [(rng.choice("ab"), s := rng.randrange(-500, 5000), s + rng.choice([0, 1, 3, 50, 700])) for _ in range(30)] + [("b", -100, 4000), ("a", 9, 8)]
    spans += [("a", -(2**60), 2**60)] if seed == 2 else []
    got = R.contained(spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(spans, "k string, s long, e long"), "k", "at", "s", "e").collect()
    assert sorted(tuple(r) for r in got) == sorted(p for p in points if any(p[0] == k and s <= p[1] <= e for k, s, e in spans))


def test_one_span_over_a_million_places(spark):
    points = spark.range(1_000_000).selectExpr("'k' as k", "id as at")
    spans = spark.range(20_000).selectExpr("'k' as k", "id * 50 as s", "id * 50 + 3 as e").union(spark.sql("select 'k', 100, 900000"))
    assert R.contained(points, spans, "k", "at", "s", "e").count() == sum(100 <= i <= 900_000 or i % 50 <= 3 for i in range(1_000_000))


@pytest.mark.parametrize("seed", range(3))
def test_covered(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), s := rng.randrange(30), s + rng.randrange(12), rng.randrange(5)) for i in range(300)]
    got = {r.i for r in R.covered(spark.createDataFrame(rows, "i int, k string, s int, e int, w int"), ["k"], "s", "e", "w").collect()}
    assert got == {a[0] for a in rows if any(a[1] == b[1] and b[2] <= a[2] and a[3] <= b[3] and b[4] > a[4] for b in rows)}


def test_covered_by_many(spark):
    """100,000 spans of one key, none within another but the last."""
    rows = spark.range(100_000).selectExpr("'k' as k", "id as s", "id + 10 as e", "1 as w").union(spark.sql("select 'k', 50, 55, 0"))
    assert [(r.s, r.e) for r in R.covered(rows, ["k"], "s", "e", "w").collect()] == [(50, 55)]


def test_apart(spark):
    rows = [("a", p, 3) for p in range(10)] + [("b", 5, 3), ("b", 8, 3), ("b", 9, 3)]
    assert sorted((r.k, r.at) for r in R.apart(spark.createDataFrame(rows, "k string, at int, w int"), ["k"], "at", "w").collect()) == [("a", 0), ("a", 3), ("a", 6), ("a", 9), ("b", 5), ("b", 8)]


def nested(files, k):
    """(block, instances, tokens, (path, at)) of every interval, by a scan over sorted suffixes and greedy parting."""
    order = ordered(files)
    lcps = [0] + [shared(files[a[0]][a[1] :], files[b[0]][b[1] :]) for a, b in zip(order, order[1:])]
    out = []
    for first, n, length in scan(lcps, k, True):
        kept, last = [], {}
        for f, p in sorted(order[first : first + n]):
            if p >= last.get(f, 0):
                kept.append((f, p))
                last[f] = p + length
        if len(kept) >= 2:
            out.append(((first, length), len(kept), length, kept))
    inside = [b for b, m, length, kept in out if all(any(o != b and n == m and more > length and any(f == g and q <= p and p + length <= q + more for g, q in others) for o, n, more, others in out) for f, p in kept)]
    return sorted((f, p + 1, p + length, m, length) for b, m, length, kept in out if b not in inside for f, p in kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_blocks(spark, seed):
    rng, k = random.Random(seed), 4
    piece = [rng.choice("abc") for _ in range(9)]
    files = {f"f{i}": [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 12))] + piece[: rng.randrange(5, 10)] + [rng.choice("abcdefgh") for _ in range(6)] + piece for i in range(4)} | {"g": ["x"] * 12, "h": ["a", "b"]}
    facts = spark.createDataFrame([(f, [(t, i + 1) for i, t in enumerate(ts)]) for f, ts in files.items()], "path string, tokens array<struct<token:string,line:int>>")
    both = {compat: duplicate_blocks(facts, Options(block_tokens=k, block_lines=1, compat=compat)).collect() for compat in (False, True)}
    assert sorted((r.path, r.start_line, r.end_line, r.instances, r.tokens) for r in both[True]) == nested(files, k)
    assert {r.instances for r in both[True] if r.path != "g"} > {r.instances for r in both[False] if r.path != "g"} or len(both[True]) > len(both[False])
    for rows in both.values():
        lengths = [(r.end_line - r.start_line, r.tokens) for r in rows]
        assert lengths == sorted(lengths, reverse=True)


def test_nested_blocks_list_few_copies(spark, monkeypatch):
    """Of 20 copies only what begins where they do is listed, not what begins at each later word; of a word said 60 times on one line nothing."""
    rng, k = random.Random(5), 10
    piece = [rng.choice("abc") for _ in range(40)]
    files = {f"f{i:02d}": [f"x{i}", *piece, f"y{i}"] for i in range(20)} | {f"r{i}": ["q", *piece[:12] * 3, f"z{i}"] for i in range(2)}
    facts = spark.createDataFrame([(f, [(t, i + 1) for i, t in enumerate(ts)]) for f, ts in files.items()] + [("one", [("w", 1)] * 60)], "path string, tokens array<struct<token:string,line:int>>")
    listed, apart = [], R.apart
    monkeypatch.setattr(R, "apart", lambda rows, *a: listed.append(rows) or apart(rows, *a))
    got = duplicate_blocks(facts, Options(block_tokens=k, block_lines=2, compat=True)).collect()
    assert sorted((r.path, r.start_line, r.end_line, r.instances, r.tokens) for r in got) == nested(files, k)
    assert listed[0].count() < 1500  # 31 times 20 * 20 / 2 and more before
    assert listed[0].where("tokens < 12").count() < 150
