"""Every query with SQL against DuckDB, and the fixpoints against plain Python."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspan.operators import relational as R
from loomspan.plans.queries import FLAGSHIP, ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    ours, sql = QUERIES[name](spark, str(SF)).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows(ours) == rows(sql)


def test_flagship():
    assert FLAGSHIP in QUERIES


def strong(edges):
    reach = {a: {a} for e in edges for a in e}
    for _ in range(len(reach)):
        for a, b in edges:
            for r in reach.values():
                if a in r:
                    r |= {b}
    return {(a, min(b for b in reach[a] if a in reach[b])) for a in reach if sum(a in reach[b] for b in reach[a]) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)}
    frame = spark.createDataFrame(sorted(edges), "src int, dst int")
    for local in (100, 0):
        assert {(r.node, r.scc) for r in R.strongly_connected(frame, local_edges=local).collect()} == strong(edges)


def test_strong_components_of_a_long_chain(spark):
    """300 cycles of two in a row: in one task, and some of them by labels, in few rounds."""
    chain = lambda k: [(2 * i + a, 2 * i + 1 - a) for i in range(k) for a in (0, 1)] + [(2 * i + 1, 2 * i + 2) for i in range(k - 1)]
    got = R.strongly_connected(spark.createDataFrame(chain(300), "src int, dst int")).collect()
    assert len(got) == 600 and {r.scc for r in got} == set(range(0, 600, 2))
    frame = spark.createDataFrame(chain(4), "src int, dst int")
    assert {r.scc for r in R.strongly_connected(frame, local_edges=0).collect()} == {0, 2, 4, 6}
    with pytest.raises(RuntimeError):
        R.strongly_connected(frame, local_edges=0, rounds=1)


def test_components(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(25)}
    root = {n: n for e in edges for n in e}
    for a, b in list(edges) * 40:
        root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(sorted(edges), "src int, dst int")
    for local in (100, 0):
        assert {r.node: r.component for r in R.components(frame, local_edges=local).collect()} == root


def test_elementary_cycles(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(22)}
    want = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1] and a != b:
                if b == path[0]:
                    want.add(tuple(path))
                elif b > path[0] and b not in path:
                    walk([*path, b])

    for n in range(9):
        walk([n])
    frame = spark.createDataFrame(sorted(edges), "src int, dst int")
    got = [tuple(r.nodes) for r in R.elementary_cycles(frame, per_component=10_000, most=10_000).collect()]
    assert set(got) == want and len(got) == len(want) > 5
    assert len(R.elementary_cycles(frame, per_component=3).collect()) == 3
    assert R.elementary_cycles(frame, largest=1).count() == 0


def test_closure_in_one_task_and_by_frontiers(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "src int, dst int")
    seeds = spark.createDataFrame([(25,), (99,)], "node int")
    for local in (1000, 0):
        assert sorted(r.node for r in R.closure(edges, seeds, local).collect()) == [*range(25, 31), 99]


def test_ranks_and_spans_with_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 3), (None, 1), (None, 2)], "k string, v int").repartition(4)
    got = {(r.k, r.v): (r.place, r.n) for r in R.ranked(rows, ["k"], [F.asc("v")]).collect()}
    assert got == {**{("hot", i): (i, 500) for i in range(500)}, ("cold", 3): (0, 1), (None, 1): (0, 2), (None, 2): (1, 2)}
    spans = spark.createDataFrame([("hot", 10, 12), ("hot", 100, 300), ("hot", 7, 6), ("cold", 0, 1)], "k string, a int, b int")
    assert sorted(r.v for r in R.contained(rows, spans, "k", "v", "a", "b").collect()) == [10, 11, 12, *range(100, 301)]
    assert R.contained(rows, spans.limit(0), "k", "v", "a", "b").count() == 0
    prefixes = spark.createDataFrame([("a b",), ("a",)], "prefix string")
    texts = spark.createDataFrame([("a b c", 1, 1), ("ab", 1, 1), (None, 1, 1), ("a b c", 1, 1)], "t string, _row int, _all int")
    assert sorted((str(r.t), str(r.prefix)) for r in R.longest_prefix(texts, "t", prefixes, "prefix").collect()) == [("None", "None"), ("a b c", "a b"), ("a b c", "a b"), ("ab", "None")]
