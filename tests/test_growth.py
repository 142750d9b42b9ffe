"""Work that grows no faster than the tables: rows shuffled once, groups that are not expanded, few rounds."""

import random

from loomspan.operators import patterns as P
from loomspan.operators import relational as R
from loomspan.plans import analyze as A
from loomspan.plans.queries import QUERIES


def plans(monkeypatch, module):
    """The plans that `module` pins from now on."""
    seen, pin = [], module.pin

    def pinned(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return pin(df)

    monkeypatch.setattr(module, "pin", pinned)
    return seen


def test_windows_are_shuffled_once(spark, monkeypatch):
    seen = plans(monkeypatch, A)
    words = [f"w{i % 70}" for i in range(200)]
    facts = spark.createDataFrame([(f, [(t, i + 1) for i, t in enumerate(words[:n])]) for f, n in (("a", 200), ("b", 90), ("c", 49))], "path string, tokens array<struct<token:string,line:int>>")
    assert A.duplicate_blocks(facts, A.Options()).count()
    initial = seen[0].split("Initial Plan")[-1]
    assert "Expand" not in initial and initial.count("Exchange hashpartitioning") == 2  # by hash, then what occurs twice by path
    for k in (1, 2, 7, 50):
        rows = sorted((r.path, r.pos, r.hash, r.next, r.first, r.last) for r in A._windows(facts, k).collect())
        grams = {}
        for path, pos, h, after, first, last in rows:
            grams.setdefault(h, set()).add(tuple(words[pos : pos + k]))
            assert (first, last) == (pos + 1, pos + k)
        assert all(len(g) == 1 for g in grams.values()) and len(grams) == len({tuple(words[p : p + k]) for p in range(200 - k + 1)})
        assert [x[3] for x in rows if x[0] == "a"] == [x[2] for x in rows if x[0] == "a"][1:] + [None]


def test_candidates_meet_one_row_a_key(spark):
    """A key that 3000 rows have is asked for 3000 times: as pairs that would be 9 million rows."""
    asked = spark.range(3000).selectExpr("id", "array(concat('none ', id), if(id % 2 = 0, 'hot', null), 'late') AS keys")
    keyed = spark.range(3000).selectExpr("'hot' AS key", "5 - id % 3 AS rank", "id AS path").union(spark.sql("SELECT 'late', 1L, 7L"))
    found = R.first_candidate(asked, "keys", keyed, ["id"])
    assert {(r.id % 2, r.to) for r in found.collect()} == {(0, 2), (1, 7)}
    assert found.count() == 3000
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # of the keys before, of the asked behind the join


def test_long_ways_into_rings_in_few_rounds(spark, monkeypatch):
    """A way of 400 into a ring of 300, one of 300 to an end, one out of a ring, and a knot that has several ways."""
    names = random.Random(4).sample(range(5000), 1500)
    ring, into, out, apart, knot = names[:300], names[300:700], names[700:1000], names[1000:1300], names[1300:1306]
    edges = list(zip(ring, [*ring[1:], ring[0]])) + list(zip(into, [*into[1:], ring[7]])) + [(knot[2], out[0])] + list(zip(out, out[1:])) + list(zip(apart, apart[1:]))
    edges += [(a, b) for i, a in enumerate(knot) for b in knot[i + 1 :]] + [(knot[5], knot[0]), (apart[-1], knot[1]), (knot[3], into[5])]
    seen = plans(monkeypatch, R)
    frame = spark.createDataFrame(edges, "src int, dst int")
    want = {(n, min(ring)) for n in ring} | {(n, min(knot)) for n in knot}
    assert {(r.node, r.scc) for r in R.strongly_connected(frame, local_edges=0).collect()} == want
    assert len(seen) < 120  # 300 and more when a chain lost an edge a turn


def test_numbers_as_patterns_meet_few_texts(spark, monkeypatch):
    """Numbers share their short pieces: looked up by those, 200 urls were posted some 1500 times, and met all patterns."""
    rows, pin = [], P.pin
    monkeypatch.setattr(P, "pin", lambda df: rows.append(pin(df)) or rows[-1])
    texts = spark.range(200).selectExpr("id", "concat('http://a.b/en/', 123400 + id) AS url")
    patterns = spark.range(300).selectExpr("concat('/', 123300 + id) AS literal", "concat('/', 123300 + id, '([^0-9]|$)') AS pattern").union(spark.sql("SELECT 'http://a.b/en/12350', 'http://a.b/en/12350[0-4]$'"))
    found = sorted((r.id, r.literal) for r in P.indexed(texts, "url", patterns, "pattern", "literal").collect())
    assert found == sorted([(i, f"/{123400 + i}") for i in range(200)] + [(100 + i, "http://a.b/en/12350") for i in range(5)])
    assert rows[2].where("_piece like '/1%'").count() <= 400


def test_duplicates_are_counted_without_lists(spark):
    found = QUERIES["shared_consumer_duplicates"](spark, "/root/testdata/sf0.001")
    assert "collect_" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_names_travel_in_packs(spark):
    """What is sent along a statement is one row, however many names it hands on; one statement may lead to several files."""
    rng = random.Random(11)
    own = {(p, f"n{rng.randrange(12)}") for p in range(20) for _ in range(3)}
    stars = {(rng.randrange(20), rng.randrange(20), rng.randrange(3)) for _ in range(45)}
    want = {k: (k[0], 0, None) for k in own}
    for hops in range(1, 30):
        found = {}
        for path, to, line in stars:
            for (p, name), (origin, h, _) in want.items():
                if p == to and h == hops - 1 and (path, name) not in want:
                    found[path, name] = min(found.get((path, name), (line, origin)), (line, origin))
        want |= {k: (origin, hops, line) for k, (line, origin) in found.items()}
    frames = spark.createDataFrame(sorted(own), "path int, name string"), spark.createDataFrame(sorted(stars), "path int, to int, line int")
    made = A.expanded_exports(*frames)
    assert {(r.path, r.name): (r.origin, r.hops, r.line) for r in made.collect()} == want
    assert len({(p, n) for p, _, n in stars}) < len(stars)  # some statements lead to several files
    assert "inline" in made._jdf.queryExecution().optimizedPlan().toString()  # rows are parted at the end


def test_dense_graphs_are_labelled_by_a_share_of_their_edges(spark, monkeypatch):
    """Three knots of 150 nodes with 30 edges each, one way from knot to knot, and sparse nodes around; labels never travel over all edges."""
    rng = random.Random(7)
    names = rng.sample(range(10_000), 520)
    knots = [names[i : i + 150] for i in (0, 150, 300)]
    edges = {(a, b) for knot in knots for a in knot for b in rng.sample(knot, 30) if a != b}
    edges |= {(rng.choice(knots[i]), rng.choice(knots[j])) for i, j in ((0, 1), (1, 2), (0, 2)) for _ in range(40)}
    around = names[450:]
    edges |= {(knots[0][3], around[0]), (around[0], knots[0][9]), (knots[2][1], around[2]), (around[2], around[3]), (around[3], around[2])} | set(zip(around[10:], around[11:]))
    carried, first = [], R._first_that_reaches
    monkeypatch.setattr(R, "_first_that_reaches", lambda over, *a, **b: (carried.append(over.count()), first(over, *a, **b))[1])
    want = {(n, min([*knots[0], around[0]])) for n in [*knots[0], around[0]]} | {(n, min(k)) for k in knots[1:] for n in k} | {(n, min(around[2:4])) for n in around[2:4]}
    frame = spark.createDataFrame(sorted(edges), "src int, dst int").selectExpr("lpad(src, 5, '0') AS src", "lpad(dst, 5, '0') AS dst")
    got = R.strongly_connected(frame, local_edges=0).collect()
    assert len(got) == len(want) and {(int(r.node), int(r.scc)) for r in got} == want
    assert max(carried) < len(edges) / 2
