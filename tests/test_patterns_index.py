"""Many patterns by an index, and the nearest span around a place, against trying all."""

import random
import re

import pytest

from loomspan.operators import relational as R
from loomspan.operators.patterns import indexed, wildcard
from loomspan.plans.analyze import analyze, expanded_exports
from loomspan.sources.projects import load


def test_5000_patterns_by_their_rarest_piece(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abcdeé-/𝄞") for _ in range(rng.randrange(1, 9))) for _ in range(7000)})[:5000]
    texts = [None, "", "a", *(" ".join(rng.choice(names) if rng.random() < 0.5 else "zz" for _ in range(rng.randrange(12))) for _ in range(200))]
    texts += [texts[-1], " ".join(names[:300])]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, content string")
    patterns = spark.createDataFrame([(n, rf"(^|\s){re.escape(n)}(\s|$)") for n in [*names, "zz", "absent"]], "name string, pattern string")
    got = {(r.i, r.name) for r in indexed(rows, "content", patterns, "pattern", "name").collect()}
    known = {*names, "zz"}
    assert got == {(i, w) for i, t in enumerate(texts) if t for w in t.split(" ") if w in known} and len(got) > 500
    assert indexed(rows, "content", patterns.where("false"), "pattern", "name").count() == 0
    assert indexed(rows.where("false"), "content", patterns, "pattern", "name").count() == 0


def test_index_equals_theta_join(spark):
    rows = spark.createDataFrame([(i, f"x{i % 7}y{i % 5}.") for i in range(60)] + [(99, "x1")], "i int, t string")
    patterns = spark.createDataFrame([(f"x{k}", rf"x{k}(y[0-3]|$)") for k in range(9)] + [("y", "y[24][.]")], "name string, p string")
    plain = {(r.i, r.name) for r in R.matching(rows, "t", patterns, "p").collect()}
    assert {(r.i, r.name) for r in indexed(rows, "t", patterns, "p", "name").collect()} == plain and plain


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_enclosing(spark, seed):
    rng = random.Random(seed)
    spans = [(rng.choice("ab"), s := rng.randrange(60), s + rng.randrange(-1, 25)) for _ in range(25)]
    points = [(rng.choice("abc"), rng.randrange(70), i) for i in range(80)] + [(None, 3, 90), ("a", None, 91)]
    got = {(r.k, r.at, r.i): (r.s, r.e) for r in R.enclosing(spark.createDataFrame(points, "k string, at int, i int"), spark.createDataFrame(spans, "k string, s int, e int"), ["k"], "at", "s", "e").collect()}
    want = {p: max(((s, -e) for k, s, e in spans if k == p[0] and p[1] is not None and s <= p[1] <= e), default=(None, 0)) for p in points}
    assert got == {p: (s, -e if s is not None else None) for p, (s, e) in want.items()}


def test_shadowed_names_bind_to_the_nearest_scope(spark):
    """A name declared in a file and again in a function and a block within: each use goes to the innermost around it."""
    declared = spark.createDataFrame([("f", "x", 0, 100), ("f", "x", 20, 60), ("f", "x", 30, 40), ("f", "y", 20, 60), ("g", "x", 0, 9)], "path string, name string, open long, close long")
    uses = spark.createDataFrame([("f", "x", p) for p in (5, 25, 35, 50, 80)] + [("f", "y", 10), ("f", "y", 30), ("g", "x", 5), ("g", "x", 5)], "path string, name string, at long")
    got = sorted(((r.path, r.name, r["at"]), r.open) for r in R.enclosing(uses, declared, ["path", "name"], "at", "open", "close").collect())
    assert got == [(("f", "x", 5), 0), (("f", "x", 25), 20), (("f", "x", 35), 30), (("f", "x", 50), 20), (("f", "x", 80), 0), (("f", "y", 10), None), (("f", "y", 30), 20), (("g", "x", 5), 0), (("g", "x", 5), 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_wildcard_patterns(spark, seed):
    """Against trying every pattern: an exact one first, then the longest part before the star, then behind it."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab@é") for _ in range(rng.randrange(n)))
    patterns = sorted({word(4) + "*" + word(4) for _ in range(25)} | {word(6) for _ in range(10)}) + ["*"] * (seed == 1)
    texts = [None, "", *(word(9) for _ in range(150))]
    texts += texts[-3:]

    def best(t):
        if t is None:
            return None, None
        if t in patterns:
            return t, None
        fits = [(len(a), len(b), p, t[len(a) : len(t) - len(b)]) for p in patterns if "*" in p for a, _, b in [p.partition("*")] if len(t) >= len(a) + len(b) and t.startswith(a) and t.endswith(b)]
        return max(fits)[2:] if fits else (None, None)

    got = wildcard(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "t", spark.createDataFrame([(p,) for p in [*patterns, None]], "p string"), "p").collect()
    assert sorted((r.i, r.matched, r.star) for r in got) == [(i, *best(t)) for i, t in enumerate(texts)]


def test_expanded_exports(spark):
    """Own names stay, the fewest hops win, then the first statement; circles end."""
    own = [("a", "x"), ("b", "x"), ("b", "y"), ("c", "z"), ("d", "y"), ("top", "own")]
    stars = [("top", "mid", 5), ("top", "d", 9), ("mid", "b", 1), ("mid", "a", 2), ("b", "c", 1), ("c", "b", 1), ("self", "self", 1)]
    got = {(r.path, r.name): (r.origin, r.hops, r.line) for r in expanded_exports(spark.createDataFrame(own, "path string, name string"), spark.createDataFrame(stars, "path string, to string, line int")).collect()}
    assert got == {
        **{(p, n): (p, 0, None) for p, n in own},
        ("mid", "x"): ("b", 1, 1), ("mid", "y"): ("b", 1, 1), ("mid", "z"): ("c", 2, 1),
        ("top", "y"): ("d", 1, 9), ("top", "x"): ("b", 2, 5), ("top", "z"): ("c", 3, 5),
        ("b", "z"): ("c", 1, 1), ("c", "x"): ("b", 1, 1), ("c", "y"): ("b", 1, 1),
    }


def test_totals_count_what_files_hand_on(spark, tmp_path):
    for path, text in {"package.json": '{"name": "p", "main": "index.ts"}', "index.ts": "export * from './lib';\n", "lib.ts": "export * from './deep';\nexport const a = 1;\n", "deep.ts": "export const b = 1;\nexport const a = 2;\n"}.items():
        (tmp_path / path).write_text(text)
    found = analyze(spark, load(str(tmp_path)))
    assert {(r.path, r.name, r.origin, r.hops) for r in found["syntheticExports"].collect()} == {("index.ts", "a", "lib.ts", 1), ("index.ts", "b", "deep.ts", 2), ("lib.ts", "b", "deep.ts", 1)}
    assert [tuple(r) for r in found["totals"].collect()] == [(3, 6, 3)]
