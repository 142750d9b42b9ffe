"""Centroid clustering, the conversation trie and personal data: odd inputs, and against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loomspan.llm import clustering, conversations, personal

VECTORS = "vec_id long, embedding array<float>, cluster int, v string, label int"


def lloyd(rows, k, rounds):
    """(vec_id, cluster, distance) of (vec_id, integer vector) in plain Python."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for i, vs in groups.items():
            cents[i] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in rows), cents


@pytest.mark.parametrize("case", ["spread", "one point", "ties", "few"])
def test_clusters_are_those_of_plain_lloyd(spark, case):
    rng = random.Random(case)
    n = 4 if case == "few" else 150
    ints = [(i, [{"one point": 7, "ties": rng.randrange(2), "spread": rng.randrange(-90, 90), "few": rng.randrange(9)}[case] for _ in range(8)]) for i in range(n)]
    ints += ints[:3] + [(n + i, ints[0][1]) for i in range(n // 2)]  # repeated rows and a hot vector
    rows = [(i, [x / 16 for x in v], 0, "v", 1) for i, v in ints]
    odd = [(900, None, 0, "v", 1), (901, [1.0] * 7, 0, "v", 1), (902, [float("nan")] * 8, 0, "v", 1), (903, [float("inf")] * 8, 0, "v", 1), (904, [None] * 8, 0, "v", 1), (905, [], 0, "v", 1)]
    frame = spark.createDataFrame(rows + odd, VECTORS).repartition(3)
    found, cents = clustering.clustered(frame, k=6, rounds=3, dim=8, scale=16)
    want, last = lloyd(ints, 6, 3)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == want
    assert cents == last


def test_clusters_of_nothing_and_of_what_does_not_fit(spark):
    found, cents = clustering.clustered(spark.createDataFrame([], VECTORS))
    assert found.count() == 0 and cents == []
    with pytest.raises(Exception, match="lies beyond"):
        clustering.clustered(spark.createDataFrame([(1, [3e30] * 8, 0, "v", 1)], VECTORS), dim=8)
    assert [r.vec_id for r in clustering.clustered(spark.createDataFrame([(None, [1.0], 0, "v", 1)], VECTORS), dim=1)[0].collect()] == [None]


def test_cover_trees():
    """Nets are nested, apart and covering, and a walk finds what comparing all finds."""
    rng = np.random.default_rng(5)
    for trial in range(25):
        n, k, dim, wide = int(rng.integers(1, 200)), int(rng.integers(1, 18)), int(rng.integers(1, 30)), int(rng.choice([2, 30, 2**20]))
        v, c = rng.integers(-wide, wide, (n, dim)), rng.integers(-wide, wide, (k, dim))
        v[n // 2 :] = v[0] if trial % 3 == 0 else v[n // 2 :]
        tree = clustering.cover_tree(v)
        assert sorted(tree.order) == list(range(n))
        p = v[tree.order]
        for i, (a, b) in enumerate(zip(tree.lo, tree.hi, strict=True)):
            kids = tree.kids[tree.first[i] : tree.first[i + 1]]
            assert np.sqrt(((p[a:b] - p[a]) ** 2).sum(1).max()) <= tree.radius[i]
            assert not len(kids) or (tree.lo[kids[0]], tree.hi[kids[-1]]) == (a, b)
        lo, hi, number = clustering.nearest(tree, p, clustering.cover_tree(c), c)
        assert lo[0] == 0 and hi[-1] == n and (lo[1:] == hi[:-1]).all()
        assert (np.repeat(number, hi - lo) == ((p[:, None] - c) ** 2).sum(2).argmin(1)).all()


def test_a_node_near_one_centroid_is_assigned_as_a_whole():
    v = np.array([[1000 * g + i % 5, i // 5] for g in range(4) for i in range(50)])
    tree = clustering.cover_tree(v)
    lo, *_ = clustering.nearest(tree, v[tree.order], clustering.cover_tree(v[::50]), v[::50])
    assert len(lo) < 20


def trie(rows, every=100, most=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        donor = c - int(np.fmod(c, every))
        built[c] = own.get(donor, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) > len(q) and x[: len(q)] == q for x in below)]
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, place int, n string"


def found_trie(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], TURNS).repartition(3)
    return sorted((tuple(r) for r in conversations.prefix_trie(*conversations.grafted(conversations.numbered(frame))).collect()), key=repr)


def test_trie_is_that_of_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 40), *range(95, 106), 200, 205, 300, -5, -120]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "", None, "żółw"])))
    same = [(500 + i, t, "user", "hello" * t) for i in range(40) for t in range(5)]  # a hot conversation
    long = [(c, t, "user", f"t{t}") for c in (700, 701) for t in range(9 + c % 2)]  # one is a prefix of the other
    rows += same + long + [(None, 1, "user", "no id"), rows[0], rows[0]]
    assert found_trie(spark, rows) == trie(rows)


def test_trie_of_one_and_of_none(spark):
    one = [(3, t, "u", "x" * t) for t in range(8)]
    assert found_trie(spark, one) == trie(one)
    alike = [(c, t, "u", "x" * t) for c in (0, 700, 1300) for t in range(3)]
    assert found_trie(spark, alike) == trie(alike)
    assert found_trie(spark, []) == []
    short = [(c, 0, "u", "only") for c in range(1, 9)]  # most lose all turns to an absent donor
    assert found_trie(spark, short) == trie(short)


def test_ends_of_more_than_one_bin(spark):
    rows = [(i * 1000 + 1, 0, "u", "same") for i in range(60)]
    assert found_trie(spark, rows) == trie(rows)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def plain_spans(text):
    fits = {
        "email": lambda s, d: True,
        "ip": lambda s, d: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s, d: 12 <= len(d) <= 19 and luhn(d),
        "phone": lambda s, d: 9 <= len(d) <= 15,
    }
    return sorted((m.start(), m.end(), k) for k, p in BASE.items() for m in re.finditer(p, text) if fits[k](m[0], re.sub("[^0-9]", "", m[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    for letters, n, most in (("a1@.-+ (9", 8000, 40), ("0123456789 -", 2000, 90), ("12.5 ", 2000, 60), ("ab@._%-é", 2000, 200)):
        for _ in range(n):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
            assert sorted(personal.base_spans(text)) == plain_spans(text), text


SPELLED = {**dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))}
ALIKE = str.maketrans("aceopxyABE", "асеорхуАВЕ")
WIDE = {c: chr(ord(c) + 0xFEE0) for c in "0123456789@."}


def disguises(rng, kind, clear):
    """A disguised form of an identifier."""
    spell = lambda s: re.sub("[0-9]+", lambda m: " ".join(SPELLED[d] for d in m[0]), s)
    hide = {
        "email": [lambda s: s.replace("@", " (at) ").replace(".", " (dot) "), lambda s: s.replace("@", "[at]").replace(".", "[.]"), lambda s: s.replace("@", " at ").replace(".", " dot "), lambda s: s.translate(ALIKE), lambda s: s.replace("@", "&#64;"), lambda s: "​".join(s), lambda s: "".join(WIDE.get(c, c) for c in s), lambda s: s.replace("@", "_at_").replace(".", "_dot_")],
        "ip": [lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", " dot "), lambda s: "".join(WIDE.get(c, c) for c in s), lambda s: spell(s.replace(".", " dot "))],
        "card": [lambda s: spell(" ".join(s.split())), lambda s: "".join(WIDE.get(c, c) for c in s), lambda s: s.replace(" ", "\xa0"), lambda s: s.replace(" ", "​ ")],
        "phone": [lambda s: s.replace("+", "plus ").replace("555", "five five five"), lambda s: "".join(WIDE.get(c, c) for c in s), lambda s: "+" + spell(re.sub("[^0-9]", "", s))],
    }
    return rng.choice(hide[kind])(clear)


def identifiers(rng):
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    card = digits(15)
    card += next(c for c in "0123456789" if luhn(card + c))
    return {
        "email": f"{rng.choice(['jane', 'b.cope', 'max'])}{digits(2)}@{rng.choice(['example', 'mail.example'])}.{rng.choice(['com', 'org', 'de'])}",
        "ip": ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "card": " ".join(card[i : i + 4] for i in range(0, 16, 4)),
        "phone": f"+1 ({digits(3)}) 555-{digits(4)}",
    }


def test_disguised_identifiers_are_found_where_they_stand():
    rng = random.Random(8)
    for _ in range(400):
        kind, clear = rng.choice(list(identifiers(rng).items()))
        before, after = rng.choice(["Write to ", "", "Ünïcode — text: ", "the list, "]), rng.choice([". Thanks", "", ", they said", "\nnext line"])
        hidden = disguises(rng, kind, clear)
        text = before + hidden + after
        if hidden == clear:
            continue
        found = [x for x in personal.spans_of(text) if x[2] == kind]
        assert (len(before), len(before) + len(hidden)) in [(s, e) for s, e, *_ in found], (text, found)
        assert [x[:3] for x in personal.spans_of(text) if x[4]] == plain_spans(text)


@pytest.mark.parametrize("text", ["look at the dot on the map", "Look at the dot in the corner", "She stared at a point in time", "MEET AT EXAMPLE.COM", "jane at home. In short", "meet at example.com", "one two three, four", "He is at home. Dot com was big", "at 5 dot 30", "a cat at a mat", "un deux trois", "user@", "the point at issue. De facto", "IO10 lOl", "£5 at 10.30 – 11.00"])
def test_clean_text_stays_clean(text):
    assert personal.spans_of(text) == []


@pytest.mark.parametrize("text, value", [("jane AT example.com", "jane@example.com"), ("x jane.doe at mail dot example dot co dot uk y", "jane.doe@mail.example.co.uk"), ("max arroba ejemplo punto es", "max@ejemplo.es"), ("max (ät) beispiel (punkt) de", "max@beispiel.de"), ("<a@b.co> (at) c [.] org", "a@b.co")])
def test_addresses_in_words(text, value):
    assert value in [x[3] for x in personal.spans_of(text)]


def test_layers_lead_back():
    """Against a text in which every character carries its place."""
    rng = random.Random(1)
    for _ in range(300):
        marked = [(c, i, i + 1) for i, c in enumerate("".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))))]
        layers = []
        for _ in range(3):
            text = "".join(c for c, *_ in marked)
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 4)))
            edits = [(a, b, rng.choice(["", "x", "yz"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
            layers.insert(0, personal.Layer(text, edits))
            new, last = [], 0
            for a, b, by in edits:
                new += marked[last:a] + [(c, marked[a][1], marked[b - 1][2]) for c in by]
                last = b
            marked = new + marked[last:]
            assert layers[0].text == "".join(c for c, *_ in marked)
        for i in range(len(marked)):
            for j in range(i + 1, len(marked) + 1):
                a, b = i, j
                for layer in layers:
                    a, b = layer.back(a, b)
                assert (a, b) == (marked[i][1], marked[j - 1][2])


def test_personal_data_of_odd_rows(spark):
    texts = [None, "", "a@b.co " * 3000, "x" * 100_000, "four " * 20_000, "jane (at) example (dot) com", "jane (at) example (dot) com"]
    rows = [(i, t, "en", "x", 1) for i, t in enumerate(texts)] + [(None, "a@b.co", "en", "x", 1), (5, texts[5], "en", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind string, start int")
    got = personal.scan(frame).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append([(s.start, s.end, s.kind, s.value, s.base) for s in r.spans])
    assert by[0] == by[1] == by[3] == [[]] and len(by[2][0]) == 3000 and by[5][0] == by[5][1] == by[6][0] == [(0, 27, "email", "jane@example.com", False)]
    assert by[None] == [[(0, 6, "email", "a@b.co", True)]]
    assert personal.scan(frame.where("false")).collect() == []
