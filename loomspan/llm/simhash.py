"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared only at anchors: the codewords of a covering code. 63 of the 64 bits form
`PARTS` parts of three 7-bit blocks; the anchors of a part are the products of three Hamming(7,4)
codewords, of which every value has exactly one within one bit for each block (the covering radius).
Two fingerprints that differ in at most 4 bits differ in at most one bit of some part (pigeonhole). So
each fingerprint goes to its own anchor of every part as a home row, and as a visitor to every anchor
within the covering radius plus that one bit; homes and visitors of an anchor are compared.
Equal fingerprints are folded to one row before that, and a comparison yields a spanning forest of
what it links, so neither copies nor near copies are ever expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import batches, columns, only, pin, small, stored

PARTS, DISTANCE, SHINGLE = 3, 4, 4
SEED = 42
#: Rows of one side that a comparison takes at a time; anchors with more are split into blocks.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, lanes: int = 1, distinct: bool = False) -> tuple[int, ...]:
    """Lanes of 64 bits of the whole text's word shingles, repeats included unless `distinct`; 0 if there are no words.

    The first lane is of the shingles' XXH64, further ones of hashes derived from it.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return (0,) * lanes
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: max(1, len(words) - shingle + 1)].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    if distinct:
        h = np.unique(h)
    out, n = [], len(h)
    for _ in range(lanes):
        total = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]))
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return tuple(out)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """doc_id, text_key (hash of the text), f0, f1... (lanes as signed longs) for every row."""
    batches(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    names = [f"f{i}" for i in range(lanes)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t, shingle, lanes, distinct) for t in b.column("text").to_pylist()], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(lanes))], ["doc_id", "text_key", *names])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("text_key", *names))]))


def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For each 7-bit value: the number of its codeword, and those of codewords two bits away (-1: none)."""
    values = np.arange(128)
    syndrome = np.zeros(128, np.int64)
    for bit in range(7):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    codewords = values[syndrome == 0]
    apart = np.bitwise_count(values[:, None] ^ codewords[None, :])
    visits = np.full((128, 3), -1, np.int64)
    for v in values:
        two = np.flatnonzero(apart[v] == 2)
        visits[v, : len(two)] = two
    return apart.argmin(axis=1), visits


_HOME, _VISITS = _hamming()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchors (rows x parts), and visits: row numbers with the anchors they go to (homes included)."""
    homes, rows, at = [], [], []
    u = fps.view(np.uint64)
    for part in range(PARTS):
        blocks = [(u >> np.uint64(21 * part + 7 * i) & np.uint64(127)).astype(np.int64) for i in range(3)]
        codes = [_HOME[b] for b in blocks]
        home = part << 12 | codes[0] | codes[1] << 4 | codes[2] << 8
        homes.append(home)
        rows.append(np.arange(len(u)))
        at.append(home)
        for i, b in enumerate(blocks):
            for k in range(3):
                other = _VISITS[b, k]
                there = np.flatnonzero(other >= 0)
                rows.append(there)
                at.append(home[there] & ~(15 << 4 * i) | other[there] << 4 * i)
    return np.stack(homes, axis=1), np.concatenate(rows), np.concatenate(at)


N_ANCHORS = PARTS << 12


def _mixed(fps: np.ndarray) -> np.ndarray:
    u = fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (u >> np.uint64(33)).astype(np.int64)


#: Visitors up to which each home is compared with all of an anchor's, and pairs that are looked at at a time.
FEW, PAIRS_AT_ONCE = 400, 1 << 19


def _meeting(h: np.ndarray, v: np.ndarray, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of homes and visitors of an anchor that differ in at most one bit of its part, some at a time.

    With many visitors each home looks its value and those one bit away up in the sorted ones, so the work grows
    with the pairs that are found rather than with the square of the rows.
    """
    if len(v) <= FEW:
        step = max(1, PAIRS_AT_ONCE // max(len(v), 1))
        mask = np.uint64((1 << 21) - 1 << 21 * part)
        for i in range(0, len(h), step):
            x, y = np.nonzero(np.bitwise_count((h[i : i + step, None] ^ v[None, :]) & mask) <= 1)
            yield i + x, y
        return
    mine, others = ((f >> np.uint64(21 * part) & np.uint64((1 << 21) - 1)).astype(np.int64) for f in (h, v))
    order = np.argsort(others, kind="stable")
    others = others[order]
    for flip in (0, *(1 << b for b in range(21))):
        first = np.searchsorted(others, mine ^ flip, "left")
        many = np.searchsorted(others, mine ^ flip, "right") - first
        at = np.flatnonzero(many)
        total = np.cumsum(many[at])
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
            x = np.repeat(at[i:j], many[at[i:j]])
            nth = np.arange(len(x)) - np.repeat(np.cumsum(many[at[i:j]]) - many[at[i:j]], many[at[i:j]])
            yield x, order[first[x] + nth]
            i = j


def _forest(node: np.ndarray, lanes: np.ndarray, side: np.ndarray, anchor: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (a, b) of the links between an anchor's homes (side 0) and visitors (side 1)."""
    names, local = np.unique(node, return_inverse=True)
    root = np.arange(len(names))
    at_h, at_v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    h, v = lanes[at_h, anchor // N_ANCHORS], lanes[at_v, anchor // N_ANCHORS]
    for x, y in _meeting(h, v, anchor % N_ANCHORS >> 12):
        near = np.bitwise_count(h[x] ^ v[y]) <= distance
        x, y = local[at_h[x[near]]], local[at_v[y[near]]]
        while len(apart := np.flatnonzero(root[x] != root[y])):
            x, y = x[apart], y[apart]
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


#: Bits up to which candidates count as equally near when a forest of them is chosen.
LEVELS = np.array([4, 10, 16, 22, 30, 192])


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of edges that join trees of `root`, one for each join; `root` is brought up to date."""
    used, nth = [np.zeros(0, np.int64)], np.arange(len(x))
    pick = np.full(len(root), -1, np.int64)
    while len(apart := np.flatnonzero(root[x] != root[y])):
        x, y, nth = x[apart], y[apart], nth[apart]
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        pick[high] = np.arange(len(high))  # one edge for each upper root
        chosen = pick[np.unique(high)]
        used.append(nth[chosen])
        root[high[chosen]] = low[chosen]
        while (root != root[root]).any():
            root[:] = root[root]
    return np.concatenate(used)


def _near_forest(node: np.ndarray, lanes: np.ndarray, side: np.ndarray, anchor: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) that meet at the anchor and are near in all lanes: for each of `LEVELS` a spanning forest.

    Every pair returned is itself near, so it can be checked; those within a level connect all that pairs
    within it do. Nearer pairs come first, so a check that fails seldom parts what others would hold together.
    """
    names, local = np.unique(node, return_inverse=True)
    root = np.tile(np.arange(len(names)), (len(LEVELS), 1))
    at_h, at_v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    h, v = lanes[at_h, anchor // N_ANCHORS], lanes[at_v, anchor // N_ANCHORS]
    out = [np.zeros((2, 0), np.int64)]
    for x, y in _meeting(h, v, anchor % N_ANCHORS >> 12):
        x, y = at_h[x], at_v[y]
        bits = sum(np.bitwise_count(lanes[x, k] ^ lanes[y, k]).astype(np.int64) for k in range(lanes.shape[1]))
        level, x, y = np.searchsorted(LEVELS, bits), local[x], local[y]
        new = (bits <= distance) & (root[level, x] != root[level, y])
        level, x, y = level[new], x[new], y[new]
        held = np.zeros((2, 0), np.int64)
        for k in range(len(LEVELS) if len(x) else 0):
            fresh = np.stack([x[level == k], y[level == k]])
            edges = np.concatenate([fresh, held], axis=1)
            used = _joined(root[k], *edges)
            out.append(edges[:, used[used < fresh.shape[1]]])
            held = edges[:, used]
    a, b = names[np.concatenate(out, axis=1)]
    return np.maximum(a, b), np.minimum(a, b)


def links(nodes: DataFrame, distance: int = DISTANCE, lanes: int = 1, block: int = BLOCK) -> DataFrame:
    """Links a > b between distinct fingerprints (node, f0, f1...): enough to connect all that are linked.

    Homes meet visitors, so all pairs with at most one differing bit in some part meet. With one lane these are
    all pairs within four bits. With several lanes the distance counts in all of them, far pairs are found with
    high probability rather than for certain, and the links are near pairs themselves.
    """
    names, every = [f"f{i}" for i in range(lanes)], lanes * N_ANCHORS

    def values(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(n).to_numpy() for n in names], axis=1)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, visit = np.zeros(every, np.int64), np.zeros(every, np.int64)
        for b in it:
            f = values(b)
            for i in range(lanes):
                homes, _, at = anchors(np.ascontiguousarray(f[:, i]))
                home += np.bincount(homes.ravel() + i * N_ANCHORS, minlength=every)
                visit += np.bincount(at + i * N_ANCHORS, minlength=every)
        there = np.flatnonzero(visit)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(home[there]), pa.array(visit[there])], ["anchor", "homes", "visits"])

    counts = nodes.select(*names).mapInArrow(count, "anchor long, homes long, visits long").groupBy("anchor").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"))
    split_h, split_v = np.ones(every, np.int64), np.ones(every, np.int64)
    for r in counts.where((F.col("homes") > block) | (F.col("visits") > block)).collect():  # at most `every` rows
        split_h[r.anchor], split_v[r.anchor] = -(-r.homes // block), -(-r.visits // block)

    def dealt(row: np.ndarray, at: np.ndarray, salt: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a key for each block of the other side: anchor, home block, visitor block, side."""
        own, other = (split_v, split_h) if side else (split_h, split_v)
        copies = other[at]
        row, at, salt = (np.repeat(x, copies) for x in (row, at, salt))
        nth = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        mine = salt % own[at]
        return row, (at << 40 | (nth if side else mine) << 20 | (mine if side else nth)) << 1 | side

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                f, node = values(b), b.column("node").to_numpy()
                salt = _mixed(node)
                for i in range(lanes):
                    homes, row, at = anchors(np.ascontiguousarray(f[:, i]))
                    homes, at = homes + i * N_ANCHORS, at + i * N_ANCHORS
                    own = np.repeat(np.arange(len(node)), PARTS)
                    parts = [dealt(own, homes.ravel(), salt[own], 0), dealt(row, at, salt[row], 1)]
                    row, key = (np.concatenate(x) for x in zip(*parts, strict=True))
                    cols = [key, node[row], *(f[row, k] for k in range(len(names)))]
                    yield from (pa.RecordBatch.from_arrays([pa.array(c[j : j + 50_000]) for c in cols], ["key", "node", *names]) for j in range(0, len(key), 50_000))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; what belongs to the last key of a batch waits for the next."""
        held: list[tuple[np.ndarray, ...]] = []

        def done(key: np.ndarray, node: np.ndarray, side: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(key)) + 1
            a, b = [], []
            for s, e in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if e - s > 1:
                    x, y = (_near_forest if lanes > 1 else _forest)(node[s:e], f[s:e], side[s:e], int(key[s] >> 40), distance)
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in it:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            key, side = key >> 1, key & 1
            now = (key, batch.column("node").to_numpy(), side, values(batch).view(np.uint64))
            last = np.searchsorted(key, key[-1])
            if last or held and held[-1][0][-1] != key[0]:
                ready = [*held, tuple(x[:last] for x in now)]
                yield from done(*(np.concatenate(x) for x in zip(*ready, strict=True)))
                held = []
            held.append(tuple(x[last:] for x in now))
        if held:
            yield from done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt_rows = nodes.select("node", *names).mapInArrow(deal, "key long, node long" + "".join(f", {n} long" for n in names))
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt_rows.repartition(partitions, F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) for the nodes of `links` (a, b).

    Alternating large-star and small-star rounds; each is written to the shared folder. The links
    shrink to stars; it ends when a round changes nothing.
    """
    edges, before = pin(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        edges = pin(small.distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def clusters(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, f0..., root (of the component's nodes), component_id (least doc_id) for every row.

    Null and empty texts have fingerprint 0. Repeated rows share a component; a null doc_id is kept
    and names a component only if none of its members has an id. An empty table gives an empty result.
    """
    names = [f"f{i}" for i in range(lanes)]
    node = F.col("f0") if lanes == 1 else F.xxhash64(*names)
    rows = pin(fingerprints(docs, shingle, lanes, id_col, text_col).withColumn("node", node))
    nodes = pin(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(n).alias(n) for n in names)))
    tree = components(links(nodes, distance, lanes)).withColumnRenamed("node", "child")
    roots = nodes.join(tree, nodes.node == F.col("child"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return rows.join(named, "node").select("doc_id", "text_key", *names, "root", "component_id")


#: The near-duplicate filter: words of a shingle, least part of the shingles shared (Jaccard), and for the
#: candidates: lanes, and differing bits in all.
NEAR_SHINGLE, NEAR_SHARED, NEAR_LANES, NEAR_DISTANCE = 5, 0.8, 3, 30
#: Pairs of whole texts that a Python worker takes at a time.
PAIR_ROWS = 64


def shingles(text: str | None, shingle: int = NEAR_SHINGLE) -> frozenset[bytes]:
    """The distinct word shingles that `fingerprint` hashes; none if there are no words."""
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def shared(a: frozenset[bytes], b: frozenset[bytes]) -> float:
    """Jaccard similarity; two empty sets are alike."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def verified(pairs: DataFrame, docs: DataFrame, shingle: int = NEAR_SHINGLE, least: float = NEAR_SHARED, text_col: str = "text") -> DataFrame:
    """The pairs (a, b: hashes of texts) whose whole texts share `least` of their shingles.

    Only texts in some pair are moved, one row for each, whatever its number of copies.
    """
    spark = docs.sparkSession
    needed = pin(pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct())
    texts = only(docs, text=text_col).select(F.xxhash64("text").alias("node"), "text")
    texts = stored(texts.join(small(needed), "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_b = None, frozenset()
        for batch in it:
            keep = []
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if b != last:  # rows come sorted by b
                    last, of_b = b, shingles(y.as_py(), shingle)
                keep.append(shared(shingles(x.as_py(), shingle), of_b) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(PAIR_ROWS))
    try:
        return pin(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))
    finally:
        spark.conf.set(key, before)


#: Slots of the table of shingle frequencies that orders a text's shingles; they steer cost, never the result.
SLOTS = 1 << 20
#: Pairs of one key that are laid out at a time.
PAIRS = 1 << 20


def hashes(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """XXH64 of the distinct shingles; of the empty string if there are no words, so such texts meet."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s, SEED) for s in shingles(text, shingle) or (b"",)], np.uint64)


def frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many of the texts' distinct shingles fall into each of `SLOTS` slots of their hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in it:
            found = [hashes(t) >> np.uint64(44) for t in b.column(0).to_pylist()]
            if found:
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=SLOTS)
        there = np.flatnonzero(total)
        for i in range(0, len(there), 100_000):
            at = there[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    got = docs.select(text_col).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def prefix(h: np.ndarray, often: np.ndarray, least: float = NEAR_SHARED) -> np.ndarray:
    """The rarest of a text's shingles, in order: as many that two texts which share `least` have their first common one in both."""
    n = len(h)
    return h[np.lexsort((h, often[(h >> np.uint64(44)).astype(np.int64)]))[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def _pairs_apart(key: np.ndarray, root: np.ndarray, node: np.ndarray, nth: np.ndarray, size: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Pairs (a > b) of one key and different roots whose sizes and places allow `least`; rows come sorted by key and root."""
    edge = np.flatnonzero(np.diff(key)) + 1
    run = np.union1d(edge, np.flatnonzero(np.diff(root)) + 1)
    row = np.arange(len(key))
    start = np.append(run, len(key))[np.searchsorted(run, row, "right")]
    end = np.append(edge, len(key))[np.searchsorted(edge, row, "right")]
    at = np.flatnonzero(end > start)
    many = (end - start)[at]
    total = np.cumsum(many)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        x = np.repeat(at[i:j], many[i:j])
        y = np.arange(len(x)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j]) + np.repeat(start[at[i:j]], many[i:j])
        i = j
        low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        need = np.ceil(least / (1 + least) * (low + high) - 1e-9)
        ok = (low >= np.ceil(least * high - 1e-9)) & (np.minimum(size[x] - nth[x], size[y] - nth[y]) >= need)
        x, y = node[x[ok]], node[y[ok]]
        if len(x):
            yield np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)


def sharing(docs: DataFrame, rooted: DataFrame, least: float = NEAR_SHARED, text_col: str = "text") -> DataFrame:
    """All pairs (a > b) of texts of different roots that can share `least` of their shingles: an exact prefix filter.

    Texts that share so much have a shingle in common among the rarest fifth of each, in any order that all texts
    agree on; here rare ones come first. `rooted`: node (hash of a text), root.
    """
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(frequencies(docs, text_col))
    texts = only(docs, text=text_col).select(F.xxhash64("text").alias("node"), "text").dropDuplicates(["node"]).join(rooted.select("node", "root"), "node")
    names = ["key", "root", "node", "place"]  # place: number among the text's prefix, and shingles of the text

    def post(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                size, keys = [], []
                for t in b.column("text").to_pylist():
                    h = hashes(t)
                    size.append(len(h))
                    keys.append(prefix(h, often.value, least).view(np.int64))
                each = np.array([len(k) for k in keys])
                nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                cols = [np.concatenate(keys), *(np.repeat(b.column(n).to_numpy(), each) for n in ("root", "node")), nth << 32 | np.repeat(np.array(size, np.int64), each)]
                yield from (pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in cols], names) for i in range(0, len(nth), 50_000))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What belongs to the last key of a batch waits for the next."""
        held: list[tuple[np.ndarray, ...]] = []

        def done() -> Iterator[pa.RecordBatch]:
            key, root, node, place = (np.concatenate(x) for x in zip(*held, strict=True))
            for a, b in _pairs_apart(key, root, node, place >> 32, place & (1 << 32) - 1, least):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in it:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(n).to_numpy() for n in names)
            last = np.searchsorted(now[0], now[0][-1])
            if last or held and held[-1][0][-1] != now[0][0]:
                held.append(tuple(x[:last] for x in now))
                yield from done()
                held = []
            held.append(tuple(x[last:] for x in now))
        if held:
            yield from done()

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(post, "key long, root long, node long, place long")
    return rows.repartition(partitions, "key").sortWithinPartitions("key", "root").mapInArrow(compare, "a long, b long").distinct()


#: Counts in a text's sketch: its shingles by nine bits of their hashes, 255 at most.
SKETCH = 512


def possible(pairs: DataFrame, docs: DataFrame, least: float = NEAR_SHARED, text_col: str = "text") -> DataFrame:
    """Those of the pairs (a, b) whose sketches allow `least`, so that fewer whole texts are moved.

    Sketches differ by no more than the number of shingles that only one of the texts has: none that share so much goes.
    """
    needed = pin(pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct())
    texts = only(docs, text=text_col).select(F.xxhash64("text").alias("node"), "text").join(small(needed), "node", "left_semi").dropDuplicates(["node"])

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [hashes(t) for t in b.column("text").to_pylist()]
            made = [np.minimum(np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes() for h in found]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(h) for h in found], pa.int64()), pa.array(made, pa.binary())], ["node", "size", "sketch"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = (np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for n in ("sketch_a", "sketch_b"))
            both = b.column("size_a").to_numpy() + b.column("size_b").to_numpy()
            yield b.select(["a", "b"]).filter(pa.array((both - np.abs(x - y).sum(axis=1)) / 2 >= least / (1 + least) * both - 1e-6))

    made = pin(texts.mapInArrow(sketch, "node long, size long, sketch binary"))
    both = pairs
    for n in ("a", "b"):
        both = both.join(made.toDF(n, f"size_{n}", f"sketch_{n}").hint("merge"), n)
    return both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of least id of each group of near copies, with all columns of `docs`.

    Texts are linked if they share 0.8 of their distinct five-word shingles, compared in whole. Anchors find most
    links among distinct texts (those at 0.8 differ in 0.15 of the bits on average), so that large groups are
    never expanded; then every pair of different groups that can share 0.8 is found by a prefix filter and
    compared, so the groups are those of brute force. Of repeated rows one is kept.
    Texts without words (null, empty) are alike. An empty table gives an empty result.
    """
    names = [f"f{i}" for i in range(NEAR_LANES)]
    rows = pin(fingerprints(docs, NEAR_SHINGLE, NEAR_LANES, id_col, text_col, distinct=True))
    nodes = pin(rows.groupBy(F.col("text_key").alias("node")).agg(*(F.first(n).alias(n) for n in names)))
    pairs = pin(links(nodes, NEAR_DISTANCE, NEAR_LANES))
    tree = components(verified(pairs, docs, text_col=text_col))
    rooted = pin(nodes.join(tree.withColumnRenamed("node", "child"), nodes.node == F.col("child"), "left").select("node", F.coalesce("root", "node").alias("root")))
    more = pin(sharing(docs, rooted, text_col=text_col).join(pairs, ["a", "b"], "left_anti"))
    more = verified(pin(possible(more, docs, text_col=text_col)), docs, text_col=text_col)
    if not more.isEmpty():
        tree = components(tree.toDF("a", "b").union(more))
    tree = tree.withColumnRenamed("node", "child")
    c = rows.select("doc_id", "text_key").join(tree, rows.text_key == F.col("child"), "left").withColumn("root", F.coalesce("root", "text_key"))
    first = pin(c.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key"))
    keyed = docs.select(F.struct(*columns(docs)).alias("row"))  # no column of docs meets ours
    met = keyed.join(first, F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")) & (F.xxhash64(f"row.`{text_col}`") == F.col("text_key")))
    return met.dropDuplicates(["doc_id", "text_key"]).select("row.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
