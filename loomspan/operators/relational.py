"""Relational operators that analyses share; each is a plan over DataFrames."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.durable import LOCAL_EDGES, pin, small, stored

#: Edges a node that are enough to connect most of a graph which has many more.
DENSE = 4


def used_anti(declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Declared rows whose composite key is not used; a null key is never used."""
    return declared.join(used.select(*keys).distinct(), keys, "left_anti")


def duplicate_groups(rows: DataFrame, keys: list[str], place: str, least: int = 2, least_places: int = 1, name: str | None = None) -> DataFrame:
    """Groups of equal keys with n rows in so many places, and the confidence: high if all have one name."""
    places = F.countDistinct(place)
    confidence = F.when(F.countDistinct(name) <= 1, "high").otherwise("medium") if name else F.lit("high")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), places.alias("places"), confidence.alias("confidence")).where((F.col("n") >= least) & (F.col("places") >= least_places))


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has; null keys are never unique."""
    return rows.join(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("times")).where("times = 1").select(key), key, "left_semi")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark's window group limit drops the rest before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`rows` with place (from 0, in `order` within each key) and n (rows of the key).

    The order is a total one. Rows are sorted as a whole, so a key with many of them is spread over
    partitions; each partition's rows of a key are counted, and only the counts are added up by key.
    """
    line = pin(rows.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = line.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    by_key = Window.partitionBy(*keys)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_n").over(by_key))
    met = line.withColumn("_part", part).alias("l").join(small(pin(counts)).alias("c"), [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_part"]])
    return met.select("l.*", (F.col("_before") + F.col("_at") - F.col("_first")).alias("place"), "n").drop("_at", "_part")


def stride_sample(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` evenly spaced rows of each key, in `order` (a total one)."""
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(most)))
    return ranked(rows, keys, order).where(F.col("place") % stride == 0).drop("n")


def consecutive(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Each row beside the next one of its key: the keys, and `columns` as they are and with the prefix next_.

    A self join on key and place, so it yields one row for each, however many rows a key has.
    """
    here = pin(ranked(rows.select(*keys, *columns), keys, order))
    after = here.select(*keys, (F.col("place") - 1).alias("place"), *(F.col(c).alias(f"next_{c}") for c in columns))
    return here.join(after, [*keys, "place"]).select(*keys, *columns, *(f"next_{c}" for c in columns))


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, separator: str = " ") -> DataFrame:
    """Each row with its longest matching prefix of whole parts, or null.

    Every leading run of a distinct text's parts is a candidate for an equi-join; the longest that matches wins.
    """
    parts = F.split(F.col(text), separator)
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    texts = rows.select(text).where(F.col(text).isNotNull()).distinct()
    found = texts.select(text, F.explode(steps).alias(prefix)).join(small(prefixes.select(prefix).distinct()), prefix)
    return rows.join(found.groupBy(text).agg(F.max_by(prefix, F.length(prefix)).alias(prefix)), text, "left")


def contained(inner: DataFrame, outer: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Rows of `inner` with `at` within a span of `outer` of the same key; all three are whole numbers.

    A span of up to 2^l places lies in two blocks of that size at most, so it yields two rows however wide it is, and a
    place looks into one block of each size that occurs (64 at most). A block's spans fill a quarter of its places or
    more, so few pairs that meet don't match; a block with many rows is split by Spark like any skewed join.
    """
    size = F.when(F.col(end) > F.col(start), F.ceil(F.log2((F.col(end) - F.col(start) + 1).cast("double")))).otherwise(0).cast("int")
    spans = outer.where(F.col(end) >= F.col(start)).select(F.col(key).alias("_key"), F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"), size.alias("_size"))
    spans = spans.withColumn("_block", F.explode(F.sequence(F.expr("shiftright(_start, _size)"), F.expr("shiftright(_end, _size)"))))
    sizes = sorted(r[0] for r in spans.select("_size").distinct().collect())
    within = F.col("_at").between(F.col("_start"), F.col("_end"))

    def blocks(points: DataFrame) -> DataFrame:
        return points.withColumn("_where", F.explode(F.array(*(F.struct(F.lit(n).alias("_size"), F.shiftright("_at", n).alias("_block")) for n in sizes))))

    def met(points: DataFrame) -> DataFrame:
        return points.join(spans, (F.col("_point") == F.col("_key")) & (F.col("_where._size") == F.col("_size")) & (F.col("_where._block") == F.col("_block")) & within, "left_semi")

    if not sizes:
        return inner.where("false")
    keyed = inner.withColumns({"_point": F.col(key), "_at": F.col(at).cast("long")})
    if len(sizes) == 1:
        return met(blocks(keyed)).drop("_point", "_at", "_where")
    found = met(blocks(keyed.select("_point", "_at").distinct())).select("_point", "_at").distinct()
    return keyed.join(found, ["_point", "_at"], "left_semi").drop("_point", "_at")


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """`points` with start and end of the last span of the same keys to begin at or before `at` that is still open there, or null.

    Of nested spans that is the innermost, so a name that is used binds to the declaration of the nearest scope around it;
    of spans that begin together the shortest. Points and spans are sorted together and swept once with a stack, as many
    rows as both have; keys with many pass through a task as a stream. `at`, `start` and `end` are whole numbers; null
    keys and places have no span around them.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    fine = points.where(" and ".join(f"`{c}` is not null" for c in [*keys, at]))
    both = fine.select(*named, F.col(at).cast("long").alias("_at"), F.lit(None).cast("long").alias("_end")).distinct().unionByName(spans.where(F.col(end) >= F.col(start)).select(*named, F.col(start).cast("long").alias("_at"), F.col(end).cast("long").alias("_end")))
    by = [f"_k{i}" for i in range(len(keys))]
    swept = both.repartition(*by).sortWithinPartitions(*by, "_at", F.desc_nulls_last("_end"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for b in it:
            keep, starts, ends = [], [], []
            for *k, place, last in zip(*(b.column(c).to_pylist() for c in (*by, "_at", "_end")), strict=True):
                if k != now:
                    now, open_ = k, []
                keep.append(last is None)
                if last is not None:
                    open_.append((place, last))
                    continue
                while open_ and open_[-1][1] < place:
                    open_.pop()
                starts.append(open_[-1][0] if open_ else None)
                ends.append(open_[-1][1] if open_ else None)
            kept = b.filter(pa.array(keep, pa.bool_())).drop_columns(["_end"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [*kept.schema.names, start, end])

    kinds = [*(f"{c} {spans.schema[k].dataType.simpleString()}" for c, k in zip(by, keys, strict=True)), "_at long", f"`{start}` long", f"`{end}` long"]
    found = swept.mapInArrow(run, ", ".join(kinds))
    return points.join(found, [F.col(k) == F.col(c) for k, c in zip([*keys, at], [*by, "_at"], strict=True)], "left").drop(*by, "_at")


def covered(rows: DataFrame, keys: list[str], start: str, end: str, weight: str) -> DataFrame:
    """Rows whose span lies within that of another row of the same keys with a greater weight; no column is null.

    One pass over each key's rows in the order of their starts holds the ends so far that no later end with more weight
    makes needless, so n rows take n steps and no pair is made. Keys with many rows pass through a task as a stream.
    """
    order = [F.asc(start), F.desc(end), F.desc(weight)]
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, weights = None, [], []  # ends ascend, the weights of what ends there or later descend
        for b in it:
            keep = []
            for *k, e, w in zip(*(b.column(c).to_pylist() for c in (*keys, end, weight)), strict=True):
                if k != now:
                    now, ends, weights = k, [], []
                i = bisect_left(ends, e)
                best = weights[i] if i < len(ends) else None
                keep.append(best is not None and best > w)
                if best is None or best < w:
                    j = i + (i < len(ends) and ends[i] == e)
                    while i > 0 and weights[i - 1] <= w:
                        i -= 1
                    ends[i:j], weights[i:j] = [e], [w]
            yield b.filter(pa.array(keep, pa.bool_()))

    return sorted_rows.mapInArrow(run, rows.schema)


def apart(rows: DataFrame, keys: list[str], at: str, width: str) -> DataFrame:
    """Of each key's rows in the order of `at`, those that begin behind the end of the last one kept: a stream a key."""
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, at)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, 0
        for b in it:
            keep = []
            for *k, a, w in zip(*(b.column(c).to_pylist() for c in (*keys, at, width)), strict=True):
                keep.append(k != now or a >= end)
                if keep[-1]:
                    now, end = k, a + w
            yield b.filter(pa.array(keep, pa.bool_()))

    return sorted_rows.mapInArrow(run, rows.schema)


def matching(rows: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Rows beside each regular expression that their text fits: a theta join, with the patterns broadcast once counted."""
    if patterns.limit(1001).count() > 1000:
        raise ValueError("more than 1000 patterns: join on a part that is equal first")
    return rows.join(F.broadcast(patterns), F.expr(f"{text} rlike {pattern}"))


def first_candidate(asked: DataFrame, candidates: str, keyed: DataFrame, by: list[str]) -> DataFrame:
    """`asked` with the path of the first of its ranked candidates (an array of keys) that exists, or null.

    keyed: key, rank, path. Candidates meet them by equality; the earliest one wins, of one key the least rank.
    """
    best = keyed.groupBy("key").agg(F.min_by("path", F.struct("rank", "path")).alias("path"), F.min(F.struct("rank", "path")).alias("rank"))  # a row a key, so no more rows than candidates meet
    met = asked.select(*by, F.posexplode(candidates).alias("nth", "key")).join(best, "key")
    return asked.join(met.groupBy(*by).agg(F.min_by("path", F.struct("nth", "rank", "path")).alias("to")), by, "left").drop(candidates)


def _few(edges: DataFrame, most: int) -> bool:
    return edges.limit(most + 1).count() <= most


def _in_one_task(edges: DataFrame, work: Callable[[dict[object, list]], list[tuple]], columns: list[str]) -> DataFrame:
    """What `work` makes of the neighbours of each node, in a single task; for counted edge sets only.

    The columns have the type of a node.
    """
    kind = edges.schema["src"].dataType
    schema = T.StructType([T.StructField(c, kind) for c in columns])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after: dict[object, list] = {}
        types = None
        for b in it:
            types = b.schema.field("src").type
            for s, d in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
                after.setdefault(s, []).append(d)
                after.setdefault(d, [])
        made = work({k: sorted(set(v)) for k, v in sorted(after.items())}) if after else []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, types) for c in zip(*made, strict=True)], columns)

    return edges.select("src", "dst").repartition(1).mapInArrow(run, schema)


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int = 1000, patience: int = 3, few: int = 0) -> DataFrame:
    """Nodes reachable from seeds (column node) over edges (src, dst): semi-naive, a frontier join a round.

    After `patience` rounds one edge of each node that is left leads on as a jump, and jumps double each round: all known
    nodes take the newest jumps, new ones the older as well. So a path whose edges are jumps is walked in as many rounds
    as its length has binary digits, and others take a few rounds for each edge that is none. Only frontiers and jumps are
    written, each to the shared folder, and once the edges, in columns; it ends when a frontier is empty. Given `few`, it also ends when a frontier has no more
    nodes than that and all have five times as many: then some may lack.
    """
    edges = stored(edges.select("src", "dst").distinct())
    known = frontier = pin(seeds.select("node").distinct())
    jumps: list[DataFrame] = []
    most = found = 0

    def ahead(over: DataFrame, nodes: DataFrame) -> DataFrame:
        return over.join(nodes, over["src"] == nodes["node"], "left_semi").select(F.col("dst").alias("node"))

    for nth in range(rounds):
        steps = ahead(edges, frontier)
        if nth == patience:  # what a known node leads to is known, so these begin at new or unknown ones
            left = edges.where("src <> dst").join(known, edges["dst"] == known["node"], "left_anti")
            jumps.append(pin(left.groupBy("src").agg(F.min_by("dst", F.xxhash64("src", "dst")).alias("dst"))))
            most = jumps[0].count()
        elif jumps and 2 ** len(jumps) <= most:
            then = jumps[-1].select(F.col("src").alias("via"), F.col("dst").alias("to"))
            jumps.append(pin(jumps[-1].join(then, F.col("dst") == F.col("via")).select("src", F.col("to").alias("dst"))))
        if jumps:
            steps = steps.unionByName(ahead(jumps[-1], known))
        for older in jumps[:-1]:
            steps = steps.unionByName(ahead(older, frontier))
        frontier = pin(steps.distinct().join(known, "node", "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
        if few:
            found += (count := frontier.count())
            if count <= few and found > 5 * few:
                return known
    raise RuntimeError(f"not closed after {rounds} rounds")


def closure(edges: DataFrame, seeds: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """As `reachable`; a graph of few edges (counted) is walked in one task, whatever its diameter."""
    if not _few(edges, local_edges):
        return reachable(edges, seeds)
    start = seeds.select(F.col("node").alias("src"), F.col("node").alias("dst")).withColumn("seed", F.lit(True))
    both = edges.select("src", "dst").withColumn("seed", F.lit(False)).unionByName(start)
    schema = T.StructType([T.StructField("node", seeds.schema["node"].dataType)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after: dict[object, list] = {}
        known: set = set()
        types = None
        for b in it:
            types = b.schema.field("src").type
            for s, d, seed in zip(*(b.column(c).to_pylist() for c in ("src", "dst", "seed")), strict=True):
                if seed:
                    known.add(s)
                else:
                    after.setdefault(s, []).append(d)
        down = list(known)
        while down:
            for d in after.pop(down.pop(), ()):
                if d not in known:
                    known.add(d)
                    down.append(d)
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(list(known), types)], ["node"])

    return pin(both.repartition(1).mapInArrow(run, schema))


def _connected(after: dict[object, list]) -> list[tuple]:
    root = {n: n for n in after}

    def find(n: object) -> object:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, those in after.items():
        for b in those:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [(n, find(n)) for n in after]


def components(edges: DataFrame, rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, component (least node connected with it), by alternating large-star and small-star rounds.

    A graph of few edges (counted) is joined up in one task.
    """
    if _few(edges, local_edges):
        return _in_one_task(edges.select("src", "dst"), _connected, ["node", "component"])
    pairs, before = pin(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()), None
    nodes = pin(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    pairs = pairs.where("u <> v")
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        made = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs = pin(made.select("e.u", "e.v").where("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return nodes.join(pairs, nodes.node == pairs.u, "left").select("node", F.coalesce("v", "node").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _strong(after: dict[object, list]) -> list[tuple]:
    """(node, least node of its component) for components of two nodes or more: depth first, with low links."""
    number: dict[object, int] = {}
    low: dict[object, int] = {}
    held: list = []
    on: set = set()
    out = []
    for start in after:
        if start in number:
            continue
        work = [(start, iter(after[start]))]
        number[start] = low[start] = len(number)
        held.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for d in rest:
                if d not in number:
                    number[d] = low[d] = len(number)
                    held.append(d)
                    on.add(d)
                    work.append((d, iter(after[d])))
                    break
                if d in on:
                    low[node] = min(low[node], number[d])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    group = [held.pop()]
                    while group[-1] != node:
                        group.append(held.pop())
                    on.difference_update(group)
                    if len(group) > 1:
                        least = min(group)
                        out += [(n, least) for n in group]
    return out


def strongly_connected(edges: DataFrame, local_edges: int = LOCAL_EDGES, rounds: int = 200) -> DataFrame:
    """node, scc (least node of it) for components of two nodes or more.

    A graph of few edges (counted) is walked in one task. Beyond that, where nodes have many edges, groups of nodes that a
    share of the edges already connects both ways become one node each, and then all edges go on between those. Each round
    gives every node the first, in an order drawn anew by hash, of the nodes that reach it; a component lies within one
    label, so edges between labels go, and of each label the nodes that reach its first one are a component. With the
    order drawn by chance, rounds grow with the logarithm of a chain of components. It raises an error
    rather than return fewer components.
    """
    left = stored(edges.select("src", "dst").where("src <> dst").distinct())
    if _few(left, local_edges):
        return pin(_in_one_task(left, _strong, ["node", "scc"]))
    return _contracted(left, rounds)


def _contracted(left: DataFrame, rounds: int) -> DataFrame:
    """As `_spread`, of fewer edges where nodes have many: `_knots` of a share of them are drawn together, as long as a tenth of the edges goes."""
    count, sources = left.agg(F.count("*"), F.approx_count_distinct("src")).first()
    share = count // (DENSE * max(sources, 1))
    if share < 2:
        return _spread(left, rounds)
    knots = _knots(stored(left.where(F.pmod(F.xxhash64("src", "dst"), F.lit(share)) == 0)), max(1, sources // 50))
    for end in ("src", "dst"):
        left = left.join(knots.select(F.col("node").alias(end), F.col("scc").alias(f"_{end}")), end, "left")
    left = left.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
    left = stored(left.where("src <> dst").distinct())
    wider = (_contracted if 10 * left.count() < 9 * count else _spread)(left, rounds)
    found = knots.join(wider.select(F.col("node").alias("scc"), F.col("scc").alias("_scc")), "scc", "left").select("node", F.coalesce("_scc", "scc").alias("scc"))
    return pin(found.unionByName(wider.join(knots, "node", "left_anti").select("node", "scc")))


def _knots(edges: DataFrame, few: int) -> DataFrame:
    """node, scc (least node of it) for sets of nodes that reach one another: as a round of `_spread`, without the last steps, that add `few` nodes or less."""
    first = _first_that_reaches(edges, 0, rounds=40, few=few)
    return _reaching_back(_within(edges, first), first, patience=16, few=few).where("n > 1").select("node", "scc")


def _within(edges: DataFrame, first: DataFrame) -> DataFrame:
    """The edges within a label."""
    a = first.select(F.col("node").alias("src"), F.col("label").alias("a"))
    b = first.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    return stored(edges.join(a, "src").join(b, "dst").where("a = b").select("src", "dst"))


def _reaching_back(within: DataFrame, first: DataFrame, patience: int = 3, few: int = 0) -> DataFrame:
    """node, scc, n: of each label the nodes that reach its first one, the least of them and how many they are."""
    back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    group = reachable(back, first.where("leads").select("node"), patience=patience, few=few).join(first.select("node", "label"), "node")
    return pin(group.join(group.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("scc")), "label").select("node", "scc", "n"))


def _spread(left: DataFrame, rounds: int) -> DataFrame:
    """As `strongly_connected`, of distinct edges between different nodes."""
    out = left.select(F.col("src").alias("node"), F.col("src").alias("scc")).where("false")
    for nth in range(rounds):
        count, turns = left.count(), 0
        while count:  # only nodes with edges both ways can lie on a cycle
            left = stored(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            now, turns = left.count(), turns + 1
            if now == count:
                break
            if turns % 3 == 0 and now:  # long ways would go an edge a turn
                left, rings = _without_chains(left)
                out = pin(out.unionByName(rings))
                now = left.count()
            count = now
        if not count:
            return out
        first = _first_that_reaches(left, nth)
        within = _within(left, first)
        group = _reaching_back(within, first)
        out = pin(out.unionByName(group.where("n > 1").select("node", "scc")))
        left = stored(within.join(group.select(F.col("node").alias("src")), "src", "left_anti").join(group.select(F.col("node").alias("dst")), "dst", "left_anti"))
    raise RuntimeError(f"components left after {rounds} rounds")


def _without_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges left without chains that lead to an end or a ring, and the rings: node, scc.

    A node with one way out points to where that leads, and pointers double each round until as many nodes are pointed to as
    before: those lie on rings. No edge leaves a ring of such nodes, so it is a component; what flows into one, or into a
    node without a way out, lies on no cycle. A chain takes as many rounds as its length has binary digits. Then the same
    against the edges' direction.
    """
    rings = edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).where("false")
    for a, b in (("src", "dst"), ("dst", "src")):
        ways = pin(edges.groupBy(F.col(a).alias("node")).agg(F.count("*").alias("n"), F.min(b).alias("to")))
        single = ways.where("n = 1").select("node", "to")
        more = ways.select(F.col("node").alias("to"), (F.col("n") == 1).alias("open"))
        ahead = pin(single.join(more, "to", "left").select("node", "to", F.coalesce("open", F.lit(False)).alias("open"), F.col("open").isNull().alias("ended")))
        before, pointed = None, ahead.where("open").select("to").distinct().count()
        while pointed and pointed != before:
            then = ahead.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("open").alias("_open"), F.col("ended").alias("_ended"))
            ahead = pin(ahead.join(then, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), F.coalesce("_open", F.lit(False)).alias("open"), F.coalesce("_ended", "ended").alias("ended")))
            before, pointed = pointed, ahead.where("open").select("to").distinct().count()
        if pointed:
            on = ahead.where("open").select(F.col("to").alias("node")).distinct()
            ring = pin(single.join(on, "node", "left_semi").select("node", "to", F.col("node").alias("scc")))
            least, now = None, ring.agg(F.sum(F.xxhash64("node", "scc").cast("decimal(38,0)"))).first()
            while now != least:  # the least of what lies between a node and its pointer, until that is the same all around
                then = ring.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("scc").alias("_scc"))
                ring = pin(ring.join(then, "to").select("node", F.col("_to").alias("to"), F.least("scc", "_scc").alias("scc")))
                least, now = now, ring.agg(F.sum(F.xxhash64("node", "scc").cast("decimal(38,0)"))).first()
            rings = rings.unionByName(ring.select("node", "scc"))
        gone = ahead.where("open or ended").select("node")
        edges = pin(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return edges, rings


def _first_that_reaches(edges: DataFrame, salt: int, rounds: int = 1000, few: int = 0) -> DataFrame:
    """node, label: the least hash of those that reach the node; leads: whether that is its own.

    Hashes are numbers, so that labels are aggregated without a sort, and drawn anew should two nodes share one. Only labels that
    are new are sent on. Given `few`, it ends when no more are, or after all rounds: some labels then are hashes of nodes that reach theirs, but not the least.
    """
    nodes = pin(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    while not nodes.groupBy(F.xxhash64("node", F.lit(salt))).count().where("count > 1").isEmpty():
        salt += 1_000_003
    own = F.xxhash64("node", F.lit(salt))
    labels = nodes.select("node", own.alias("label"), F.lit(True).alias("new"))
    for _ in range(rounds):
        sent = edges.join(labels.where("new"), edges["src"] == labels["node"]).select(F.col("dst").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        both = labels.select("node", "label", F.col("label").alias("old")).unionByName(sent)
        labels = pin(both.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")).select("node", "label", (F.col("label") < F.col("old")).alias("new")))
        if labels.where("new").count() <= few:
            break
    else:
        if not few:
            raise RuntimeError("labels did not settle")
    return labels.select("node", "label", (F.col("label") == own).alias("leads"))


def _elementary(after: dict[object, list], most: int) -> list[list]:
    """Up to `most` elementary cycles of a strongly connected graph, each from its least node on, by least node.

    A node from which the start was not reached stays closed until one behind it opens again, so no part of
    the graph is searched in vain twice.
    """
    found: list[list] = []
    for start in sorted(after):
        inside = {n for n in after if n >= start}
        path, closed, waiting = [start], {start}, {}
        work = [(start, [d for d in after[start] if d in inside], [False])]
        while work:
            node, rest, hit = work[-1]
            if rest and len(found) < most:
                d = rest.pop(0)
                if d == start:
                    found.append([*path])
                    hit[0] = True
                elif d not in closed:
                    path.append(d)
                    closed.add(d)
                    work.append((d, [x for x in after[d] if x in inside], [False]))
                continue
            if hit[0]:
                opened = [node]
                while opened:
                    x = opened.pop()
                    closed.discard(x)
                    opened += waiting.pop(x, ())
            else:
                for d in after[node]:
                    if d in inside:
                        waiting.setdefault(d, set()).add(node)
            work.pop()
            path.pop()
            if work and hit[0]:
                work[-1][2][0] = True
        if len(found) >= most:
            break
    return found


def elementary_cycles(edges: DataFrame, per_component: int = 20, most: int = 200, largest: int = 50) -> DataFrame:
    """nodes (from the least on) of elementary cycles of two nodes or more, the shortest first.

    Reports take at most `per_component` of a component and `most` in all, the smallest components first;
    components with more than `largest` nodes are left out, as they have too many cycles to read.
    """
    scc = strongly_connected(edges)
    sizes = scc.groupBy("scc").agg(F.count("*").alias("size"))
    inside = edges.select("src", "dst").where("src <> dst").distinct().join(scc.select(F.col("node").alias("src"), "scc"), "src").join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("other")), "dst").where("scc = other")
    inside = inside.join(sizes.where(F.col("size") <= largest), "scc").select("scc", "size", "src", "dst")
    kind = edges.schema["src"].dataType
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("nodes", T.ArrayType(kind))])

    def run(rows: pa.Table) -> pa.Table:
        after: dict[object, list] = {}
        for s, d in zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist(), strict=True):
            after.setdefault(s, []).append(d)
        found = _elementary({k: sorted(v) for k, v in after.items()}, per_component)
        size = rows.column("size")[0].as_py()
        return pa.table({"size": pa.array([size] * len(found), pa.int64()), "nodes": pa.array(found, pa.list_(rows.schema.field("src").type))})

    made = pin(inside.groupBy("scc").applyInArrow(run, schema))
    return made.orderBy("size", "nodes").limit(most).orderBy(F.size("nodes"), "nodes").select("nodes")


def short_cycles(edges: DataFrame, length: int) -> DataFrame:
    """nodes (from the least on) of all elementary cycles of two to `length` nodes, by joins of rooted paths.

    From each node, as the least of its cycles, paths over greater nodes go half the way forward and half the way back;
    those that meet in a node and share no other are a cycle. Edges that lie on no cycle, as nothing leads to them or on
    from them, go first. No component is gathered; paths of half the length are the most that is made.
    """
    left = pin(edges.select("src", "dst").where("src <> dst").distinct())
    count = left.count()
    while count:
        left = pin(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, count = count, left.count()
        if count == before:
            break
    back = left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    def paths(over: DataFrame, steps: int) -> list[DataFrame]:
        """Of 1, 2, ... edges: root, end, inner (the nodes between)."""
        out = [over.where("dst > src").select(F.col("src").alias("root"), F.col("dst").alias("end"), F.array().cast(T.ArrayType(over.schema["dst"].dataType)).alias("inner"))]
        for _ in range(steps - 1):
            longer = out[-1].join(over, F.col("end") == F.col("src")).where((F.col("dst") > F.col("root")) & (F.col("dst") != F.col("end")) & ~F.array_contains("inner", F.col("dst")))
            out.append(pin(longer.select("root", F.col("dst").alias("end"), F.concat("inner", F.array("end")).alias("inner"))))
        return out

    there, back_again = paths(left, (length + 1) // 2), paths(back, max(length // 2, 1))
    found = None
    for n in range(2, length + 1):
        a = there[(n + 1) // 2 - 1]
        b = back_again[n // 2 - 1].withColumnRenamed("inner", "home")
        met = a.join(b, ["root", "end"]).where(~F.arrays_overlap("inner", "home")).select(F.concat(F.array("root"), F.col("inner"), F.array("end"), F.reverse("home")).alias("nodes"))
        found = met if found is None else found.unionByName(met)
    return found
