"""Centroid clustering: Lloyd's rounds by a dual-tree walk.

Vectors lie in blocks of bounded size, each with a cover tree that is built once and stored; every round builds
one over the centroids and walks the pairs of a vector node and a centroid node. A pair goes when no vector below
the one can be nearest to a centroid below the other; a node that one centroid is left to is assigned as a whole, by
a difference of running sums, and pairs of leaves are compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import only, pin, stored

#: Vectors of a block, whose tree one task holds with the distances between them.
BLOCK = 1024
#: Largest integer component: squared distances of a few hundred of them fit 64 bits.
LARGEST = 2**27


class Tree(NamedTuple):
    """A cover tree. Node i holds the points order[lo[i]:hi[i]], its own one first, within radius[i] of that.

    Its children are kids[first[i]:first[i + 1]], the first of them with the same point; a leaf has none, and
    only points equal to its own.
    """

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    kids: np.ndarray


def cover_tree(points: np.ndarray) -> Tree:
    """The tree of integer points (n x dim, n > 0).

    The net of level l holds that of level l + 1, lies more than 2^l apart and has every point within 2^l; a
    point that is new in a net hangs below the nearest point of the net before.
    """
    n = len(points)
    x = points.astype(np.float64)
    norms = (x * x).sum(1)
    apart = np.sqrt(np.maximum(norms[:, None] + norms - 2 * (x @ x.T), 0))
    scale = float(apart.max()) * 1e-7  # what rounding may leave of a distance of zero
    near, at = apart[0].copy(), np.zeros(n, dtype=np.int64)  # to the net so far, and its nearest point
    below: dict[int, list[list[int]]] = {0: []}  # for each net point, by level, the points that hang below it
    level = int(np.ceil(np.log2(apart.max()))) if apart.max() > scale else 0
    while near.max() > scale:
        level -= 1
        new: list[int] = []
        parents = at.copy()
        while near.max() > max(2.0**level, scale):
            far = int(near.argmax())
            new.append(far)
            closer = apart[far] < near
            near[closer], at[closer] = apart[far][closer], far
            near[far], at[far] = 0, far
        hung: dict[int, list[int]] = {}
        for p in new:
            hung.setdefault(int(parents[p]), []).append(p)
            below[p] = []
        for p, those in hung.items():
            below[p].append(those)
    same: dict[int, list[int]] = {}
    for p in np.flatnonzero(at != np.arange(n)).tolist():
        same.setdefault(int(at[p]), []).append(p)

    order: list[int] = []
    lo, hi, own, kids_of = [0], [0], [0], [[]]
    work = [(0, 0, 0, False)]  # node, its point, how many of the levels below it are spent, and whether it is done
    while work:
        node, p, spent, done = work.pop()
        if done:
            hi[node] = len(order)
            continue
        lo[node] = len(order)
        if spent == len(below[p]):
            order += [p, *same.get(p, ())]
            hi[node] = len(order)
            continue
        work.append((node, p, spent, True))
        made = []
        for q, used in [(p, spent + 1), *((q, 0) for q in below[p][spent])]:
            made.append((len(lo), q, used, False))
            kids_of[node].append(len(lo))
            lo.append(0)
            hi.append(0)
            own.append(q)
            kids_of.append([])
        work += reversed(made)
    order_ = np.array(order)
    radius = np.array([apart[p, order_[a:b]].max() if kids else 0.0 for p, a, b, kids in zip(own, lo, hi, kids_of, strict=True)]) * (1 + 1e-6) + np.where([bool(k) for k in kids_of], scale, 0)
    return Tree(order_, np.array(lo), np.array(hi), radius, np.cumsum([0, *map(len, kids_of)]), np.array([k for ks in kids_of for k in ks], dtype=np.int64))


def _opened(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of all `nodes` in a row (a leaf stands for itself), and which of `nodes` each comes from."""
    count = tree.first[nodes + 1] - tree.first[nodes]
    leaf = count == 0
    many = np.maximum(count, 1)
    source = np.repeat(np.arange(len(nodes)), many)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
    out = nodes[source]
    inner = ~leaf[source]
    out[inner] = tree.kids[tree.first[nodes[source[inner]]] + nth[inner]]
    return out, source


def nearest(tree: Tree, points: np.ndarray, over: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi, centroid: which runs of the tree's order are nearest to which centroid, ties to the smaller number.

    points are in the order of `tree`; those of `over` are the centroids.
    """
    numbers = np.array([over.order[a:b].min() for a, b in zip(over.lo, over.hi, strict=True)])  # at a leaf: of equal centroids the first
    a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(a):
        gap = points[tree.lo[a]] - centroids[over.order[over.lo[b]]]
        squared = (gap * gap).sum(1)
        d, ra, rb = np.sqrt(squared.astype(np.float64)), tree.radius[a], over.radius[b]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        size = np.diff(np.r_[starts, len(a)])
        upper = np.repeat(np.minimum.reduceat(d + ra, starts), size)
        keep = d - ra - rb <= upper * (1 + 1e-9) + 1e-6
        a, b, squared, ra, rb = a[keep], b[keep], squared[keep], ra[keep], rb[keep]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        size = np.diff(np.r_[starts, len(a)])
        wide = np.maximum.reduceat(rb, starts)
        leaves = np.maximum.reduceat((over.first[b + 1] > over.first[b]).astype(np.int8), starts) == 0
        flat = tree.first[a[starts] + 1] == tree.first[a[starts]]
        ended = leaves & ((size == 1) | flat)
        if ended.any():
            rows = np.repeat(ended, size)
            of = np.repeat(np.arange(len(starts)), size)[rows]
            best = np.lexsort((numbers[b[rows]], squared[rows], of))
            first = best[np.r_[True, of[1:] != of[:-1]]]
            done.append((tree.lo[a[starts][ended]], tree.hi[a[starts][ended]], numbers[b[rows]][first]))
        split_a = ~ended & ~flat & (leaves | (ra[starts] >= wide))
        rows = np.repeat(split_a, size)
        left, source = _opened(tree, a[rows])
        a1, b1 = left, b[rows][source]
        rows = np.repeat(~ended & ~split_a, size)
        right, source = _opened(over, b[rows])
        a2, b2 = a[rows][source], right
        a, b = np.r_[a1, a2], np.r_[b1, b2]
        together = np.argsort(a, kind="stable")
        a, b = a[together], b[together]
    lo, hi, number = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.argsort(lo)
    return lo[by], hi[by], number[by]


_INT, _REAL = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
_PARTS = {"lo": np.int32, "hi": np.int32, "radius": np.float64, "first": np.int32, "kids": np.int32}


def integers(vectors: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors with exactly `dim` components, none null or non-finite, each as floor(scale * x)."""
    rows = only(vectors, vec_id=id_col, v=vec_col)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where((F.size("v") == dim) & fine).select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def forest(rows: DataFrame, dim: int, block: int = BLOCK) -> DataFrame:
    """A row for each block of vectors: ids and vectors in the order of its cover tree, and the tree."""
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("vectors", T.BinaryType()), *(T.StructField(k, T.BinaryType()) for k in _PARTS)])

    def planted(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        if np.abs(v).max() > LARGEST:
            raise ValueError(f"a component lies beyond {LARGEST}")
        tree = cover_tree(v)
        parts = [pa.array([np.asarray(getattr(tree, k), dtype=t).tobytes()], pa.binary()) for k, t in _PARTS.items()]
        ids = ids.take(pa.array(tree.order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([v[tree.order].astype(np.int32).tobytes()], pa.binary()), *parts], ["ids", "vectors", *_PARTS])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        for b in it:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for i in range(0, len(flat), block):
                part = flat[i : i + block]
                ids.append(b.column("vec_id").slice(i, len(part)))
                held.append(part)
                n += len(part)
                while n >= block:
                    all_ids, all_v = pa.concat_arrays(ids), np.concatenate(held)
                    yield planted(all_ids.slice(0, block), all_v[:block])
                    ids, held, n = [all_ids.slice(block)], [all_v[block:]], n - block
        if n:
            yield planted(pa.concat_arrays(ids), np.concatenate(held))

    return stored(rows.mapInArrow(run, schema))


def _walked(it: Iterator[pa.RecordBatch], over: Tree, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: ids, vectors, and the runs nearest to a centroid."""
    dim = centroids.shape[1]
    for b in it:
        for i in range(b.num_rows):
            v = np.frombuffer(b.column("vectors")[i].as_py(), dtype=np.int32).astype(np.int64).reshape(-1, dim)
            parts = {k: np.frombuffer(b.column(k)[i].as_py(), dtype=t) for k, t in _PARTS.items()}
            yield (b.column("ids")[i].values, v, *nearest(Tree(np.arange(len(v)), **parts), v, over, centroids))


def moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the exact floor of their vectors' mean, an empty one as it was.

    Tasks add up their blocks; as many sums as there are components of centroids reach the driver.
    """
    held = trees.sparkSession.sparkContext.broadcast(np.array(centroids, dtype=np.int64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        sums, count = np.zeros(c.shape, dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        for _, v, lo, hi, number in _walked(it, cover_tree(c), c):
            running = np.concatenate([np.zeros((1, v.shape[1]), dtype=np.int64), v.cumsum(0)])
            np.add.at(sums, number, running[hi] - running[lo])
            np.add.at(count, number, hi - lo)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.mapInArrow(run, "cluster long, n long, sums array<long>")
    by = parts.select("cluster", "n", F.posexplode("sums").alias("nth", "part")).groupBy("cluster", "nth").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = [list(c) for c in centroids]
    for r in by.collect():  # clusters x components
        out[r.cluster][r.nth] = int(r.total) // r.n
    held.destroy()
    return out


def assigned(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""
    held = trees.sparkSession.sparkContext.broadcast(np.array(centroids, dtype=np.int64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for ids, v, lo, hi, number in _walked(it, cover_tree(c), c):
            cluster = np.repeat(number, hi - lo)
            gap = v - c[cluster]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array((gap * gap).sum(1))], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, T.StructType([T.StructField("vec_id", trees.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def first_centroids(rows: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors of least SHA-256 of `seed:id`, in that order; equal ids by their vectors, null ids last."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in rows.select(by.alias("by"), "v").orderBy(F.asc_nulls_last("by"), "v").limit(k).collect()]


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector after `rounds` rounds, and the final centroids.

    Vectors of another length, null ones, and those with a null or non-finite component are left out, as
    `integers` states; repeated rows count as often as they occur; ties go to the smaller centroid number; fewer
    vectors than k make as many centroids, none give an empty result. A component beyond 2^27 after scaling is an
    error, as its distances would not fit 64 bits. Equal vectors of a block are one leaf.
    """
    rows = integers(vectors, dim, scale, id_col, vec_col)
    trees = forest(rows, dim)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    return assigned(trees, centroids), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = pin(found)
    inertia = {r.cluster: int(r.inertia) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # 16 rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def by_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values or [None])), F.col("cluster") + 1)

    each = [inertia.get(i, 0) for i in range(len(centroids))]
    return found.select("vec_id", "cluster", "distance", by_cluster(each, "long").alias("cluster_inertia"), F.lit(sum(each)).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"))


def _sql() -> str:
    """Each round compares every vector with every centroid, component by component."""
    out = """WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS v FROM embeddings WHERE len(embedding) = 64
AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::varchar), v) - 1 AS c, v FROM kept QUALIFY c < 16)"""
    near = "SELECT r, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k.r, k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint AS d FROM kept k, c{n} c) GROUP BY r, vec_id, v"
    for n in range(3):
        out += f""",
a{n} AS ({near.format(n=n)}),
s{n} AS (SELECT c, j, sum(v[j])::hugeint AS s, count(*)::hugeint AS m FROM (SELECT c, v, unnest(range(1, 65)) AS j FROM a{n}) GROUP BY c, j),
c{n + 1} AS (SELECT c, coalesce(any_value(f), any_value(v)) AS v FROM c{n} LEFT JOIN (SELECT c, list(((s - ((s % m) + m) % m) / m)::bigint ORDER BY j) AS f FROM s{n} GROUP BY c) USING (c) GROUP BY c)"""
    return out + f""",
last AS ({near.format(n=3)})
SELECT vec_id, c::int AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::bigint AS cluster_inertia, sum(d) OVER ()::bigint AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM last JOIN c3 USING (c)"""


OP11_SQL = _sql()
