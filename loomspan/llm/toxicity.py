"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

The model is fitted on a bounded sample of labelled rows (`TRAIN_ROWS`); featurising is spread over
the cluster, the sequential updates run in one task over features only. L1 leaves few weights
other than zero, and there are at most 2**`BITS`, so they can be broadcast at any corpus size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import batches, only, small

#: Bound of the labelled rows used to fit; those of least hashed id are taken.
TRAIN_ROWS = 20_000
BITS, EPOCHS = 20, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 0.1
#: Letters of a word's stem, a feature beside the word itself.
STEM = 5
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")
_LOW = np.uint64(0xFFFFFFFF)
_STEM, _PAIR, _SKIP, _MIX = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    """Hash of the word below, of its first `STEM` letters above: inflected forms share the latter."""
    return zlib.crc32(word.encode()) | zlib.crc32(word[:STEM].encode()) << 32


def hashed(text: str | None) -> np.ndarray:
    """Feature numbers of the whole text, with repeats: words, stems, neighbouring pairs, pairs with a gap of one."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64)
    if len(_hashes) > 200_000:
        _hashes.clear()
    rare = {}
    for w in set(words):
        if w not in _hashes:
            (_hashes if len(w) <= 64 else rare)[w] = _hash(w)
    both = np.array([_hashes[w] if w in _hashes else rare[w] for w in words], np.uint64) if rare else np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h, stem = both & _LOW, both >> np.uint64(32)
    keys = [h * _MIX, stem * _STEM, h[:-1] * _PAIR + h[1:] * _MIX, h[:-2] * _SKIP + h[2:] * _MIX]
    mixed = np.concatenate([k ^ (k >> np.uint64(29)) for k in keys]) * _MIX
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    return np.unique(hashed(text))


def _fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not zero; index 2**BITS is the bias, free of L1."""
    size = 1 << BITS
    z, n, l1 = np.zeros(size + 1), np.zeros(size + 1), np.full(size + 1, L1)
    l1[size] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= l1[i], 0.0, w)

    for _ in range(EPOCHS):
        for x, y in rows:
            i = np.append(x, size)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    w = weights(np.arange(size + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most `rows` labelled documents that are not held out. No labels: no weights, score 0.5.

    A document with several labels has the largest; of several texts of one id the first in order counts, null as
    empty, so repeated rows and the order in which rows are read make no difference. Null ids and labels are left
    out. The features of the rows, four bytes each and once in a row, go to one task.
    """
    batches(docs.sparkSession)
    known = only(labels, doc_id=id_col, label=label_col).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = only(docs, doc_id=id_col, text=text_col).join(small(chosen, rows), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "label")

    def featurise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = [features(t).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.int32())), b.column("label").cast(pa.int32())], ["doc_id", "x", "y"])

    def train(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(x.values.to_numpy(), y) for b in it for x, y in zip(b.column("x"), b.column("y").to_pylist(), strict=True)]
        at, w = _fit(data) if data else (np.empty(0, np.int64), np.empty(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["i", "w"])

    schema = T.StructType([texts.schema["doc_id"], T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("y", T.IntegerType())])
    ordered = texts.mapInArrow(featurise, schema).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = ordered.mapInArrow(train, "i long, w double").toArrow()
    return got.column("i").to_numpy(), got.column("w").to_numpy()


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row; a null or empty text has the score of the bias alone.

    Repeated rows come out as often, with equal scores; an empty table gives an empty result.
    """
    batches(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col)
    at, value = weights

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = value
        for b in it:
            found = (hashed(t) for t in b.column("text").to_pylist())
            s = np.array([dense[np.unique(x[dense[x] != 0])].sum() for x in found]) + dense[-1]
            p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
