"""Best-fit decreasing packing of tokenised documents into fixed-size sequences.

Every document is tokenised where it is read. What reaches the driver is one count per piece
length (at most `capacity` of them, whatever the corpus size); best-fit decreasing runs on
those counts, and each piece then finds its place from its rank among pieces of its length.
The plan equals the one-document-at-a-time algorithm: equal lengths are interchangeable.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import batches, only, pin

CAPACITY = 4096
END_ID = 1
#: Pieces in one generation of the cache of ids (two are kept), and the longest piece that is kept in it.
CACHE_PIECES, CACHE_CHARS = 250_000, 64

# The steps of the tokenizer whose texts may be encoded piece by piece.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Text of ASCII and Latin letters only, which no normal form changes; and, once in small letters, its pieces.
_PLAIN = re.compile(r"[\t\n -~À-ÖØ-öø-ÿ]*+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


class _Pieces(dict[str, bytes]):
    """Ids of pieces, of the generation in use; what it lacks comes from the one before or is encoded."""

    def __init__(self, encode: Callable[[str], bytes], before: dict[str, bytes]) -> None:
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        got = self.before.get(piece)
        if got is None:
            got = self.encode(piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = got
        return got


class Encoder:
    """Ids of whole texts, piece by piece.

    A tokenizer with the steps of `_NORMALIZERS` and `_SPLIT` lowers the case and parts a text into runs of
    letters, single digits and runs of other signs; the ids of a text are those of its pieces in turn, so
    repeated pieces go to the vocabulary's merges once. That holds for plain texts; in others each
    space-separated part that is not plain, or holds an added token, takes the tokenizer's whole way, and so
    do whole texts if the tokenizer has other steps.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        first = ((steps["pre_tokenizer"] or {}).get("pretokenizers") or [None])[0]
        self.by_piece = (steps["normalizer"] or {}).get("normalizers") == _NORMALIZERS and first == _SPLIT and steps["model"]["type"] == "BPE"
        added = steps["added_tokens"] or []
        self.by_piece &= not any(t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"] or any(c.isspace() for c in t["content"]) for t in added)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)")
        self.tokenize = self.tokenizer.model.tokenize
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: alphabet.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.pieces = _Pieces(self.merged, {})

    def merged(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece if piece.isascii() else piece.translate(self.bytes_of))]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return self.whole(text)
        get = self.pieces.__getitem__
        if self.plain(text):
            return b"".join(map(get, _PIECE.findall(text.lower())))
        parts = text.replace("\n", " ").split(" ")
        return b"".join(b"".join(map(get, _PIECE.findall(p.lower()))) if self.plain(p) else self.whole(p) for p in parts)

    def plain(self, text: str) -> bool:
        """Only ASCII and Latin letters, and none of the vocabulary's added tokens."""
        return _PLAIN.fullmatch(text) is not None and not self.added.search(text)

    def __call__(self, texts: list[str | None], end: int) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with `end` after them."""
        tail = array("I", [end]).tobytes()
        for t in texts:
            if len(self.pieces) > CACHE_PIECES:
                self.pieces = _Pieces(self.merged, dict(self.pieces))
            yield (self.encode(t) if t else b"") + tail


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, task, nth (and ids).

    `task` and `nth` number the pieces of one length within the task that made them. A null text
    counts as empty; an empty text is one piece that holds only the end id. Repeated rows are
    packed as often as they come.
    """
    batches(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.IntegerType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("nth", T.LongType()))), *[T.StructField("ids", T.BinaryType())] * ids])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in it:
            row, piece, start, length, crc, nth, data = [], [], [], [], [], [], []
            for i, b in enumerate(encode(batch.column("text").to_pylist(), end)):
                for k, at in enumerate(range(0, len(b), 4 * capacity)):
                    part = b[at : at + 4 * capacity]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    nth.append(seen[n])
                    seen[n] += 1
                    if ids:
                        data.append(part)
            out = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(data, pa.binary())] * ids, schema.names)

    return docs.mapInArrow(cut, schema)


class TightestFit:
    """Segment tree over remaining capacities that tells the least open one of at least n."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: dict[int, list[tuple[int, int]]] = {}

    def add(self, remaining: int, first: int, bins: int) -> None:
        if remaining and bins:
            self.open.setdefault(remaining, []).append((first, bins))
            self._count(remaining, 1)

    def take(self, remaining: int) -> tuple[int, int]:
        self._count(remaining, -1)
        return self.open[remaining].pop()

    def _count(self, remaining: int, by: int) -> None:
        at = remaining + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def tightest(self, n: int) -> int:
        """0 if no open bin has room for n."""
        at = n + self.size
        if self.tree[at]:
            return n
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return 0


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Best-fit decreasing over `counts` pieces of each length: the runs, and the number of bins.

    A run places pieces of one length from rank `rank` on into neighbouring bins from `bin` on,
    `each` to a bin, the first at `offset`. As the tightest bin stays the tightest until it is
    full, a bin takes all the equal pieces it can before the next one is looked for.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    fit, bins = TightestFit(capacity), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = fit.tightest(length)
            each = (room or capacity) // length
            need = -(-left // each)
            if room:
                first, there = fit.take(room)
                used = min(need, there)
                fit.add(room, first + used, there - used)
            else:
                first, used, room = bins, need, capacity
                bins += used
            put = min(left, used * each)
            runs.append((length, rank, first, each, capacity - room))
            full, rest = divmod(put, each)
            fit.add(room - each * length, first, full)
            if rest:
                fit.add(room - rest * length, first + full, 1)
            rank, left = rank + put, left - put
    made = np.array(runs, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "each", "offset"), made.T, strict=True)), bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID, ids: bool = False, **cols: str) -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Sequences hold at most `capacity` tokens and are filled without gaps from offset 0. An empty
    table gives an empty result; null ids are kept; ties have no effect on how full sequences are.
    """
    cut = pin(pieces(docs, tokenizer, capacity, end, ids, **cols))
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = best_fit(totals, capacity)
    order = np.lexsort((runs["rank"], runs["length"]))
    by = {k: v[order] for k, v in runs.items()}
    keys = by["length"].astype(np.float64) * 2.0**40 + by["rank"]  # exact below 2**53: ranks below 2**40

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, n * 2.0**40 + r, side="right") - 1
        bins, nth = np.divmod(r - by["rank"][at], by["each"][at])
        return pd.DataFrame({"sequence_id": by["bin"][at] + bins, "offset": by["offset"][at] + nth * n})

    placed = cut.join(ranks, ["task", "length"]).withColumn("at", place("length", F.col("before") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * ids)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
