"""Secret scans: base patterns, and weak candidates linked where complementary parts co-occur.

A weak part (a short or unnamed secret, a login or account name, an endpoint) proves nothing alone.
Parts of a document are joined as intervals: each is widened by `SCOPE` code points and meets the
parts of the complementary kinds that overlap it in the same paragraph. A weak secret is reported
with an identifier in scope, a weak identifier with a secret, an endpoint with both.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import batches, only

SCOPE = 200
#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, as [0-9a-f]+ would find it
_WEAK_ID = re.compile(r"\b(?:client|account|access|user|login)(?:[_-]?(?:id|name|key))?[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@+-]{4,})", re.I | re.A)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}")
_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.A)
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the base patterns, leftmost and non-overlapping for each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _meets(spans: list[tuple[int, int]], others: list[tuple[int, int]], breaks: list[int], scope: int) -> list[bool]:
    """Interval join: whether each span has another beside it within `scope` and in its paragraph.

    No span holds a line's end, so if any on one side is near enough, the nearest is.
    """
    starts, ends, out = sorted(a for a, _ in others), sorted(b for _, b in others), []
    for s, e in spans:
        paragraph = bisect_left(breaks, s)
        i, j = bisect_right(ends, s) - 1, bisect_left(starts, e)
        before = i >= 0 and ends[i] >= s - scope and bisect_left(breaks, ends[i]) == paragraph
        out.append(before or j < len(starts) and starts[j] <= e + scope and bisect_left(breaks, starts[j]) == paragraph)
    return out


class _Covered:
    """Spans laid together, to ask whether another overlaps any of them."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def __call__(self, s: int, e: int) -> bool:
        i = bisect_left(self.starts, e) - 1
        return i >= 0 and self.ends[i] > s


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Weak candidates whose complementary parts co-occur."""
    named = "=" in text or ":" in text
    weak_ids = [(m.start(1), m.end(1)) for m in _WEAK_ID.finditer(text)] if named else []
    points = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    access = [(s, e) for s, e, k in base if k == "access"]
    if not weak_ids and not points and not access:
        return []
    strong = [(s, e) for s, e, k in base if k != "access"]
    weak = [(m.start(), m.end()) for m in _ASSIGN.finditer(text) if 4 <= len(m[2]) < 12] if named else []
    weak += [(m.start(), m.end()) for m in _RANDOM.finditer(text)]
    sure = _Covered([(s, e) for s, e, _ in base])
    weak = sorted({(s, e) for s, e in weak if not sure(s, e)})
    taken = _Covered(weak)
    weak_ids = [(s, e) for s, e in weak_ids if not taken(s, e) and not sure(s, e)]
    ids, secrets, breaks = access + weak_ids, strong + weak, [m.start() for m in _PARAGRAPH.finditer(text)]
    out = [(*x, "weak_secret") for x, near_id in zip(weak, _meets(weak, ids, breaks, scope), strict=True) if near_id]
    out += [(*x, "weak_id") for x, near in zip(weak_ids, _meets(weak_ids, secrets, breaks, scope), strict=True) if near]
    return out + [(*x, "endpoint") for x, a, b in zip(points, _meets(points, ids, breaks, scope), _meets(points, secrets, breaks, scope), strict=True) if a and b]


def _order(x: tuple[int, int, str]) -> tuple[int, int, int]:
    return x[0], KINDS.index(x[2]), x[1]


def spans_of(text: str | None, scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind; code points) by start, then kind. Null text has none."""
    base = base_spans(text or "")
    return sorted(base + linked_spans(text or "", base, scope), key=_order)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of start, end, kind) for every row, by start, then kind, then end.

    Null and empty texts have no spans; repeated rows come out as often, with equal spans; an empty table
    gives an empty result. Time grows with a text's length and the logarithm of its parts.
    """
    batches(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans_of(t, scope)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("spans", _SPANS)]))


def redacted(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """`text` with the union of the spans replaced; touching or overlapping spans become one mask."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e, _ in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mask]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE, text_col: str = "text") -> DataFrame:
    """`docs` with every span in `text_col` replaced by `mask`; null stays null, other columns as they are."""
    batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t if not (t and (found := spans_of(t, scope))) else redacted(t, found, mask) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the columns' names
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:3]))
    counts = [F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

