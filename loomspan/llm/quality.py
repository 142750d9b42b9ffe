"""Quality rules: counts over whole texts, and perplexity under a modified Kneser-Ney model.

The model is one of character 4-grams for each language, counted over every distinct line of the whole
corpus by Spark, so that neither copies nor near copies nor passages that many documents share make a text
less surprising. Each task adds up what it reads, and the sums are grouped by n-gram, so the model grows
with the corpus and no two n-grams share a count. Continuation counts, discounts and probabilities are joins and aggregations of
that table. It is stored by 64-bit hash; the `FREQUENT` most frequent n-grams, a bounded number at any
corpus size, go to every task as sorted hash arrays, and what a text has of all others is joined to the
stored table. A text's score is the mean cost of all its characters, where a segment counts as far off at
most as the ordinary segments of its language are, so a passage in another language or a key in a good text
does not decide. Each language's own distribution of scores, by length of text, then gives a lower and an
upper band outside of which documents are rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import batches, only, pin, small

ORDER = 4
SYMBOLS = "#*$%&|<>"
#: N-grams that every task gets (12 bytes each); all others are joined.
FREQUENT = 1 << 20
#: Characters handled at a time, distinct n-grams that a task holds, and the code point that pads the start of a text.
SLAB, HELD, PAD = 1 << 18, 1 << 21, 2
#: Characters of a segment.
SEGMENT = 256
#: Bands: the median of texts of like length, plus or minus so many median deviations, or bits over the root of the length
#: if that is wider; how often as far the lower band lies, since a large group of near copies is predictable but no junk; rows
#: from which a length has a band of its own; as how many upper bands of segments a segment counts at most, either way (so
#: the lower band rejects no text under about 450 characters).
DEVIATIONS, SHORT, BELOW, BAND_ROWS, REACH = 4.0, 3.0, 2.0, 50, 1.5
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has none."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes: at space and \\x09-\\x0D
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = data.split(b"\n")
    again = 0
    if len(set(lines)) < len(lines):
        full = [x for x in lines if x.strip(b" \t\x0b\x0c\r")]
        again = len(full) - len(set(full))
    repeated = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            ids: dict[tuple, int] = {}
            w = np.array([ids.setdefault(x, len(ids)) for x in windows])
            hit = np.bincount(w)[w] > 1
            covered = np.zeros(n, bool)
            for k in range(5):
                covered[k : k + len(w)] |= hit
            repeated = int(covered.sum())
    return n, chars, symbols, again, repeated


class Slab:
    """Places of whole texts or long texts' parts, laid end to end, each after its `ORDER - 1` characters before."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.text: list[int] = []
        self.lang: list[int] = []
        self.start: list[int] = []
        self.size = 0

    def add(self, nth: int, lang: int, codes: np.ndarray, start: int) -> None:
        self.codes.append(codes)
        self.text.append(nth)
        self.lang.append(lang)
        self.start.append(start)
        self.size += len(codes)

    def laid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, and for each real place: where it is, its text's number, its language's, its place in the text."""
        codes = np.concatenate(self.codes)
        lens = np.array([len(c) for c in self.codes])
        real = np.ones(len(codes), bool)
        begins = np.cumsum(lens) - lens
        for k in range(ORDER - 1):
            real[begins + k] = False
        at = np.flatnonzero(real)
        each = lens - (ORDER - 1)
        place = np.arange(len(at)) - np.repeat(np.cumsum(each) - each - np.array(self.start), each)
        return codes, at, np.repeat(np.array(self.text), each), np.repeat(np.array(self.lang, np.uint32), each), place


def _slabs(texts: list[str | None], langs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    slab = Slab()
    for nth, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        if not text:
            continue
        own = zlib.crc32(lang.encode())
        codes = np.concatenate([np.full(ORDER - 1, PAD, np.uint32), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])
        for i in range(0, len(codes) - ORDER + 1, SLAB):
            slab.add(nth, own, codes[i : i + SLAB + ORDER - 1], i)
            if slab.size >= SLAB:
                yield slab.laid()
                slab = Slab()
    if slab.size:
        yield slab.laid()


def keys_of(grams: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams (a column of code points for each place) and their languages."""
    total = lang.astype(np.uint64) * _ODD[ORDER]
    for codes, odd in zip(grams, _ODD, strict=False):
        total = total + (codes.astype(np.uint64) + np.uint64(1)) * odd
        total = (total ^ total >> np.uint64(29)) * _MIX
    return total ^ total >> np.uint64(32)


def _columns(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [codes[at - k] for k in range(ORDER - 1, -1, -1)]


class Counts:
    """N-grams met, by their hash: how often, and what they are."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.last = 0

    def add(self, key: np.ndarray, n: np.ndarray, gram: np.ndarray) -> None:
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.parts.append((key[first], np.add.reduceat(n[order], first) if len(key) else n, gram[order[first]]))
        self.size += len(first)
        if self.size > 2 * self.last + (1 << 19):
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            key, n, gram = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.size, self.last = [], 0, len(key)
            self.add(key, n, gram)
        self.last = self.size

    def rows(self) -> Iterator[pa.RecordBatch]:
        """lang, gram (little-endian code points), n; nothing is held afterwards."""
        self.merge()
        for _, n, gram in self.parts:
            for i in range(0, len(n), 50_000):
                g = np.ascontiguousarray(gram[i : i + 50_000, :ORDER])
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * ORDER), len(g), [None, pa.py_buffer(g)])
                yield pa.RecordBatch.from_arrays([pa.array(gram[i : i + 50_000, ORDER].astype(np.int64)), data.cast(pa.binary()), pa.array(n[i : i + 50_000])], ["lang", "gram", "n"])
        self.parts, self.size, self.last = [], 0, 0


def lines_of(text: str) -> dict[str, None]:
    """The distinct lines of a text, each after the `ORDER - 1` characters before it; no part is longer than a slab."""
    padded, at, out = chr(PAD) * (ORDER - 1) + text, ORDER - 1, {}
    while at < len(padded):
        end = min(padded.find("\n", at) + 1 or len(padded), at + SLAB)
        out[padded[at - ORDER + 1 : end]] = None
        at = end
    return out


def distinct_lines(docs: DataFrame) -> DataFrame:
    """lang (a number), line: every different line of `docs` (text, lang) once, by its characters and those before it.

    A line of any number of texts moves once from a task, so neither a hot text nor a hot line gathers anywhere.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([x for _, x in held], pa.string())], ["lang", "line"])

        for b in it:
            held, size = {}, 0
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                own = zlib.crc32(lang.encode())
                for line in lines_of(text or ""):
                    held[own, line] = None
                    size += len(line)
                    if size > 4 * SLAB:
                        yield made()
                        held, size = {}, 0
            if held:
                yield made()

    return docs.select("text", "lang").mapInArrow(run, "lang long, line string").distinct()


def ngrams(docs: DataFrame) -> DataFrame:
    """lang (a number), gram, n: how often each n-gram of `ORDER` characters occurs in all different lines of `docs` (text, lang)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for b in it:
            slab = Slab()
            langs, lines = b.column("lang").to_pylist(), b.column("line").to_pylist()
            for nth, (lang, line) in enumerate(zip(langs, lines, strict=True), 1):
                slab.add(0, lang, np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32), 0)
                if slab.size >= SLAB or nth == len(lines):
                    codes, at, _, own, _ = slab.laid()
                    gram = _columns(codes, at)
                    held.add(keys_of(gram, own), np.ones(len(at), np.int64), np.stack([*gram, own], axis=1))
                    slab = Slab()
            if held.size > HELD:
                yield from held.rows()
        yield from held.rows()

    return distinct_lines(docs).mapInArrow(run, "lang long, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _part(column: str, first: int, chars: int) -> Column:
    """So many characters of a gram from character `first` (from 0) on."""
    return F.substring(column, 4 * first + 1, 4 * chars)


def _discounts(counted: DataFrame) -> list[float]:
    """What n-grams seen once, twice, and three times or more give away, from how many are seen 1, 2, 3 and 4 times."""
    seen = counted.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5))).first()
    y = seen["n1"] / max(seen["n1"] + 2 * seen["n2"], 1)
    return [min(max(k - (k + 1) * y * seen[f"n{k + 1}"] / max(seen[f"n{k}"], 1), 0.1 * k), 0.95 * k) for k in (1, 2, 3)]


def kneser_ney(counted: DataFrame) -> DataFrame:
    """lang, gram, n, p of every n-gram of `counted` (lang, gram, n): interpolated modified Kneser-Ney.

    Below the highest order an n-gram counts as often as different characters come before it; below the
    first lies an even chance for each character of the language and one unseen.
    """
    orders = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = pin(orders[k + 1].groupBy("lang", _part("gram", 1, k).alias("gram")).agg(F.count("*").alias("n")))
    lower = orders[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("below")).withColumn("suffix", F.lit(b""))
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(orders[k])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = orders[k].select("lang", "gram", "n", off.alias("off"), _part("gram", 0, k - 1).alias("context"), _part("gram", 1, k - 1).alias("suffix"))
        after = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("mass"))
        p = ((F.col("n") - F.col("off")) + F.col("mass") * F.col("below")) / F.col("total")
        made = rows.join(after, ["lang", "context"]).join(lower, ["lang", "suffix"]).select("lang", "gram", "n", p.alias("p"))
        lower = made.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    return made


def stored_model(docs: DataFrame) -> DataFrame:
    """key, n, bits (what the last character of the n-gram costs) of the model of `docs` (text, lang)."""
    batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            codes = np.frombuffer(b"".join(b.column("gram").to_pylist()), np.uint32).reshape(-1, ORDER)
            key = keys_of(list(codes.T), b.column("lang").to_numpy().astype(np.uint32)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("n"), pa.array(-np.log2(b.column("p").to_numpy()))], ["key", "n", "bits"])

    return pin(kneser_ney(pin(ngrams(docs))).mapInArrow(run, "key long, n long, bits double"))


def most_frequent(model: DataFrame, most: int = FREQUENT) -> int:
    """The least count of the most frequent n-grams, at most `most`; 1 if that is all of them.

    From a histogram of counts by eighths of powers of two, which has a few hundred rows at most.
    """
    level = F.floor(F.log2("n") * 8)
    rows = model.groupBy(level.alias("level")).agg(F.count("*").alias("grams"), F.min("n").alias("low"), F.max("n").alias("top")).collect()
    total, least = 0, 1 + max((r.top for r in rows), default=0)
    for r in sorted(rows, key=lambda r: -r.level):
        total += r.grams
        if total > most:
            return least
        least = r.low
    return 1


class Costs:
    """Sorted hash arrays, and where the hashes of each leading pattern of bits begin."""

    LEAD = 20

    def __init__(self, key: np.ndarray, bits: np.ndarray) -> None:
        order = np.argsort(key.view(np.uint64))
        self.key, self.bits = key.view(np.uint64)[order], bits[order].astype(np.float32)

    def index(self) -> None:
        self.begin = np.searchsorted(self.key, np.arange(1 << self.LEAD, dtype=np.uint64) << np.uint64(64 - self.LEAD))

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs, and whether each key is there."""
        if not len(self.key):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = self.begin[key >> np.uint64(64 - self.LEAD)]
        last = len(self.key) - 1
        at = np.minimum(at, last)
        less = np.flatnonzero(self.key[at] < key)
        while len(less):
            at[less] += 1
            less = less[at[less] <= last]
            less = less[self.key[at[less]] < key[less]]
        at = np.minimum(at, last)
        there = self.key[at] == key
        return np.where(there, self.bits[at], 0.0), there


def scored(docs: DataFrame, most: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, segments for every row.

    segments: for each `SEGMENT` characters of the text in turn (the last ones may be fewer), their cost in
    bits; null and empty texts have none.
    """
    spark = docs.sparkSession
    batches(spark)
    docs = only(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    model = stored_model(docs)
    least = most_frequent(model, most)
    got = model.where(F.col("n") >= least).select("key", "bits").toArrow()  # at most `most` short rows
    shared = spark.sparkContext.broadcast(Costs(got.column("key").to_numpy(), got.column("bits").to_numpy()))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = shared.value
        costs.index()
        for b in it:
            texts = b.column("text").to_pylist()
            counts = [pa.array(c, pa.int64()) for c in zip(*map(counts_of, texts), strict=True)] or [pa.array([], pa.int64())] * 5
            sizes = np.array([len(t or "") for t in texts], np.int64)
            ends = np.concatenate([[0], np.cumsum(-(-sizes // SEGMENT))])
            bits, rare = np.zeros(ends[-1]), [[] for _ in texts]
            for codes, at, text, lang, place in _slabs(texts, b.column("lang").to_pylist()):
                key = keys_of(_columns(codes, at), lang)
                cost, there = costs(key)
                segment = place // SEGMENT
                bits += np.bincount(ends[text] + segment, weights=cost, minlength=ends[-1])
                for i in np.flatnonzero(~there):
                    rare[text[i]].append((int(segment[i]), int(key[i].view(np.int64))))
            segments = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bits))
            pairs = pa.array([[{"segment": s, "key": k} for s, k in r] for r in rare], pa.list_(pa.struct([("segment", pa.int32()), ("key", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(sizes), *counts, segments, pairs], ["doc_id", "lang", "n_chars", *fields, "segments", "rare"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang", T.StringType()), *(T.StructField(f, T.LongType()) for f in ("n_chars", *fields)), T.StructField("segments", T.ArrayType(T.DoubleType())), T.StructField("rare", T.ArrayType(T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("key", T.LongType())])))])
    rows = pin(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    if least > 1:
        rest = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*").groupBy("row", "segment", "key").agg(F.count("*").alias("times"))
        rest = rest.join(model.where(F.col("n") < least).select("key", F.col("bits").alias("cost")), "key").groupBy("row", "segment").agg(F.sum(F.col("times") * F.col("cost")).alias("more"))
        rest = rest.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("segment", "more"))).alias("more"))
        rows = rows.join(rest, "row", "left").withColumn("segments", F.transform("segments", lambda x, i: x + F.coalesce(F.col("more")[i], F.lit(0.0))))
    return rows.select("doc_id", "lang", "n_chars", *fields, "segments")


def _size(i: Column) -> Column:
    """Characters of segment `i` of a text."""
    return F.least(F.lit(SEGMENT), F.col("n_chars") - i * SEGMENT)


def mean_cost(low: Column | None = None, high: Column | None = None) -> Column:
    """The mean cost of a character over all segments, log2 of the perplexity.

    With `low` and `high` no segment counts as costing less or more a character than that; for segments of
    fewer characters than `SEGMENT`, whose costs vary more, the two lie apart from their middle by the root more.
    """
    total = F.lit(0.0)
    if low is None:
        total = F.aggregate("segments", total, lambda s, x: s + x)
    else:

        def bounded(x: Column, i: Column) -> Column:
            middle, wide = (low + high) / 2, (high - low) / 2 * F.sqrt(SEGMENT / _size(i))
            return F.coalesce(F.greatest(F.least(x / _size(i), middle + wide), middle - wide), x / _size(i)) * _size(i)

        total = F.aggregate(F.transform("segments", bounded), total, lambda s, x: s + x)
    return F.when(F.col("n_chars") > 0, total / F.col("n_chars"))


def _spread(fair: DataFrame, keys: list[str]) -> DataFrame:
    """rows, middle (median) and spread (median deviation) of bits for each of the keys."""
    middle = fair.groupBy(*keys).agg(F.percentile_approx("bits", 0.5, 1000).alias("middle"), F.count("*").alias("rows"))
    apart = fair.join(small(pin(middle)), keys)
    return apart.groupBy(*keys).agg(F.first("rows").alias("rows"), F.first("middle").alias("middle"), F.percentile_approx(F.abs(F.col("bits") - F.col("middle")), 0.5, 1000).alias("spread"))


def judged(docs: DataFrame, deviations: float = DEVIATIONS, **cols: str) -> DataFrame:
    """`scored` with base_failed, bits, lower, upper and kept.

    bits: the mean cost of a character over all segments, each counted within `REACH` times the band of its
    language's segments (if there are `BAND_ROWS` whole ones); null for null and empty texts, which fail the
    base rules. A null language is a language of its own, the same as an empty one. Repeated rows are judged
    alike, and copies of a text count once for the bands, as do equal lines for the model, so verdicts don't
    depend on how often a text is there. Lengths (powers of two) with fewer than `BAND_ROWS` texts of a language
    have the band of all its texts. An empty table gives an empty result.
    """
    rows = scored(docs, **cols).withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    rows = pin(rows.withColumn("level", F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("int")))
    whole = F.slice("segments", 1, F.floor(F.col("n_chars") / SEGMENT).cast("int"))
    each = pin(rows.where(~F.col("base_failed")).select("lang", F.explode(whole).alias("cost")).select("lang", (F.col("cost") / SEGMENT).alias("bits")).distinct())  # copies count once
    wide = F.lit(REACH) * F.greatest(F.col("spread") * F.lit(deviations), F.lit(SHORT / SEGMENT**0.5))
    bounds = _spread(each, ["lang"]).where(F.col("rows") >= BAND_ROWS).select("lang", (F.col("middle") - wide).alias("low"), (F.col("middle") + wide).alias("high"))
    rows = rows.join(small(pin(bounds)), "lang", "left").withColumn("bits", mean_cost(F.col("low"), F.col("high"))).drop("segments", "low", "high")
    fair = rows.where(~F.col("base_failed") & F.col("bits").isNotNull()).select("lang", "level", "n_chars", "bits").distinct()
    own = _spread(fair, ["lang", "level"]).where(F.col("rows") >= BAND_ROWS).select("lang", "level", F.col("middle").alias("own_middle"), F.col("spread").alias("own_spread"))
    out = rows.join(small(pin(_spread(fair, ["lang"]).drop("rows"))), "lang", "left").join(small(pin(own)), ["lang", "level"], "left")
    center, width = F.coalesce("own_middle", "middle"), F.greatest(F.coalesce("own_spread", "spread") * F.lit(deviations), F.lit(SHORT) / F.sqrt(F.greatest("n_chars", F.lit(1))))
    out = out.withColumn("lower", center - F.lit(BELOW) * width).withColumn("upper", center + width).drop("level", "own_middle", "own_spread")
    within = F.coalesce(F.col("bits").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & within)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", "lower", "upper")
