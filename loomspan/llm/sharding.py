"""Sharding by sampled splitters (DataFrame functions only): shards of nearly equal bytes.

1. A sample of about `SAMPLE` keys, each row drawn with a chance in proportion to its size.
2. Its quantiles bound `ranges` key ranges; a key that fills a quantile by itself gets its own.
3. Ranges that still hold more than a range's fair share are subdivided by a second hash.
4. The parts are laid end to end; a row's place in that line of bytes gives its shard.

The key is a hash of the text, so equal texts lie side by side and stay in one shard, unless a
group of them exceeds `slack` of a shard and has to be cut.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import only, pin, small

SHARDS = 16
#: Sampled keys (expected), ranges per shard, and the share of a shard up to which equal texts are never parted.
SAMPLE, RANGES_PER_SHARD, SLACK = 16_384, 32, 0.02


def _index_of(key: Column, starts: list[int], fan: int = 24) -> Column:
    """How many of the sorted `starts` are at most `key`: first among every `fan`-th, then within."""
    blocks = [starts[i : i + fan] for i in range(0, len(starts), fan)]
    if not blocks:
        return F.lit(0)
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    rest = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda s: s <= key))
    within = F.size(F.filter(F.element_at(rest, F.greatest(block, F.lit(1))), lambda s: s <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * fan + within).cast("int")


def splitters(base: DataFrame, total: int, ranges: int, sample: int = SAMPLE) -> tuple[list[int], list[int]]:
    """Starts of the key ranges after the first, and the keys that have a range to themselves."""
    chance = F.col("size") * F.lit(float(sample)) / F.lit(float(max(total, 1)))
    draw = F.shiftrightunsigned(F.xxhash64("rid", F.lit(7)), 11) / F.lit(float(1 << 53))
    keys = sorted(r.key for r in base.where(draw < chance).select("key").collect())  # about `sample` of them
    if not keys:
        return [], []
    cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges)]
    alone = sorted({a for a, b in pairwise(cuts) if a == b})
    return sorted({*cuts, *(k + 1 for k in alone if k < (1 << 63) - 1)}), alone


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs`.

    Null texts count as empty (size 1); repeated rows are rows like others; equal keys are ordered
    by where they were read; an empty table gives an empty result. Slots are gapless in each shard. Where rows
    were read draws the sample too, so another layout of the same table may cut it elsewhere, under the same law.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = only(docs, doc_id=id_col, text=text_col)
    base = pin(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("rid")))
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * RANGES_PER_SHARD
    starts, alone = splitters(base, total, ranges, sample)
    is_alone = F.col("key").isin(alone) if alone else F.lit(False)
    ranged = base.withColumn("range", _index_of(F.col("key"), starts)).withColumn("spread", F.when(is_alone, F.xxhash64("rid")).otherwise(F.xxhash64("key", F.lit(3))))
    fair = max(1, total // ranges)
    pieces = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).select("range", F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(2 * fair))).cast("int").alias("cut"))  # at most 2 * ranges rows
    parts = ranged.join(small(pieces), "range").withColumn("part", F.pmod("spread", F.col("cut")).cast("int"))
    sums = parts.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # about 4 * ranges rows
    earlier = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    line = parts.join(small(offsets), ["range", "part"])
    order = Window.partitionBy("range", "part").orderBy("key", "rid")
    line = line.withColumn("at", F.col("bytes_before") + F.sum("size").over(order) - F.col("size")).withColumn("nth", F.col("rows_before") + F.row_number().over(order) - 1)
    group = Window.partitionBy("range", "part", "key")
    whole = F.sum("size").over(group) <= F.lit(slack * total / shards)
    middle = F.col("at") + F.col("size") / 2
    place = F.when(whole, F.min("at").over(group) + F.sum("size").over(group) / 2).otherwise(middle)
    laid = pin(line.select("doc_id", "size", "text_crc32", "nth", F.least(F.lit(shards - 1), F.floor(place * shards / F.lit(max(total, 1)))).cast("int").alias("shard")))
    first = laid.groupBy("shard").agg(F.min("nth").alias("first"))  # one row for each shard
    return laid.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law `bytes`: shard sizes near equal."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
