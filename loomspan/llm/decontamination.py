"""Benchmark decontamination over a distributed positional inverted index (DataFrame functions only).

1. Document frequencies of the benchmark's own words, counted over the whole corpus.
2. Every window of a benchmark item names its rarest words; a window with a word the corpus lacks
   cannot occur and is dropped.
3. The index: postings (word, document, position) of those words, stored in the shared folder.
4. Intersection, rarest first: postings are moved by the word's offset in the item, so all words of
   an occurrence fall on one diagonal (item, document, shift); a diagonal stays if for some window
   all its listed words are on it.
5. Exact phrases: each surviving diagonal is compared with the document's words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import BROADCAST_ROWS, columns, only, pin, small

WINDOW = 10
#: Words of each window whose postings are intersected before phrases are compared.
LISTS = 2
#: Everything that is no digit, letter a-z or character beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words, with A-Z (and no other letters) lower-cased; null text has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """k1, k2: a row's key from its id and text, so that ids may be null or repeated."""
    row = [F.struct(*columns(docs.select(*(f"`{c}`" for c in carry)))).alias("row")] if carry else []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
    return docs.select("*", F.xxhash64("text", "doc_id").alias("k1"), F.hash("text").alias("k2"))


def _items(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """item (name), words, span (words of its windows); items without a name or words are no items."""
    named = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    return named.where("item is not null and size(words) > 0").distinct().withColumn("span", F.least(F.size("words"), F.lit(window)))


def anchors(docs: DataFrame, items: DataFrame, lists: int = LISTS, text_col: str = "text") -> DataFrame:
    """Items with `needs`: for each window that can occur, the offsets in the item of its rarest words."""
    vocabulary = pin(items.select(F.explode("words").alias("word")).distinct())
    tokens = docs.select(F.explode(words_of(F.col(text_col))).alias("word"))
    if vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        counts = tokens.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("df"))
    else:  # each task adds up its own words first, so that no word's rows meet in one
        counts = tokens.groupBy("word").agg(F.count("*").alias("df")).join(vocabulary, "word")
    placed = items.withColumn("item_key", F.xxhash64("item", F.array_join("words", " "))).select("*", F.posexplode("words").alias("off", "word"))
    counted = placed.join(pin(counts), "word", "left").groupBy("item", "item_key", "words", "span").agg(F.sort_array(F.collect_list(F.struct("off", F.coalesce("df", F.lit(0)).alias("df")))).alias("dfs"))
    needs = F.expr(f"""
        transform(
          filter(transform(sequence(0, size(words) - span), s -> slice(dfs, s + 1, span)), w -> forall(w, x -> x.df > 0)),
          w -> transform(slice(array_sort(transform(w, x -> struct(x.df as df, x.off as off))), 1, {int(lists)}), x -> x.off))""")
    return counted.select("item", "item_key", "words", "span", F.array_distinct(needs).alias("needs")).where("size(needs) > 0")


def postings(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of `words` (column word): word, k1, k2, pos (from 0)."""
    tokens = _keyed(docs, id_col, text_col).select("k1", "k2", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return tokens.join(small(words.select("word").distinct()), "word").select("word", "k1", "k2", "pos")


def diagonals(index: DataFrame, items: DataFrame) -> DataFrame:
    """Diagonals on which all listed words of a window meet: item_key, k1, k2, shift."""
    wanted = items.select("item_key", "needs", "words", F.explode(F.array_distinct(F.flatten("needs"))).alias("off"))
    wanted = wanted.select("item_key", "needs", "off", F.element_at("words", F.col("off") + 1).alias("word"))
    moved = index.join(small(wanted.select("item_key", "off", "word")), "word").select("item_key", "k1", "k2", (F.col("pos") - F.col("off")).alias("shift"), "off")
    met = moved.groupBy("item_key", "k1", "k2", "shift").agg(F.collect_set("off").alias("offs"))
    met = met.join(small(items.select("item_key", "needs")), "item_key")
    return met.where(F.expr("exists(needs, w -> size(array_except(w, offs)) = 0)")).select("item_key", "k1", "k2", "shift")


def proximity(index: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """Documents in which `second` follows `first` within so many words: k1, k2, pos, gap.

    Positions meet in blocks of `within` words, so no document's postings are paired with all others.
    """
    a = index.where(F.col("word") == first).select("k1", "k2", "pos", F.explode(F.array(*[F.expr(f"pos div {within}") + i for i in (0, 1)])).alias("block"))
    b = index.where(F.col("word") == second).select("k1", "k2", F.col("pos").alias("other"), F.expr(f"pos div {within}").alias("block"))
    gap = F.col("other") - F.col("pos")
    return a.join(b, ["k1", "k2", "block"]).where((gap > 0) & (gap <= within)).select("k1", "k2", "pos", gap.alias("gap"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, lists: int = LISTS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of `docs` once: doc_id, text, words, found (array of item, at, span), or with `carry` those columns and found.

    `at` is the position in the document of an occurring window of `span` words. Null texts have no
    words; repeated rows each get the same result; empty tables give empty results or no matches.
    """
    items = _items(benchmark, window, item_col, item_text)
    items = pin(anchors(only(docs, text=text_col), items, lists))
    listed = items.select(F.explode(F.array_distinct(F.flatten(F.transform("needs", lambda w: F.transform(w, lambda o: F.element_at("words", o + 1)))))).alias("word"))
    index = pin(postings(docs, listed, id_col, text_col))
    near = diagonals(index, items).join(small(items.select("item_key", "item", "words", "span")), "item_key")
    by_doc = near.groupBy("k1", "k2").agg(F.collect_list(F.struct("item", F.col("words").alias("item_words"), "span", "shift")).alias("near"))
    kept = ["row"] * bool(carry)
    rows = _keyed(docs, id_col, text_col, carry).join(by_doc.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", *kept, words_of(F.col("text")).alias("words"), "near")
    found = F.expr("""
        flatten(transform(near, d -> transform(
          filter(sequence(0, size(d.item_words) - d.span),
                 s -> d.shift + s >= 0 and slice(words, greatest(d.shift + s, 0) + 1, d.span) = slice(d.item_words, s + 1, d.span)),
          s -> struct(d.item as item, d.shift + s as at, d.span as span))))""")
    shown = ["row.*"] if carry else ["doc_id", "text", "words"]
    return rows.select(*shown, F.when(F.col("near").isNull(), F.expr("cast(array() as array<struct<item:string,at:int,span:int>>)")).otherwise(found).alias("found"))


def hit_words(found: Column) -> Column:
    """How many words lie in one of the spans, each counted once."""
    spans = F.sort_array(F.transform(found, lambda x: F.struct(x["at"].alias("a"), (x["at"] + x["span"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], x["b"]).alias("upto"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **cols: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    m = matches(docs, benchmark, window, **cols)
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item"])))
    out = m.select("doc_id", F.size("words").cast("long").alias("n_words"), hit_words(F.col("found")).alias("n_hit"), names.alias("names"))
    return out.select("doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id::varchar AS item, {_SQL_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS span, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS win
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM win),
grams AS (SELECT doc_id, i, span, array_to_string(w[i : i + span - 1], ' ') AS win
          FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)),
hits AS (SELECT doc_id, i, grams.span, item FROM grams JOIN win ON grams.win = win.win AND grams.span = win.span),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""
