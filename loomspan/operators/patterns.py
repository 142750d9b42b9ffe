"""Many patterns against many texts, by an index of the patterns' rarest pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.durable import pin, small

#: Most characters of a piece; literals of up to as many are a piece as a whole. Most different beginnings of pieces that are looked for by name.
PIECE, HEADS = 8, 4096


def _pieces(chars: Column, size: int) -> Column:
    """All different runs of `size` of a text's characters (an array, cut up before), in time that grows with their number."""
    last = F.size(chars) - size
    return F.array_distinct(F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(*(F.get(chars, i + j) for j in range(size)))))


def indexed(rows: DataFrame, text: str, patterns: DataFrame, pattern: str, literal: str) -> DataFrame:
    """Rows beside each row of `patterns` whose regular expression fits their text.

    `literal` is a part that every fit holds as it stands, not null and not empty. Of each literal's pieces the one that the fewest
    texts hold is looked up among the texts' pieces, by equality; what meets is then tried for the whole. Texts are cut up
    once, however many patterns there are, and equal ones count as one; a null text fits nothing. Pieces of a text that begin
    like no literal's are not shuffled, unless the beginnings (two characters) are very many. The columns of the two
    tables differ. A pattern whose rarest piece is common meets as many texts as hold it, and no fewer would do.
    """
    texts = pin(rows.where(F.col(text).isNotNull()).select(F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("_key"), F.col(text).alias("_text")).dropDuplicates(["_key"]))
    wanted = pin(patterns.where(F.length(literal) > 0).select(F.col(pattern).alias("_pattern"), F.col(literal).alias("_literal")).distinct())
    sizes = sorted(r[0] for r in wanted.select(F.least(F.length("_literal"), F.lit(PIECE))).distinct().collect()) or [PIECE]
    by_size = F.when(F.length("_literal") > PIECE, _pieces(F.split("_literal", ""), PIECE)).otherwise(F.array("_literal"))
    parts = wanted.select("_pattern", "_literal", F.explode(by_size).alias("_piece"))
    cut = texts.select("_key", F.split("_text", "").alias("_chars")).select("_key", F.explode(F.concat(*(_pieces(F.col("_chars"), n) for n in sizes))).alias("_piece"))
    head = F.substring("_piece", 1, 2)
    heads = [r[0] for r in parts.select(head).distinct().limit(HEADS + 1).collect()]
    if len(heads) <= HEADS:
        cut = cut.where(head.isin(heads))
    postings = pin(cut.join(small(parts.select("_piece").distinct()), "_piece", "left_semi"))
    held = parts.join(postings.groupBy("_piece").agg(F.count("*").alias("_n")), "_piece", "left")
    rarest = held.groupBy("_pattern", "_literal").agg(F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), "_piece")).alias("_piece"))
    tried = postings.join(small(rarest), "_piece").select("_key", "_pattern", "_literal").join(texts, "_key")
    fits = tried.where(F.contains("_text", "_literal")).where(F.expr("_text rlike _pattern")).select("_key", "_pattern").distinct()
    own = F.unhex(F.sha2(F.col(text).cast("binary"), 256))
    found = rows.withColumn("_key", own).join(fits, "_key").drop("_key")
    return found.join(patterns, F.col("_pattern") == patterns[pattern]).drop("_pattern")


def wildcard(rows: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """`rows` with the pattern of at most one `*` that fits the text best, and what the star stands for; null if none does.

    A pattern without a star fits the equal text and goes before all others; then the longest part before the star decides,
    then the longest behind it. The lengths of these two parts that occur are a small table (grouped, then collected); each
    different text is cut by each of them, and the cuts meet the patterns by equality. `rows` must not have columns of the
    names matched and star.
    """
    star = F.instr(pattern, "*")
    named = patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("matched"), star.alias("at")).distinct()
    exact = named.where("at = 0").select("matched")
    parts = named.where("at > 0").select("matched", F.substring("matched", 1, F.col("at") - 1).alias("before"), F.expr("substring(matched, at + 1)").alias("after"))
    parts = pin(parts)
    lengths = parts.select(F.length("before").alias("b"), F.length("after").alias("a"))
    shapes = sorted(tuple(r) for r in lengths.distinct().collect())
    texts = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()
    cuts = F.array(*(F.when(F.length("_text") >= b + a, F.struct(F.substring("_text", 1, b).alias("before"), (F.right("_text", F.lit(a)) if a else F.lit("")).alias("after"))) for b, a in shapes)) if shapes else F.expr("cast(array() as array<struct<before: string, after: string>>)")
    tried = texts.select("_text", F.explode(cuts).alias("cut")).where("cut is not null").select("_text", "cut.*")
    met = tried.join(small(parts), ["before", "after"])
    inner = F.expr("substring(_text, length(before) + 1, length(_text) - length(before) - length(after))")
    loose = met.groupBy("_text").agg(F.max(F.struct(F.length("before").alias("b"), F.length("after").alias("a"), "matched", inner.alias("star"))).alias("best")).select("_text", "best.matched", "best.star")
    same = texts.join(exact, F.col("_text") == F.col("matched"), "left_semi").select("_text", F.col("_text").alias("matched"), F.lit(None).cast("string").alias("star"))
    found = same.unionByName(loose.join(same, "_text", "left_anti"))
    return rows.join(found, F.col(text) == F.col("_text"), "left").drop("_text")
