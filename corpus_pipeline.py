"""A corpus from quality rules to packed sequences, in five stages of operators of `loomspan.llm`.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of
documents (the last one: placed pieces). Null texts fail the quality rules, so no later stage has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontamination, packing, quality, secrets, simhash
from loomspan.llm.common import columns, pin, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Rows are judged by id and text, so repeated ids do no harm."""
    keyed = docs.select(F.xxhash64("text", "lang", "doc_id").alias("key"), "text", "lang")
    kept = pin(quality.judged(keyed, id_col="key").where("kept").select(F.col("doc_id").alias("key")).distinct())
    rows = docs.select(F.struct(*columns(docs)).alias("row"))  # no column of docs meets ours
    return rows.join(kept, F.xxhash64("row.text", "row.lang", "row.doc_id") == F.col("key"), "left_semi").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near copies."""
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontamination.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns)
    return found.where(F.size("found") == 0).select(*columns(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked and n_chars to match."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in as few sequences as best-fit decreasing takes."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secret_scans),
    ("best-fit packing", pack),
]

#: The model, the fingerprints and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
