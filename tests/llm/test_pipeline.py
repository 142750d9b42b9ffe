"""The pipeline's stages on planted cases, each judged against plain Python, and the registered queries."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from loomspan.llm import packing, secrets

RNG = random.Random(11)
WORDS = [a + b for a in ("the", "an", "or", "ed", "st", "ing", "ble") for b in ("ea", "on", "er", "ti", "wh", "ou", "sh")]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    clean = [text(RNG.randrange(60, 200)) for _ in range(80)]
    item = text(25)
    near = clean[3].split()
    near[20] = "changed"
    planted = [clean[2], " ".join(near), f"{text(60)} {item} {text(60)}", "again and again " * 40, "too short", None, f"{text(80)} password=abcdefghijklmnop {text(30)}"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(clean + planted)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs.write.parquet(f"{sf_dir}/{name.replace(' ', '-')}.parquet")
        docs = spark.read.parquet(f"{sf_dir}/{name.replace(' ', '-')}.parquet")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    clean = set(range(80))
    assert set(kept[0]) == clean | {80, 81, 82, 86}  # junk, short and null go
    assert set(kept[1]) == clean | {82, 86}  # copies go
    assert set(kept[2]) == set(kept[3]) == clean | {86}
    assert "[SECRET]" in kept[3][86] and not secrets.spans_of(kept[3][86])
    assert all(kept[3][i] == kept[0][i] for i in clean)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(kept[3])
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= packing.CAPACITY


def test_odd_tables(spark, sf_dir, tmp_path):
    """An empty table goes through; columns of any name and type stay as they are."""
    d = str(tmp_path)
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "doc_id AS key", "'x' AS _key", "1 AS row", "struct(1 AS a) AS `b.c`", "'k' AS text_key")
    docs.limit(0).write.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, d).cache()
        assert docs.where("key = doc_id and _key = 'x' and row = 1 and `b.c`.a = 1 and text_key = 'k'").count() == docs.count() > 70, name


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
