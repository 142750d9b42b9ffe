"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import clustering, conversations, decontamination, html_extraction, packing, personal, quality, secrets, sharding, simhash, toxicity, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing,
        decontamination.op2_benchmark_decontamination,
        html_extraction.op3_html_extraction,
        sharding.op4_sharding,
        toxicity.op5_toxicity,
        secrets.op6_secret_scans,
        quality.op7_quality_rules,
        simhash.op8_simhash_near_dedup,
        warc.op9_warc,
        url_filters.op10_url_filters,
        clustering.op11_centroid_clustering,
        conversations.op12_conversation_trie,
        personal.op13_pii,
    )
}
ORACLE_SQL = {
    "op2_benchmark_decontamination": decontamination.OP2_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
    "op11_centroid_clustering": clustering.OP11_SQL,
    "op12_conversation_trie": conversations.OP12_SQL,
}
