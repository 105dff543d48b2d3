"""The queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablero.llm import (
    decontamination, item_search, language_id, line_dedup, near_dedup, ngram_join, packing,
    periodic_runs, private_data, quality_net, quality_rules, reply_trees, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_near_dedup": near_dedup.query,
    "op2_language_id": language_id.query,
    "op3_quality_net": quality_net.query,
    "op4_toxicity": toxicity.query,
    "op5_packing": packing.query,
    "op6_line_dedup": line_dedup.query,
    "op7_private_data": private_data.query,
    "op8_decontamination": decontamination.query,
    "op9_quality_rules": quality_rules.query,
    "op10_reply_trees": reply_trees.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_item_search": item_search.query,
    "op13_ngram_join": ngram_join.query,
}

SQL: dict[str, str] = {
    "op1_near_dedup": near_dedup.sql(),
    "op6_line_dedup": line_dedup.sql(),
    "op7_private_data": private_data.sql(),
    "op9_quality_rules": quality_rules.sql(),
    "op10_reply_trees": reply_trees.sql(),
    "op12_item_search": item_search.sql(),
    "op13_ngram_join": ngram_join.sql(),
}
