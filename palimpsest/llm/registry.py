"""All queries of this subpackage and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

from palimpsest.llm import (
    ball_tree_clusters,
    bit_sliced_topk,
    chosen_path_join,
    chunked_fim,
    context_mixing,
    counterfactual_toxicity,
    curriculum_mix,
    digest_log,
    histogram_shards,
    line_windows,
    shard_hnsw,
    tiered_packing,
    warc_zst,
)

_MODULES = (
    histogram_shards,
    digest_log,
    curriculum_mix,
    context_mixing,
    line_windows,
    warc_zst,
    tiered_packing,
    chosen_path_join,
    counterfactual_toxicity,
    bit_sliced_topk,
    shard_hnsw,
    ball_tree_clusters,
    chunked_fim,
)


def queries():
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
