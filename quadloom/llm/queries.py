"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: query name -> module that defines it; a module's ORACLE_SQL, where it has one, is the query's SQL.
QUERIES = {
    "op1_nn_descent": "nn_descent",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_warc_index_merge": "warc",
    "op4_best_fit_packing": "packing",
    "op5_mixing": "mixing",
    "op6_quality_rules": "quality_rules",
    "op7_substring_dedup": "substring_dedup",
    "op8_min_cost_resharding": "resharding",
    "op9_quality_classifier": "compression_classifier",
    "op10_simhash_near_dedup": "simhash_anchors",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
