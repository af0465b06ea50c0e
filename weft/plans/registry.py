"""All queries of the library: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ["weft.plans.heavy_keys_queries", "weft.plans.text_queries", "weft.plans.match_queries", "weft.plans.eval_queries", "weft.plans.source_queries", "weft.plans.extra_queries"]


def core() -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in importlib.import_module(name).QUERIES.items():
            if key in out:
                raise ValueError(f"two queries are named {key}")
            out[key] = value
    return out
