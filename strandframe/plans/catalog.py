"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ["read_queries", "similarity_queries", "cluster_queries", "statistics_queries", "graph_queries", "file_queries", "overlap_queries", "assembly_queries"]


def load():
    for name in MODULES:
        importlib.import_module(f"strandframe.plans.{name}")
    from strandframe.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
