"""The registered queries: each operator over the given tables, with its SQL."""

import importlib

GROUPS = ["log_queries", "rule_queries", "graph_queries", "resolve_queries", "source_queries", "schema_queries", "stream_queries"]


def load_all() -> None:
    for group in GROUPS:
        importlib.import_module(f"workload.{group}")
