"""Registered queries on the given tables, each with its SQL twin where one exists."""

from importlib import import_module

FAMILIES = ["scans", "projections", "graph_tables", "retrieval_queries", "geometry_queries", "profile_queries",
            "selection_queries", "metric_queries", "drift_queries", "split_queries", "residue_graph_queries",
            "variant_queries", "learning_queries", "set_queries", "stream_queries"]


def load_all() -> None:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
