"""All queries of the library, by name, with their DuckDB SQL."""

from __future__ import annotations

from quillgraph.jobs import queries_graph, queries_mapping, queries_sets  # noqa: F401 - register their queries
from quillgraph.jobs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
