"""The engine's queries and, by the same names, their DuckDB SQL."""

from __future__ import annotations

from . import geometry_queries, ingest_queries, score_queries, state_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
