"""Every query of the engine by name, with the DuckDB twin of each."""

from __future__ import annotations

from . import evaluation, evidence, geometry, ingestion, jobs, merging, model_calls, review, rules, text  # noqa: F401  they register themselves
from .registry import COVERS, ORACLE, QUERIES

__all__ = ["COVERS", "ORACLE", "QUERIES"]
